"""A data source for decoded frames stored as raw files, with the time window and region pushed into the read.

Media decoding needs a decoder outside Spark. What it writes, raw frames one after another, is read here: grey or colour pictures
(`raw_frames`), or signed 16-bit sound (`raw_sound`). Each file is cut into ranges, one input partition each, and only
the bytes of what is wanted are read. Paths may be local, or URIs of any store that Arrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "frame_no long, t double, width int, height int, pixels binary"
SOUND = "start_s double, samples array<float>"


def opened(path: str):
    """(size in bytes, a function that opens the file for random reads)."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(name)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size, lambda: store.open_input_file(name)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RawFrames(DataSource):
    """Options: path, width, height, fps, and optionally channels (1 grey, 3 colour), start, end (seconds, closed), region
    (x1,y1,x2,y2 in pixels), every (each nth frame from the first on), framesPerPartition. A file whose last frame is cut off is
    an error."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.fps = float(options["fps"])
        self.start, self.end = float(options.get("start", 0)), float(options.get("end", "inf"))
        self.region = [int(x) for x in options["region"].split(",")] if "region" in options else [0, 0, self.width, self.height]
        self.step = int(options.get("framesperpartition", 1024))
        self.channels, self.every = int(options.get("channels", 1)), int(options.get("every", 1))

    def partitions(self) -> list[InputPartition]:
        total, rest = divmod(opened(self.path)[0], self.width * self.height * self.channels)
        if rest:
            raise ValueError(f"{self.path} ends within a frame")
        first = max(0, -int(-self.start * self.fps // 1))
        last = total if self.end == float("inf") else min(total, int(self.end * self.fps) + 1)
        return [_Range(a, min(last, a + self.step)) for a in range(first, last, self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import numpy as np

        x1, y1, x2, y2 = self.region
        size = self.width * self.height * self.channels
        with opened(self.path)[1]() as f:
            for n in range(partition.first - partition.first % -self.every, partition.last, self.every):
                frame = np.frombuffer(f.read_at(size, n * size), np.uint8).reshape(self.height, self.width, self.channels)[y1:y2, x1:x2]
                yield n, n / self.fps, x2 - x1, y2 - y1, frame.tobytes()


class RawSound(DataSource):
    """Chunks of one channel of signed 16-bit samples as shares of full scale. Options: path, rate, and optionally chunkSeconds (60) and
    overlap (samples that a chunk shares with the next one, for frames that reach over the border). A file that ends within a sample is an error."""

    @classmethod
    def name(cls) -> str:
        return "raw_sound"

    def schema(self) -> str:
        return SOUND

    def reader(self, schema) -> DataSourceReader:
        return _Sound(self.options)


class _Sound(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rate = options["path"], int(options["rate"])
        self.chunk = max(1, round(float(options.get("chunkseconds", 60)) * self.rate))
        self.overlap = int(options.get("overlap", 0))

    def partitions(self) -> list[InputPartition]:
        total, rest = divmod(opened(self.path)[0], 2)
        if rest:
            raise ValueError(f"{self.path} ends within a sample")
        return [_Range(a, min(total, a + self.chunk + self.overlap)) for a in range(0, total, self.chunk)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        import numpy as np

        with opened(self.path)[1]() as f:
            raw = f.read_at(2 * (partition.last - partition.first), 2 * partition.first)
        yield partition.first / self.rate, (np.frombuffer(raw, "<i2") / 32768.0).astype("float32").tolist()
