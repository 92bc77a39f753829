"""Media index: listing, probe output to typed rows, incremental re-use of earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

PROBE = "format struct<duration:string,bit_rate:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,channels:string,sample_rate:string>>"
#: Columns of the exported index, in order.
INDEX_COLUMNS = ("source_id", "file_path", "file_size", "duration", "width", "height", "fps", "codec", "bitrate", "audio_codec", "audio_channels", "audio_sample_rate", "creation_time", "category")


def listing(spark: SparkSession, root: str, suffixes: Sequence[str] = (".mp4", ".mkv", ".mov", ".webm")) -> DataFrame:
    """(file_path, file_size, modified) of files below `root` with one of the suffixes in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    ends = [F.lower("path").endswith(s) for s in suffixes]
    wanted = ends[0]
    for e in ends[1:]:
        wanted = wanted | e
    return files.filter(wanted).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def fingerprint(path: str = "file_path", size: str = "file_size", modified: str = "modified"):
    return F.sha2(F.concat_ws("|", F.col(path), F.col(size).cast("string"), F.unix_micros(F.col(modified).cast("timestamp_ltz")).cast("string")), 256)


def probed(df: DataFrame, probe: str = "probe") -> DataFrame:
    """Adds the columns of a media record from the JSON of a probe: the first video and the first audio stream. Text that
    is no JSON gives nulls and an `error`."""
    j = F.from_json(F.col(probe), PROBE)
    first = lambda kind: F.get(F.filter(F.col("_j.streams"), lambda s: s["codec_type"] == kind), F.lit(0))
    out = df.withColumn("_j", j).withColumn("_v", first("video")).withColumn("_a", first("audio"))
    duration = F.coalesce(F.col("_j.format.duration").try_cast("double"), F.lit(0.0))
    return out.withColumns(
        {
            "duration": duration,
            "width": F.col("_v.width"),
            "height": F.col("_v.height"),
            "fps": S.parse_rate(F.coalesce(F.col("_v.avg_frame_rate"), F.lit(""))),
            "codec": F.col("_v.codec_name"),
            "bitrate": S.optional_int("_j.format.bit_rate"),
            "audio_codec": F.col("_a.codec_name"),
            "audio_channels": S.optional_int("_a.channels"),
            "audio_sample_rate": S.optional_int("_a.sample_rate"),
            "creation_time": F.try_element_at(F.col("_j.format.tags"), F.lit("creation_time")),
            "category": S.duration_category(duration),
            "error": F.when(F.col("_j.streams").isNull(), "unreadable probe").when(F.col("_v").isNull(), "no video stream"),
        }
    ).drop("_j", "_v", "_a")


def incremental(current: DataFrame, previous: DataFrame, key: str = "file_path", mark: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(rows of `previous` still valid, files to probe): a file is re-used if its key and fingerprint are unchanged."""
    on = [key, mark]
    return previous.join(current.select(*on), on, "left_semi"), current.join(previous.select(*on), on, "left_anti")


def resolved(path):
    """A path with an absolute root, without empty and ``.`` parts, and each ``..`` taking the part before it away."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def is_within(path, root: str):
    """Whether a path, once resolved, is a folder or in it; a name that only starts alike is not."""
    top = resolved(F.lit(root))
    return (resolved(path) == top) | resolved(path).startswith(F.concat(top, F.when(top != "/", "/").otherwise("")))


def select_sources(df: DataFrame, folder: str, explicit: Sequence[str] | None = None, path: str = "file_path") -> DataFrame:
    """Files inside `folder`, all or those named; a named file outside it is an error."""
    inside = F.col(path).startswith(folder.rstrip("/") + "/")
    if explicit is None:
        return df.filter(inside)
    outside = [p for p in explicit if not p.startswith(folder.rstrip("/") + "/")]
    if outside:
        raise ValueError(f"not below {folder}: {outside[0]}")
    return df.filter(inside & F.col(path).isin(*explicit))


def profile_lookup(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """Records with the first profile (by `ord`) of their width and height; without one the status is UNPROFILED."""
    first = profiles.groupBy("width", "height").agg(F.min_by("profile_id", "ord").alias("profile_id"))
    return records.join(first, ["width", "height"], "left").withColumn("status", F.when(F.col("profile_id").isNull(), "UNPROFILED").otherwise("OK"))


def merge_ledger(ledger: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """The ledger with a fresh PENDING row for each source it lacks."""
    new = sources.select(key).distinct().join(ledger.select(key), key, "left_anti")
    return ledger.unionByName(new.withColumn("status", F.lit("PENDING")).withColumn("editorial_excluded", F.lit(False)), allowMissingColumns=True)


def set_status(ledger: DataFrame, updates: DataFrame, key: str = "source_id") -> DataFrame:
    """The ledger with new statuses; EXCLUDED ones are editorially excluded."""
    u = updates.select(key, F.col("status").alias("_new"))
    status = F.coalesce("_new", "status")
    return ledger.join(u, key, "left").withColumn("editorial_excluded", F.when(F.col("_new").isNotNull(), F.col("_new") == "EXCLUDED").otherwise(F.col("editorial_excluded"))).withColumn("status", status).drop("_new")


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either listing that the other lacks, with the side they are on; empty if nothing changed."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))
