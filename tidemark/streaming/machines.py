"""Stateful streams: the count machine, debounced edges and windows, with the results of their batch forms.

State is kept per source in the state store: a few numbers, whatever the length of the stream. Rows of a source
have to arrive in order from one micro-batch to the next; within one they are sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import shared_dir


def count_machine(states: DataFrame, vanish: float, key: str = "source_id") -> DataFrame:
    """Streaming form of operators.fsm.count_changes over (key, event_id, t, present, count)."""
    kinds = dict(states.dtypes)
    out = f"{key} {kinds[key]}, event_id {kinds['event_id']}, t double, before int, after int, delta int, kind string"

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, high = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("t", kind="stable").itertuples(index=False):
            if not r.present:
                if last is not None and r.t - last >= vanish:
                    high = 0  # the panel is gone: counting starts anew
                continue
            last = float(r.t)
            if r.count_now > high:
                delta = int(r.count_now - high)
                rows.append((name[0], r.event_id, last, int(high), int(r.count_now), delta, "event" if delta == 1 else "request"))
                high = int(r.count_now)
        state.update((last, int(high)))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "event_id", "t", "before", "after", "delta", "kind"])

    renamed = states.withColumnRenamed("count", "count_now")  # count is a method of a named tuple
    return renamed.groupBy(key).applyInPandasWithState(advance, out, "last double, high int", "append", GroupStateTimeout.NoTimeout)


def edges(df: DataFrame, release: float, key: str = "source_id") -> DataFrame:
    """Streaming form of operators.fsm.rising_edges over (key, event_id, t, hit)."""
    kinds = dict(df.dtypes)

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, missed = state.get if state.exists else (False, None)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["t", "event_id"], kind="stable").itertuples(index=False):
            if not r.hit:
                missed = float(r.t) if missed is None else missed
                continue
            if not active or (missed is not None and r.t - missed + 1e-6 >= release):
                rows.append((name[0], r.event_id, float(r.t)))
            active, missed = True, None
        state.update((active, missed))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "event_id", "t"])

    return df.groupBy(key).applyInPandasWithState(advance, f"{key} {kinds[key]}, event_id {kinds['event_id']}, t double", "active boolean, missed double", "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, start, n, total) per window of event time; rows later than the watermark are dropped by a running stream."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("window.start").alias("start"), "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): runs of events at most `gap` apart (chaining)."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder, and reads it."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{where}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def observed(df: DataFrame, report: Callable[[dict], None], name: str = "progress") -> DataFrame:
    """`df`, counting its rows as they pass; `report` gets the count when the action ends. Nothing is computed twice."""
    from pyspark.sql import Observation

    seen = Observation(name)
    out = df.observe(seen, F.count("*").alias("rows"))
    out.progress = lambda: report(seen.get)  # type: ignore[attr-defined]
    return out
