"""Sinks: typed JSON and CSV exports, edit lists as text, atomic small documents, content-addressed tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from hashlib import sha256
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def write_atomically(path: str, content: bytes) -> None:
    """A small document on the driver: written beside its place, synced, then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".", suffix=".part")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def canonical(value: Any) -> bytes:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()


def cache_key(fingerprint: Mapping[str, Any], stage: str, parameters: Mapping[str, Any]) -> str:
    """A name for what a stage makes of an input with some parameters."""
    return sha256(canonical({"fingerprint": fingerprint, "stage": stage, "parameters": parameters})).hexdigest()


def cached(make, root: str, key: str, schema) -> DataFrame:
    """The table under ``root/key=...`` if it is complete and has the columns of `schema`; else made by `make()` and written."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    spark, path = SparkSession.active(), f"{root.rstrip('/')}/key={key}"
    try:
        found = spark.read.parquet(path)
        if set(schema.fieldNames()) <= set(found.columns):
            return found.select(*schema.fieldNames())
    except AnalysisException:
        pass  # not there yet
    make().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def export_rows(df: DataFrame, folder: str, columns: Sequence[str], errors: DataFrame | None = None) -> None:
    """The rows as JSON lines, the named columns as CSV with a header, and errors beside them. Each is committed as a whole."""
    df.write.mode("overwrite").json(f"{folder}/records")
    df.select(*columns).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    if errors is not None:
        errors.write.mode("overwrite").json(f"{folder}/errors")


def flattened(df: DataFrame, ids: Sequence[str], maps: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Map columns as one column per name of a declared list, so that the columns do not depend on the data."""
    taken = [F.coalesce(*[F.try_element_at(F.col(m), F.lit(n)) for m in maps]).alias(n) for n in sorted(names)]
    return df.select(*ids, *taken)


def map_keys_of(df: DataFrame, maps: Sequence[str]) -> list[str]:
    """All keys that some maps hold, sorted: for a schema declared once from a sample of the data."""
    keys = None
    for m in maps:
        k = df.select(F.explode(F.map_keys(m)).alias("k"))
        keys = k if keys is None else keys.union(k)
    return sorted(r["k"] for r in keys.distinct().collect())


def event_document(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, event_count, events): one document per key, events in order of time; for keys of bounded size, such as a recording."""
    fields = [c for c in df.columns if c not in keys]
    order = ["t", *[c for c in fields if c != "t"]]
    return df.groupBy(*keys).agg(F.count("*").alias("event_count"), F.to_json(F.array_sort(F.collect_list(F.struct(*order)))).alias("events"))


def edit_lines(shots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ord, line): the readable list of an edit's shots."""
    line = F.concat_ws(" ", F.concat(S.clock("timeline_in"), F.lit("-"), S.clock("timeline_out")), F.rpad("section", 10, " "), F.col("variant_id"), F.coalesce("anchor_type", F.lit("no-payoff")))
    return shots.select(*keys, "ord", line.alias("line"))


def plot_table(df: DataFrame, keys: Sequence[str], t: str, series: Sequence[str]) -> DataFrame:
    """(keys, series, t, value): a long table that any plotting tool reads."""
    pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in series])
    return df.select(*keys, F.col(t).alias("t"), F.explode(pairs).alias("e")).select(*keys, "e.series", "t", "e.value")


def shifted(df: DataFrame, t: str, source_in: str, source_out: str, timeline_in: str) -> DataFrame:
    """Points of a source inside a shot, on the clock of the edit (shifted once)."""
    return df.filter(F.col(t).between(F.col(source_in), F.col(source_out))).withColumn(t, F.col(t) - F.col(source_in) + F.col(timeline_in))
