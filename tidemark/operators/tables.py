"""Tables in the shared folder, and what needs them: cut lineage, numbers along an order, exact percentiles of large groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on one machine, and an error on a cluster, whose
    machines would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to a table in the shared folder and read from there: they survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds `out`: 1, 2, ... along an order of the whole table. Rows are dealt by ranges, counted within each, and every range
    starts after the rows of those before: one row a range is all that one task sees."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))
    rows = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_in") + 1).drop("_at", "_part", "_in", "_first")


def _met(rows: DataFrame, each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their key's row; without keys there is one."""
    if not keys:
        return rows.join(F.broadcast(each))
    named = each.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(named, on).drop(*[f"_k{i}" for i in range(len(keys))])


#: Ranks that approximate percentiles may be off by: n over this.
ACCURACY = 1000


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, wanted: Mapping[str, tuple[float, bool]]) -> DataFrame:
    """(keys, n, a column per name): exact percentiles of each key's values, given as (share, interpolated); not interpolated they are the
    nearest rank, a value of the data. Nulls do not count.

    A key may have any number of values: approximate ones bracket each percentile, values below the brackets are only counted,
    and the few within (some thousandths of all) are ranked. Null keys are a key."""
    keys, eps = list(keys), 1.0 / ACCURACY
    shares = [p for p, _ in wanted.values()]
    x = df.select(*keys, value.cast("double").alias("_x")).filter("_x is not null")
    ends = F.array(*[F.lit(min(1.0, max(0.0, q))) for p in shares for q in (p - 2 * eps, p + 2 * eps)])
    near = x.groupBy(*keys).agg(F.percentile_approx("_x", ends, F.lit(ACCURACY)).alias("_e"), F.count("*").alias("n"))
    met = _met(x, near, keys)
    small = F.col("n") <= 4 * ACCURACY  # all are ranked
    low = lambda j: F.when(small | F.lit(shares[j] <= 2 * eps), float("-inf")).otherwise(F.get("_e", F.lit(2 * j)))
    high = lambda j: F.when(small | F.lit(shares[j] >= 1 - 2 * eps), float("inf")).otherwise(F.get("_e", F.lit(2 * j + 1)))
    below = met.groupBy(*keys, "n").agg(*[F.count_if(F.col("_x") < low(j)).alias(f"_b{j}") for j in range(len(shares))])
    inside = F.filter(F.array(*[F.when((F.col("_x") >= low(j)) & (F.col("_x") <= high(j)), F.lit(j)) for j in range(len(shares))]), lambda j: j.isNotNull())
    few = met.select(*keys, "_x", F.explode(inside).alias("_j")).groupBy(*keys, "_j", "_x").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_j").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("_to", upto)
    both = _met(few, below, keys)
    out = []
    for j, (name, (p, between)) in enumerate(wanted.items()):
        place = F.lit(p) * (F.col("n") - 1) if between else F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) - 1  # from 0
        at = lambda rank: F.max(F.when((F.col("_j") == j) & (F.col("_to") + F.col(f"_b{j}") > rank) & (F.col("_to") - F.col("_m") + F.col(f"_b{j}") <= rank), F.col("_x")))  # noqa: E731, B023
        share = F.first(place - F.floor(place))
        lower, upper = at(F.floor(place)), at(F.ceil(place))
        out.append((lower + share * (upper - lower) if between else lower).alias(name))
    return both.groupBy(*keys, "n").agg(*out)
