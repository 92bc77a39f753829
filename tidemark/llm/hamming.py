r"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments, and the index is one table keyed by (segment, value). Round r looks up, for the segments
of a query, all values at distance r from the query's. A code not yet seen differs by at least r + 1 in each segment looked
up at r, and by r in each other one: with segments 0 to j done, every code up to distance m r + j is verified. A query needs
the segments up to its kth neighbour so far, no more, and is done when that leaves none for the next round, so that the result,
ties by id included, is that of a scan of all codes. Codes farther than that neighbour are dropped where they are met.

A round is an equi-join of two tables that grow with the data, so nothing is broadcast; it is split where a value is common. Equal codes are one entry of the index, with no more of their ids than any
result can need. Values at distance r come from those at r - 1 by one more bit, above the ones already turned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import drop, written_at

K = 10
BITS = 64


def binarise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): a bit for each component, set where it is not negative, the first one highest. A null vector has a
    null code, a null component counts as negative; a vector of over 64 components is an error. Other columns, of any names, are left behind."""
    v = F.col(vector_col)
    bits = F.aggregate(F.transform(v, lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")).alias("b")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    checked = F.when(F.size(v) > 64, F.raise_error(F.lit("codes have 64 bits"))).otherwise(bits)
    return vectors.select(F.col(id_col).alias("id"), F.when(v.isNotNull(), checked).alias("code"))


def _cut(m: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of m segments."""
    borders = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(borders, borders[1:])]


def _parts(codes: int, want: int) -> int:
    """The number of segments with the least work for a query: values looked up, and codes met and verified, until `want` are covered.

    Both follow from the distance at which that many codes are expected, for codes of independent bits. Other codes change
    the work alone, never the result."""
    within, far = 0.0, 0
    while far < BITS and (within := within + math.comb(BITS, far) / 2**BITS) * codes < want:
        far += 1

    def work(m: int) -> float:
        widths = [w for _, w in _cut(m)]
        return sum(math.comb(widths[t % m], t // m) * (1 + codes / 2 ** widths[t % m]) for t in range(far + 1))

    return min(range(2, 17), key=work)


def _segments(codes: int, want: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    return _cut(_parts(codes, want))


def _value(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _by_segment(df: DataFrame, code: str, segments: list[tuple[int, int]]) -> DataFrame:
    """`df`, a row for each segment: seg, width, value."""
    parts = [F.struct(F.lit(j).alias("seg"), F.lit(w).alias("width"), _value(F.col(code), a, w).alias("value")) for j, (a, w) in enumerate(segments)]
    return df.select("*", F.explode(F.array(*parts)).alias("_s")).select(*df.columns, "_s.seg", "_s.width", "_s.value")


def _turned(probes: DataFrame) -> DataFrame:
    """Probes with one more bit of their value turned, above `top`, the highest turned one."""
    bits = F.when(F.col("top") + 1 < F.col("width"), F.sequence(F.col("top") + 1, F.col("width") - 1))
    more = probes.select("*", F.explode(bits).alias("bit"))
    return more.select("asked", "bound", "seg", "width", F.expr("value ^ shiftleft(1L, bit)").alias("value"), F.col("bit").alias("top"))


def _first_found(segments: list[tuple[int, int]], r: int) -> Column:
    """Whether a code is found in this round and segment and not before: every code is verified once."""
    apart = F.col("asked").bitwiseXOR(F.col("code"))
    far = [F.bit_count(_value(apart, a, w)) for a, w in segments]
    later = F.lit(True)
    for j, d in enumerate(far):
        later = later & F.when(F.col("seg") > j, d > r).otherwise(d >= r)
    return later


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query, code, rank, neighbour, distance): the k rows of `index` nearest to each query, ties by id, rank from 1.

    Both have id (long) and code (long); other columns are not looked at, whatever their names. A row is not its own neighbour: rows
    of the query's id are left out. Rows with a null id or code are neither found nor searched for; repeated rows of the
    index are all found, repeated queries count once, a query id with two codes has two rankings. With fewer than k other
    rows, there are fewer results; an empty table gives none.
    """
    spark = index.sparkSession
    rows = index.filter("id is not null and code is not null").select("id", "code").groupBy("code", "id").agg(F.count("*").alias("many"))
    rows, rows_path = written_at(rows)
    asked = queries.filter("id is not null and code is not null").select("id", "code").distinct()
    # of each result, entries of the query's own id go: as many as that id has codes
    own = rows.join(asked.select("id").distinct().hint("merge"), "id").groupBy("id").count().agg(F.max("count")).first()[0] or 0
    want = k + int(own)
    order = Window.partitionBy("code").orderBy("id")
    some = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= want)
    codes, codes_path = written_at(some.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("id", "many"))).alias("ids")))
    segments = _segments(codes.count(), want)
    m = len(segments)
    entries = _by_segment(codes, "code", segments).drop("width")
    # bound: no neighbour of the query is farther than that
    active, active_path = written_at(asked.select(F.col("code").alias("asked")).distinct().withColumn("bound", F.lit(BITS)))
    near, near_path = None, None
    nearest = Window.partitionBy("asked").orderBy("distance", "id", "code")
    distance = F.bit_count(F.col("asked").bitwiseXOR(F.col("code")))
    for r in range(max(w for _, w in segments) + 1):
        probes = _by_segment(active, "asked", segments).filter(F.col("seg") + m * r <= F.col("bound")).withColumn("top", F.lit(-1))
        for _ in range(r):
            probes = _turned(probes)
        hits = probes.join(entries.hint("merge"), ["seg", "value"]).filter((distance <= F.col("bound")) & _first_found(segments, r))
        hits = hits.select("asked", distance.alias("distance"), "code", F.explode("ids").alias("e"))
        hits = hits.select("asked", "distance", "code", "e.id", "e.many")
        hits = hits if near is None else near.drop("place").unionByName(hits)
        old = [p for p in (near_path, active_path) if p]
        near, near_path = written_at(hits.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= want))
        last = near.filter(F.col("place") == want).select("asked", F.col("distance").alias("last"))
        active = active.join(last.hint("merge"), "asked", "left").select("asked", F.least("bound", "last").alias("bound"))
        active, active_path = written_at(active.filter(F.col("bound") >= m * (r + 1)))
        drop(spark, old)
        if active.isEmpty():
            break
    drop(spark, [rows_path, codes_path, active_path])
    found = asked.select(F.col("id").alias("query"), F.col("code").alias("asked")).join(near.hint("merge"), "asked").filter("id <> query")
    found = found.select("query", "asked", "distance", "id", F.explode(F.array_repeat(F.lit(0), F.least("many", F.lit(k)).cast("int"))))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "asked").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query", F.col("asked").alias("code"), "rank", F.col("id").alias("neighbour"), "distance")
