"""Labelled rows for fitting: folds, and bounded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class that a model is fitted on, and the bytes of their texts together. Both bound the sample alone: texts of any
#: length are eligible, and the first one that exceeds the bytes still belongs to it.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8 << 20


def held_out(id_col: str) -> Column:
    """True for a quarter of the ids, from which nothing is learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def spread(id_col: str) -> Column:
    """An order of the ids that is as good as random, and the same in every run."""
    return F.xxhash64(F.lit("sample"), F.col(id_col))


def chosen_ids(labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(id, y) of at most `rows` labelled ids of each class outside the held-out fold, and the number of all such ids of each class.

    The choice is by a hash of the id, so it is spread over all. Repeated labels count once; an id with
    contradicting labels, like a null id or label, teaches nothing.
    """
    usable = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    parts = [usable.filter(F.col("y") == y).orderBy(spread("id"), "id").limit(rows) for y in (0, 1)]
    counts = {0: 0, 1: 0} | {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    return reduce(DataFrame.union, parts), counts


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, y, text) of a sample of each class, and the number of all usable labelled ids of each.

    At most `rows` a class in the order of `chosen_ids`, as long as the texts before a row have fewer than `most_bytes`
    bytes; sizes are looked up first, so that no more text is ever moved. Of rows that share an id the least text is learned from.
    """
    ids, counts = chosen_ids(labels, label_col, rows, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sizes = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.max(F.octet_length("text")).alias("size"))  # ids: a bounded number
    within, total = [], {0: 0, 1: 0}
    for r in sizes.orderBy(spread("id"), "id").collect():
        if total[r["y"]] < most_bytes:
            within.append((r["id"], r["y"]))
            total[r["y"]] += r["size"]
    kept = docs.sparkSession.createDataFrame(within, sizes.select("id", "y").schema)
    return texts.join(F.broadcast(kept), "id").groupBy("id", "y").agg(F.min("text").alias("text")), counts
