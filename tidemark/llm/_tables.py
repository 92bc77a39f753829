"""Tables that cut lineage, and connected components over edges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir
from ._text import tidy

#: Edges (16 bytes each) that one task settles; of more, every task replaces its own by a forest and rounds do the rest.
TASK_EDGES = 1 << 19
#: Rounds of the component search; it needs about the logarithm of the longest path.
MAX_ROUNDS = 60


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch, where it is the default, which suits narrow rows but not whole documents."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) == 10000:
        spark.conf.set(key, str(rows))


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, written to a table in the shared folder and read from there.

    Unlike cached or locally checkpointed rows, they survive lost executors.
    """
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As written, and the table's path, for drop()."""
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(df.sparkSession)
    _paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def give_back(spark: SparkSession) -> str:
    """Returns to the system what the driver's JVM has freed outside its heap: the C library would keep it, which after some hundred small
    jobs is a good part of the driver's memory. What the JVM answers; nothing, if it has no such command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, *items):
        out = array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:  # by reflection: the server's own class is not open to calls
        named = jvm.java.lang.Class.forName
        kinds = filled(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = filled(jvm.java.lang.Object, command, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))
        return str(named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given))
    except Py4JError:
        return ""


#: Tables that this process has written and not dropped, in order.
_paths: list[str] = []


def tables() -> list[str]:
    return list(_paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more: what was made from them is written itself, or saved by the caller."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _paths:
            _paths.remove(path)


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, and for each the smallest node it is connected to."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while len(u):  # a root is tied to its least neighbour; at least half of those with neighbours go in two turns
        x, y = label[u], label[v]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of each node and the smallest one that the task's edges connect it to, other than itself; TASK_EDGES at a time."""
    held, many = [], 0

    def settled() -> pa.RecordBatch:
        nodes, least = least_labels(*(np.concatenate(x) for x in zip(*held)))
        own = nodes != least
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        many += batch.num_rows
        if many >= TASK_EDGES:
            yield settled()
            held, many = [], 0
    if many:
        yield settled()


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label): every node of `edges` (longs) with the smallest node it is connected to.

    Up to `task_edges` edges are settled by one task. More go through alternating large-star and small-star rounds; each is an
    aggregation and an equi-join, so that no neighbourhood is gathered in a task. Only two counters reach the driver.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    (now, path), state = written_at(now.mapInArrow(tidy(_forest), "u long, v long").distinct()), None
    if now.count() <= task_edges:
        old = path
        now, path = written_at(now.coalesce(1).mapInArrow(tidy(_forest), "u long, v long"))
        drop(edges.sparkSession, [old])
        return _labels(now)
    for _ in range(MAX_ROUNDS):
        old = path
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.union(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), u).alias("m"))
        now = both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, is tied to the smallest
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(least, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        now, path = written_at(now)
        drop(edges.sparkSession, [old])
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return _labels(now)


def _labels(stars: DataFrame) -> DataFrame:
    """(node, label) of the ends of edges (u, v) from every node to the smallest one of its component, and of these."""
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.select("node", F.col("node").alias("label")))
