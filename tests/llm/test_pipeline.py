"""Each stage of the pipeline against a plain version on the smallest tables."""

import os

import pytest
from helpers import docs
from test_join_and_dedup import brute_join
from test_scans import brute_hits

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scan", "sentencepiece"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, DIR).cache()
        if name != "sentencepiece":
            assert out.columns == columns
        seen.append((kept, out))
        kept = out
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    from tidemark.llm import secret_scan, toxicity

    (a, b), (_, c), (_, d), (_, e), (_, f) = seen
    low = toxicity.classify(a, spark.read.parquet(f"{DIR}/labels.parquet")).filter("score < 0.3")
    assert sorted(r["doc_id"] for r in low.collect()) == sorted(i for i, _ in texts(b))
    assert sorted(i for i, _, first, _ in brute_join(texts(b)) if i == first) == sorted(i for i, _ in texts(c))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert sorted(x[0] for x in brute_hits(texts(c), items) if not x[5]) == sorted(i for i, _ in texts(d))
    want = {i: secret_scan.redacted(t, secret_scan.base_spans(t) + secret_scan.confirmed_spans(t)) for i, t in texts(d)}
    assert dict(texts(e)) == want and {r["doc_id"]: r["n_chars"] for r in e.collect()} == {i: len(t) for i, t in want.items()}
    assert f.count() == e.count() and f.filter("not round_trip").count() == 0


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, DIR)
    kept = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DIR)
    assert sorted(map(str, out.collect())) == sorted(map(str, kept.collect()))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    text = " ".join(f"w{k}" for k in range(60))
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, text), (None, text), (None, None), (5, text), (3, text + " x"), (5, text), (7, None), (8, ""), (8, ""), (9, f"a {item} b"), (10, "token = abcdefgh12"), (11, "x " * 60_000), (None, "plain")]
    odd = docs(spark, rows).selectExpr("*", "'f' first", "1 check", "2 node", "3 row", "4 size", "5 t", "6 who").drop("t")
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = odd, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path)).cache()
        if name != "sentencepiece":
            assert out.columns == odd.columns
        seen.append(sorted((r["doc_id"] for r in out.collect()), key=repr))
        kept = out
    ids = sorted((i for i, _ in rows), key=repr)
    once = sorted((i for i, _ in rows if i != 5), key=repr)
    clean = sorted((i for i, _ in rows if i not in (5, 9)), key=repr)
    assert seen == [ids, once, clean, clean, clean]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
