import os
import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, docs, multiset
from pyspark.sql import functions as F

from tidemark.llm import _labelled, pieces, quality, toxicity
from tidemark.llm.queries import MODEL_PATH

needs_model = pytest.mark.skipif(not os.path.exists(MODEL_PATH), reason="no vocabulary")


@needs_model
def test_ids_equal_the_library():
    import sentencepiece

    model = pieces.Model.parse(open(MODEL_PATH, "rb").read())
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "▁", "the", "0", "12", "é", "中", "\n", "\t", "!", "?.", "ß", "ñ", "😀", "́", "ﬁ", "①", "٣", "'s", "_", "²", "**", "\r"]
    texts = ["", " ", "a" * 500, "!" * 300, " " * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    memory = pieces.Memory(model)
    for t in texts:
        want = theirs.encode(t)
        assert model.encode(t, memory).tolist() == want, t
        assert model.unit_ids(model.normalise(t)) == want, t  # uncut: one stream over the whole text
        assert model.decode(want) == theirs.decode(want), t


def tiny(kind):
    named = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.5, 1), ("b", -1.7, 1), ("ab", -2.1, 1), ("ba", -2.6, 1), ("aab", -3.3, 1), ("▁a", -2.2, 1), ("abab", -5.0, 1)]
    return pieces.Model(named, kind)


def test_unigram_search_finds_the_best_segmentation():
    model = tiny(pieces.UNIGRAM)

    def best(t):
        if not t:
            return 0.0
        return max(best(t[n:]) + (model.score[model.ids[t[:n]]] if t[:n] in model.ids else model.penalty) for n in range(1, min(4, len(t)) + 1) if t[:n] in model.ids or n == 1)

    for n in range(1, 9):
        for t in map("".join, product("ab▁", repeat=n) if n < 7 else [random.Random(k).choices("ab▁x", k=n) for k in range(200)]):
            got = list(model.stream((t,)))
            assert "".join(got) == t
            score = sum(model.score[model.ids[p]] if p in model.ids else model.penalty for p in got)
            assert abs(score - best(t)) < 1e-9, (t, got)


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
def test_stream_is_the_same_in_any_portions_and_stays_bounded(kind, monkeypatch):
    model = tiny(kind)
    rng = random.Random(4)
    text = "".join(rng.choices("ab▁", k=3000))
    whole = list(model.stream((text,)))
    assert list(model.stream(text)) == whole  # one character at a time
    longest = 0
    step = model._extend_merges if kind == pieces.BPE else model._extend_scores

    def watched(tail, back, total):
        nonlocal longest
        longest = max(longest, len(tail))
        step(tail, back, total)

    monkeypatch.setattr(model, "_extend_merges" if kind == pieces.BPE else "_extend_scores", watched)
    list(model.stream((text,)))
    assert longest < 300


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 5)
    model = pieces.Model([("<unk>", 0.0, 2), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)], ("▁", -1.0, 1), ("a", -2.0, 1)], pieces.BPE)
    memory = pieces.Memory(model)
    for k in range(100):
        model.encode(" ".join("abcdefghij"[k % 10] * (k % 7 + 1) for k in range(k, k + 30)), memory)
        assert len(memory.young) <= 5 and len(memory.old) <= 5


@needs_model
def test_encode_and_decode_tables(spark):
    rows = corpus(2, 30) + [(900, "x" * 50_000), (None, "no id")]
    out = pieces.encode(docs(spark, rows), MODEL_PATH)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.collect())
    back = pieces.decode(out, MODEL_PATH)
    assert multiset(back, "doc_id", "text") == sorted([(i, t or "") for i, t in rows], key=repr)
    assert pieces.encode(docs(spark, []), MODEL_PATH).count() == 0


@needs_model
def test_decoding_of_odd_ids(spark):
    rows = [(1, [5, None, 300]), (2, None), (3, []), (3, []), (None, [300])]
    model = pieces.Model.parse(open(MODEL_PATH, "rb").read())
    make = lambda r: spark.createDataFrame(r, "doc_id long, ids array<int>")
    want = sorted([(i, None if x is None else model.decode([k for k in x if k is not None])) for i, x in rows], key=repr)
    assert multiset(pieces.decode(make(rows), MODEL_PATH), "doc_id", "text") == want
    for bad in (-1, len(model.pieces)):
        with pytest.raises(ValueError):
            model.decode([5, bad])
        with pytest.raises(Exception, match="ids are from 0"):
            pieces.decode(make([(1, [bad])]), MODEL_PATH).collect()


@needs_model
def test_units_in_portions(monkeypatch):
    model = pieces.Model.parse(open(MODEL_PATH, "rb").read())
    rng = random.Random(3)
    norm = model.normalise("".join(rng.choice(["a", "bc ", "  ", "12", "\n\n", "!?", "é", "▁", "中文 "]) for _ in range(3000)))
    whole = model.cut.findall(norm)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(pieces, "PORTION", size)
        assert list(model.units(norm)) == whole


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model.parse(b"\x0a\x05\x0a\x01a\x18\x04" + b"\x1a\x02\x18\x01")


# -- classifiers ---------------------------------------------------------------------------


def labelled(spark, seed=0, many=400):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(many):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        w = ["".join(rng.choices(["ka", "lo", "mi", "re", "tu"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "grumf" + rng.choice(["", "s", "ed", "ing"])
        if not good:
            w = [x + rng.choice(["###", "%%%", "@@@"]) for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def held_accuracy(out, labels, column):
    return out.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_toxicity_on_held_out_rows(spark):
    d, labels = labelled(spark)
    out = toxicity.classify(d, labels)
    assert held_accuracy(out, labels, "toxic") >= 0.97
    texts = dict((r["doc_id"], r["text"]) for r in d.collect())
    spans = [texts[r["doc_id"]][s["start"] : s["end"]] for r in out.collect() for s in r["spans"]]
    assert spans and sum("grumf" in s for s in spans) >= 0.9 * len(spans)
    kept = toxicity.drop(d, labels)
    assert kept.columns == d.columns and kept.count() == out.filter("predicted = 0").count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e, pair = rng.normal(size=n), rng.normal(size=(2, 2))
        total, marked = 0.0, np.zeros(n)
        for path in product((0, 1), repeat=n):
            p = np.exp(sum(x * s for x, s in zip(e, path)) + sum(pair[a, b] for a, b in zip(path, path[1:])))
            total += p
            marked += p * np.array(path)
        assert np.allclose(toxicity.marginals(e, np.array([0, n]), pair), marked / total)


def test_marginals_of_chains_over_many_blocks():
    """Against the plain recursion in logarithms, documents of all sizes at once."""
    rng = np.random.default_rng(1)
    for _ in range(10):
        sizes = np.concatenate([rng.integers(0, 400, 6), [0, 63, 64, 65, 128, 129, 1]])
        row = np.concatenate([[0], np.cumsum(sizes)])
        emission, pair = rng.normal(size=row[-1]) * 2, rng.normal(size=(2, 2)) * 2
        got = toxicity.marginals(emission, row, pair)
        for lo, hi in zip(row, row[1:]):
            if lo == hi:
                continue
            e, n = emission[lo:hi], hi - lo
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0, 1] = e[0]
            for t in range(1, n):
                f[t] = [np.logaddexp(*(f[t - 1] + pair[:, j])) + (e[t] if j else 0.0) for j in (0, 1)]
            for t in range(n - 2, -1, -1):
                b[t] = [np.logaddexp(*(pair[i] + b[t + 1] + [0.0, e[t + 1]])) for i in (0, 1)]
            z = f + b
            assert np.allclose(got[lo:hi], 1 / (1 + np.exp(z[:, 0] - z[:, 1])), atol=1e-9)


def test_quality_on_held_out_rows(spark):
    d, labels = labelled(spark, 1)
    out = quality.classify(d, labels)
    assert held_accuracy(out, labels, "quality") >= 0.95


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 2)), rng.normal(4, 1, (3000, 2))
    for share in (0.3, 0.6, 0.9):
        k = int(3000 * share)
        mixed = np.concatenate([rng.normal(0, 1, (k, 2)), bad[: 3000 - k]])
        borders = [np.quantile(np.concatenate([good, mixed])[:, j], np.linspace(0, 1, 17)[1:-1]) for j in range(2)]
        half = np.arange(3000) % 2
        models = quality.halves(good, mixed, half, half, borders)
        scores = quality.crossed(models, good, half)
        u = np.array([(quality.crossed(models, mixed, half) >= t).mean() for t in quality.thresholds(scores)])
        assert abs(quality.estimate_prior(scores, u, 3000) - share) < 0.08


def test_statistics_cover_all_rows(spark):
    d, _ = labelled(spark, 6, 500)
    table = quality.measured(d).cache()
    rows = [r for r in table.collect() if not r["held"]]
    x = np.array([r["x"] for r in rows])
    borders = quality.borders_of(table)
    for k, own in enumerate(borders):
        edges = quality._edges(k)
        cell = np.searchsorted(edges, np.sort(x[:, k]), side="left")
        want = [edges[cell[max(0, int(np.ceil(q * len(x))) - 1)]] for q in np.linspace(0, 1, quality.BINS + 1)[1:-1]]
        assert np.allclose(own, np.unique(want)), quality.MEASURES[k]
    rng = np.random.default_rng(1)
    models = [quality.Model(borders, rng.normal(size=len(borders) * (quality.BINS + 1)), 0.0, 0.5) for _ in range(2)]
    logits = quality.crossed(models, x, np.array([r["half"] for r in rows]))
    tops = np.sort(rng.choice(logits, 9))
    shares, many = quality.shares_above(table, models, tops)
    assert many == len(x) and np.allclose(shares, [(logits >= t).mean() for t in tops])


def test_descent_lowers_the_risk_of_plain_arithmetic():
    rng = np.random.default_rng(2)
    good, mixed = rng.normal(0, 1, (200, 2)), np.concatenate([rng.normal(0, 1, (100, 2)), rng.normal(3, 1, (100, 2))])
    borders = [np.quantile(mixed[:, j], [0.25, 0.5, 0.75]) for j in range(2)]

    def risk(model):
        up = [np.log1p(np.exp(-sum(model.weights[b] for b in r) - model.bias)) for r in model.bins(good)]
        down_good = [np.log1p(np.exp(sum(model.weights[b] for b in r) + model.bias)) for r in model.bins(good)]
        down = [np.log1p(np.exp(sum(model.weights[b] for b in r) + model.bias)) for r in model.bins(mixed)]
        return 0.5 * np.mean(up) + max(0.0, np.mean(down) - 0.5 * np.mean(down_good))

    steps = [risk(quality.fit(good, mixed, borders, 0.5, n)) for n in (0, 50, 800)]
    assert steps[0] > steps[1] > steps[2] and steps[2] < 0.4
    model = quality.fit(good, mixed, borders, 0.5, 800)
    rng = np.random.default_rng(3)
    for _ in range(50):  # near a minimum: no small step in any direction lowers it much
        moved = quality.Model(borders, model.weights + rng.normal(size=len(model.weights)) * 0.05, model.bias, 0.5)
        assert risk(moved) > steps[2] - 2e-3


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_tables(spark, module, column):
    d, labels = labelled(spark, 2, 200)
    odd = d.unionByName(docs(spark, corpus(7, 20) + [(None, "null id"), (10_001, "x " * 40_000)]))
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 7, 9)], "doc_id long, quality int, toxic int"))
    out = module.classify(odd, noisy)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert out.filter("doc_id is null and held_out").count() == 0
    assert module.classify(docs(spark, []), labels).count() == 0
    assert module.classify(d, labels.limit(0)).select("score").distinct().count() == 1


def test_held_out_ids_teach_nothing(spark):
    import zlib

    d, labels = labelled(spark, 3, 200)
    texts, counts = _labelled.sample(d, labels, "toxic")
    ids = [r["id"] for r in texts.collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    flipped = labels.withColumn("toxic", F.when(_labelled.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert multiset(toxicity.classify(d, labels), "doc_id", "score") == multiset(toxicity.classify(d, flipped), "doc_id", "score")
    assert sum(counts.values()) > 0


def test_sample_is_bounded(spark):
    d, labels = labelled(spark, 4, 300)
    texts, _ = _labelled.sample(d, labels, "toxic", rows=10, most_bytes=1 << 20)
    assert texts.groupBy("y").count().filter("count > 10").count() == 0


def test_long_texts_are_learned_from(spark):
    """Labelled texts of 45 kB each, and one of several MB."""
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(60):
        w = ["".join(rng.choices(["ka", "lo", "mi", "re", "tu"], k=rng.randrange(1, 4))) for _ in range(9_000)]
        if i % 3 == 0:
            for _ in range(20):
                w[rng.randrange(len(w))] = "grumf"
        if i % 2:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w * (100 if i == 6 else 1))))
        marks.append((i, i % 2 == 0, i % 3 == 0))
    d, labels = docs(spark, rows), spark.createDataFrame([(i, int(a), int(b)) for i, a, b in marks], "doc_id long, quality int, toxic int")
    assert held_accuracy(toxicity.classify(d, labels), labels, "toxic") == 1.0
    assert held_accuracy(quality.classify(d, labels), labels, "quality") == 1.0
    texts, _ = _labelled.sample(d, labels, "toxic", most_bytes=100_000)
    assert 2 <= texts.count() <= 8  # bytes bound the sample, not what may be in it


def test_contradicting_labels_and_repeated_ids(spark):
    d = docs(spark, [(0, "b"), (0, "a"), (4, "c"), (8, "d"), (1, None)])
    labels = spark.createDataFrame([(0, 1), (0, 1), (4, 1), (4, 0), (8, 0), (1, 1)], "doc_id long, toxic int")
    texts, counts = _labelled.sample(d, labels, "toxic")
    kept = {i for i in (0, 4, 8, 1) if __import__("zlib").crc32(str(i).encode()) % 4 != 2}
    assert multiset(texts, "id", "text", "y") == sorted([x for x in [(0, "a", 1), (8, "d", 0)] if x[0] in kept])
    assert counts == {0: int(8 in kept), 1: len(kept & {0, 1})}


@pytest.mark.parametrize("many,size,vocabulary", [(300, 2000, 30), (1000, 300, 1000), (1500, 1000, 20_000), (3000, 20, 300)])
def test_unrelated_texts_are_not_copies(many, size, vocabulary):
    rng = np.random.default_rng(0)
    weight = 1 / np.arange(1, vocabulary + 1)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in rng.choice(vocabulary, size, p=weight / weight.sum())) for _ in range(many)]
    sketch = []
    for _, _, offsets, raw in toxicity.chunks(pa.array(texts + texts[:20], pa.large_string())):
        sketch.append(toxicity._sketch(toxicity.Words(offsets, raw, toxicity._LETTERS, toxicity.LOWER)))
    first = toxicity._first_of_copies(np.concatenate(sketch))
    assert first[:many].all() and not first[many:].any()


def test_near_copies_count_once():
    rng = random.Random(0)
    base = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(300)]
    texts = []
    for _ in range(40):
        w = list(base)
        w[rng.randrange(300)] = "new"
        texts.append(" ".join(w))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = toxicity.Words(offsets, np.frombuffer("".join(texts).encode(), np.uint8), toxicity._LETTERS, toxicity.LOWER)
    assert toxicity._first_of_copies(toxicity._sketch(words)).sum() == 1


def test_features_are_found_again():
    field = toxicity.Field(np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)), np.zeros(5000), 0.0, np.zeros((2, 2)), np.zeros(3))
    assert (field.lookup(field.keys) == np.arange(5000)).all() and (field.lookup(field.keys + np.uint64(1)) < 0).mean() > 0.99
    assert toxicity.fit(np.array([0, 0]), pa.array(["a", "b"])) is None
