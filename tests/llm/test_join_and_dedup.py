import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import corpus, docs, multiset, words

from tidemark.llm import ngram_join, substring_dedup
from tidemark.llm._tables import components, give_back

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = SPLIT.findall(lower(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if sets[a] and 100 * o >= 80 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted([(i, len(sets[k]), least[root(k)], links[k]) for k, (i, _) in enumerate(rows)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force(spark, seed):
    rows = corpus(seed, 60)
    out = ngram_join.join(docs(spark, rows))
    assert multiset(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_join(rows)


def test_large_blocks_are_joined_by_parts(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(w[: 60 - rng.randrange(6)])))
    out = ngram_join.join(docs(spark, rows), block_shingles=300)
    assert multiset(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_join(rows)


@pytest.mark.parametrize("lists,pairs", [(2, 3), (4096, 100_000)])
def test_lists_that_ranges_cut_keep_all_links(spark, monkeypatch, lists, pairs):
    """A third of the rows near copies, over many ranges; lists cut by ranges and beyond the limit."""
    monkeypatch.setattr(ngram_join, "LIST_ROWS", lists)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(80)]
    rows = corpus(8, 40)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w[: 80 - rng.randrange(10)])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = multiset(ngram_join.join(docs(spark, rows), block_shingles=700), "doc_id", "n_shingles", "component_id", "n_links")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == brute_join(rows)


def test_sets_that_share_64_bits_stay_apart(spark, monkeypatch):
    real = ngram_join.identity
    monkeypatch.setattr(ngram_join, "identity", lambda s: (real(s)[0] % 3, real(s)[1]))
    schema = "id long, n long, one long, check long, prefix binary"
    meta = spark.createDataFrame([(k, 5 + k % 2, k % 3, k // 2, bytes([k])) for k in range(20)], schema)
    got = ngram_join._classes(meta).collect()
    want = {(k % 3, k // 2) for k in range(20)}
    assert {(r["one"], r["check"]) for r in got} == want and len({r["node"] for r in got}) == len(want)


def test_parts_of_a_large_component(spark):
    """Every two sets of sizes that can link meet in exactly one block, and no block is much over the limit."""
    rng = random.Random(3)
    sets = [(k, 0, k, k * 7, k, 1, rng.choice([50, 50, 50, 55, 60, 80, 100])) for k in range(400)]
    members = spark.createDataFrame(sets, "node long, label long, one long, check long, first long, docs long, n long")
    met, held = {}, {}
    for r in ngram_join._blocks(members, 80, 2000).collect():
        met.setdefault(r["block"], []).append((r["node"], r["side"], r["both"]))
    size = {s[0]: s[6] for s in sets}
    pairs = {}
    for block, rows in met.items():
        held[block] = sum(size[n] for n, _, _ in rows)
        for k, (a, x, both) in enumerate(rows):
            for b, y, _ in rows[:k]:
                if not both or x != y:
                    pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + 1
    assert all(v == 1 for v in pairs.values()) and max(held.values()) < 2 * 2000
    for a in range(400):
        for b in range(a):
            if 10 * min(size[a], size[b]) >= 8 * max(size[a], size[b]):
                assert (b, a) in pairs


def test_long_posting_lists_keep_all_ties(monkeypatch):
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(50, 80, 30))
    for i, j in ngram_join._ties(np.arange(30), n, rng.integers(0, 5, 30), 80):
        assert 0 <= i < 30 and 0 <= j < 30


@pytest.mark.parametrize("sides", [False, True])
def test_tree_join_equals_brute_force(sides):
    rng = np.random.default_rng(3)
    for _ in range(120):
        base = [set(rng.choice(60, rng.integers(1, 25), replace=False).tolist()) for _ in range(3)]
        made = set()
        for _ in range(rng.integers(1, 12)):
            s = set(base[rng.integers(3)])
            for _ in range(rng.integers(0, 4)):
                s ^= {int(rng.integers(60))}
            if s:
                made.add(frozenset(s))
        sets = [np.array(sorted(s), np.uint64) for s in made]
        if not sets:
            continue
        weight, side = rng.integers(1, 5, len(sets)), rng.integers(0, 2, len(sets))
        label, links = ngram_join.tree_join(sets, weight, side if sides else None, 80)
        parent, count = list(range(len(sets))), [0] * len(sets)
        root = lambda x: x if parent[x] == x else root(parent[x])
        for a in range(len(sets)):
            for b in range(len(sets)):
                o = len(np.intersect1d(sets[a], sets[b]))
                if a != b and (not sides or side[a] != side[b]) and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    count[a] += weight[b]
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
        assert count == links.tolist() and [root(x) for x in range(len(sets))] == label.tolist()


@pytest.mark.parametrize("percent", [40, 80])
@pytest.mark.parametrize("sides", [False, True])
def test_bitmaps_keep_all_links_and_tell_strangers_apart(percent, sides):
    rng = np.random.default_rng(percent)
    base = [rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in (3, 40, 64, 150, 700, 720)]
    sets = []
    for b in base:
        for _ in range(12):
            kept = b[rng.random(len(b)) < rng.choice([1, 0.95, 0.85, 0.6])]
            sets.append(np.unique(np.append(kept, rng.integers(0, 2**63, len(b) // 12 + 1).astype(np.uint64))))
    group = np.repeat(np.arange(len(base)), 12)
    side = rng.integers(0, 2, len(sets))
    label = ngram_join.alike([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]), side if sides else None, percent)
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o) and (not sides or side[a] != side[b]):
                assert label[a] == label[b]
    if percent == 80:
        assert all(label[a] != label[b] for a in range(len(sets)) for b in range(a) if group[a] != group[b] and min(group[a], group[b]) > 0)


@pytest.mark.parametrize("map_bytes", [1 << 12, 1 << 22])
def test_texts_tied_by_chance_are_not_dealt_to_parts(spark, monkeypatch, map_bytes):
    """Different texts with a passage in common, which no count puts last, are candidates but no block; of near copies all links are found."""
    rng = random.Random(2)
    passage = words(rng, 16, 10**6)
    rows = [(k, " ".join(words(rng, 50, 10**6) + passage + words(rng, 50, 10**6))) for k in range(80)]
    rows += [(100 + k, t + " more") for k, t in rows[:5]]
    dealt, real = [], ngram_join._joined
    monkeypatch.setattr(ngram_join, "_sketch", lambda *_: np.zeros(ngram_join.SLOTS, np.int32))
    monkeypatch.setattr(ngram_join, "_joined", lambda members, *a: dealt.append(members.count()) or real(members, *a))
    monkeypatch.setattr(ngram_join, "MAP_BYTES", map_bytes, raising=False)
    out = ngram_join.join(docs(spark, rows), block_shingles=400)
    assert multiset(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_join(rows)
    assert dealt == [10]


def test_join_of_an_empty_table_and_of_null_ids(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    out = ngram_join.join(docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, None)]))
    assert multiset(out, "doc_id", "component_id", "n_links") == sorted([(None, None, 0), (4, 4, 0), (None, None, 0)], key=repr)


def brute_dedup(rows, window):
    first = {}
    every = [(i, SPLIT.findall(t or "")) for i, t in rows]
    for i, w in every:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, w in every:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,gram", [(0, 6, 2), (1, 6, 6), (2, 10, 3), (3, 3, 1), (4, 50, 12)])
def test_dedup_equals_brute_force(spark, seed, window, gram):
    rows = [(i, t) for i, t in corpus(seed, 60)]
    rng = random.Random(seed)
    long = [f"z{rng.randrange(50)}" for _ in range(200)]
    rows += [(200 + k, " ".join(long[k * 7 : k * 7 + 90])) for k in range(8)] + [(300, " ".join(["rep"] * 120)), (299, " ".join(["rep"] * 70))]
    out = substring_dedup.dedup(docs(spark, rows), window=window, gram=gram)
    assert multiset(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_dedup(rows, window)


def test_dedup_across_batches_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 64)
    rows = corpus(9, 50)
    out = substring_dedup.dedup(docs(spark, rows).repartition(5), window=5, gram=2)
    assert multiset(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_dedup(rows, 5)


def test_a_hot_phrase_is_split_by_longer_prefixes(spark, monkeypatch):
    rng, common = random.Random(4), [f"c{k}" for k in range(12)]
    side = lambda: [f"w{rng.randrange(10**6)}" for _ in range(20)]
    rows = [(i, " ".join(side() + common + side())) for i in range(300)]
    rows += [(300 + i, f"{rows[i][1]} x{i}") for i in range(0, 300, 3)]
    seen = {}
    real = substring_dedup._repeated

    def watched(groups, window, at):
        sizes = groups.filter("words is not null").groupBy("key").agg({"size": "sum"}).toDF("key", "n")
        seen[at] = sizes.agg({"n": "max", "key": "count"}).first()
        return real(groups, window, at)

    monkeypatch.setattr(substring_dedup, "_repeated", watched)
    for at in (1 << 16, 50):
        out = substring_dedup.dedup(docs(spark, rows), window=20, gram=6, group_rows=at)
        assert multiset(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_dedup(rows, 20)
    assert seen[1 << 16]["max(n)"] > 500 and seen[50]["max(n)"] <= 50 and seen[50]["count(key)"] > 20


def test_dedup_of_an_empty_table_and_of_null_ids(spark):
    assert substring_dedup.dedup(docs(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    out = substring_dedup.dedup(docs(spark, [(None, text), (1, text), (0, None)]))
    assert multiset(out, "doc_id", "n_removed") == sorted([(None, 0), (1, 0), (0, 0)], key=repr)
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs(spark, []), window=5, gram=6)
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs(spark, []).withColumn("doc_id", F.lit("x")))


def test_one_passage_in_all_documents_and_very_long_texts(spark):
    """A group that is one node of more rows than a tree may have; a text of a million words."""
    rng, passage = random.Random(6), [f"p{k}" for k in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(9)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(9)])) for i in range(200)]
    long = [f"l{rng.randrange(10**5)}" for _ in range(300_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[1000:1100])), (400, " ".join(long[200_000:200_090])), (402, "x " * 100_000), (401, "x " * 50), (401, "x " * 50)]
    out = substring_dedup.dedup(docs(spark, rows).repartition(40), window=20, gram=6, group_rows=30)
    assert multiset(out, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_dedup(rows, 20)


def test_tree_of_random_words():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    codes = words.view(np.uint8).reshape(-1, 8)[:, : substring_dedup._WIDTH]
    for depth in (1, 3, 8):
        leaves = np.array([np.concatenate([np.zeros(8, np.uint8), codes[k : k + depth].ravel()]) for k in range(400 - depth + 1)])
        tree = substring_dedup.SuffixTree(leaves, depth)
        names = {}
        node = tree.deep_nodes()
        for k, n in zip(tree.order.tolist(), node.tolist()):
            assert names.setdefault(tuple(words[k : k + depth]), n) == n
        assert len(names) == len(set(node.tolist()))
        for a, b, c in zip(tree.order, tree.order[1:], tree.common[1:]):
            same = words[a : a + depth] == words[b : b + depth]
            assert c == (depth if same.all() else int(np.argmin(same)))


@pytest.mark.parametrize("task_edges,most_jobs", [(1 << 19, 12), (0, 1000)])
def test_components_of_few_edges_take_few_jobs(spark, task_edges, most_jobs):
    rng = np.random.default_rng(4)
    path = rng.permutation(300) - 150
    edges = [*zip(path[1:].tolist(), path[:-1].tolist()), *zip(*rng.integers(1000, 1400, (2, 150)).tolist()), (7_000, 7_000)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    spark.sparkContext.setJobGroup(f"components {task_edges}", "")
    try:
        out = components(spark.createDataFrame(edges, "a long, b long").repartition(3), task_edges=task_edges)
        assert multiset(out, "node", "label") == sorted(least.items(), key=repr)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {task_edges}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= most_jobs
    assert multiset(components(spark.createDataFrame([], "a long, b long"), task_edges=task_edges), "node", "label") == []


def test_the_driver_gives_freed_memory_back(spark):
    assert give_back(spark).startswith("Trim native heap")
