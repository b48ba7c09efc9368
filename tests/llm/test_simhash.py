import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.graph import components, local_stars
from tests.llm.conftest import ODD


def slow_fingerprint(t, k=3):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if x]
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("t", [t for _, t in ODD if t is None or len(t) < 1000] + ["A b\x0bC d", "Ä É x y"])
def test_fingerprint(t):
    assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b é".encode(), 42)).astype(np.int64)


@pytest.mark.parametrize("seed", range(12))
def test_walk_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    bits, n = int(rng.integers(3, 64)), int(rng.integers(1, 400))
    x = rng.integers(0, 1 << min(bits, 62), size=5, dtype=np.uint64)[rng.integers(0, 5, n)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64))
    a = np.unique(x)
    for budget in (0, 1, 2):
        i, j = simhash.walk(a, None, bits, budget)
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= budget
        assert sorted(zip(i, j, strict=True)) == [(p, q) for p, q in zip(*np.nonzero(near), strict=True) if p < q]


def smallest(n, links):
    up = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    return up


@pytest.mark.parametrize("seed", range(6))
def test_stars_and_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = 60
    links = rng.integers(0, n, (int(rng.integers(1, 70)), 2))
    if seed == 0:
        links = np.array([[k, k + 1] for k in range(n - 1)])  # a path
    if seed == 1:
        links = np.array([[7, k] for k in range(n)])  # a hub
    want = smallest(n, links)
    assert local_stars(n, links[:, 0].copy(), links[:, 1].copy()).tolist() == want
    got = {r.node: r.component for r in components(spark.createDataFrame(links.tolist(), "a long, b long")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(n))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("node", "block"), [(256, 4096), (2, 3), (1, 1)])
def test_classes_against_brute_force(spark, monkeypatch, node, block):
    """Small nodes and blocks make the cluster's part of the walk, and hot nodes, do the work."""
    monkeypatch.setattr(simhash, "NODE", node)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(p)) for p in (0, 5, 40, 61, 62, 63)], base[:9] ^ np.uint64(7 << 60)]))
    df = spark.createDataFrame([(int(f), k) for k, f in enumerate(fp.view(np.int64))], "fp long, rep long")
    comp = {r.node: r.component for r in components(simhash.links(df)).collect()}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    want = smallest(len(fp), np.argwhere(near))
    assert [comp.get(k, k) for k in range(len(fp))] == want


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs, shingle=3).collect()
    assert len(got) == len(ODD) and simhash.near_duplicates(no_docs).count() == 0
    comp = {r.id: r.component_id for r in got}
    assert comp[None] is None and comp[1] == comp[2] == comp[3] == 1 and comp[7] == 6 and comp[8] == 8
    assert {r.id: r.fp for r in got}[1] == 0


def test_similar_texts_group_and_others_stay(docs_of):
    import random

    rng = random.Random(1)
    words = [f"v{k}" for k in range(4000)]
    rows, group = [], {}
    for g in range(25):
        t = rng.choices(words, k=300)
        for c in range(3):
            u = list(t)
            for _ in range(5 * c):  # similarity about 0.85 and 0.7 and more
                u[rng.randrange(300)] = rng.choice(words)
            group[len(rows)] = (g, c)
            rows.append((len(rows), " ".join(u)))
    comp = {r.id: r.component_id for r in simhash.similar(docs_of(rows)).collect()}
    assert all(group[i][0] == group[c][0] for i, c in comp.items())
    near = [i for i in comp if group[i][1] == 1]
    assert sum(comp[i] == i - 1 for i in near) >= 0.9 * len(near)
    kept = {r.doc_id for r in simhash.keep_one(docs_of(rows)).collect()}
    assert kept == {i for i, c in comp.items() if i == c}


def jaccard(a, b):
    a, b = (set(simhash.shingles(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [256, 2])
def test_exact_similarity_decides(docs_of, monkeypatch, block):
    """Pairs below the threshold stay apart however close their signatures are, and those above it are found."""
    import random

    monkeypatch.setattr(simhash, "EXACT", block)
    rng = random.Random(2)
    words = [f"v{k}" for k in range(4000)]
    texts = []
    for g in range(40):
        t = rng.choices(words, k=300)
        for c in range(6):
            u = list(t)
            for k in rng.sample(range(0, 300, 5), (0, 3, 5, 7, 9, 11)[c]):
                u[k] = rng.choice(words)
            texts.append(" ".join(u))
    links = [(a, b) for g in range(0, len(texts), 6) for a in range(g, g + 6) for b in range(a + 1, g + 6) if jaccard(texts[a], texts[b]) >= 0.8]
    want = smallest(len(texts), links)
    comp = {r.id: r.component_id for r in simhash.similar(docs_of(list(enumerate(texts)))).collect()}
    assert all(comp[k] >= want[k] for k in comp)  # nothing is linked that shouldn't be
    assert sum(comp[k] == want[k] for k in comp) >= 0.98 * len(want)


def test_recall_counts_both_steps():
    for depth in (1, 8, 16, 24):
        budget, tries = simhash.plan(0.8, 0.985, depth)
        off = simhash.differing(0.8)
        assert simhash.within(budget, off) * (1 - (1 - (1 - off) ** depth) ** tries) >= 0.985


def test_large_ids_beside_nulls(odd_docs):
    from millrace.llm import simhash

    assert {2**60 + 1, None} <= {r.id for r in simhash.fingerprints(odd_docs).collect()}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("gone = 1").count() == kept.count()
