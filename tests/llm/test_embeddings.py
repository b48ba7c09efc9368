import numpy as np
import pytest

from millrace.llm import embeddings


def brute(rows, t):
    n = len(rows)
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                link[a, b] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= t
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    while True:
        new = np.array([min([comp[k], *comp[link[k]]]) for k in range(n)])
        if (new == comp).all():
            return {int(i): (int(d), int(c)) for i, d, c in zip(ids, link.sum(1), comp, strict=True)}
        comp = new


@pytest.mark.parametrize("block", [1024, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24)).astype("float32")
    rows = []
    for k in range(160):
        v = base[rng.integers(12)] + rng.normal(size=24).astype("float32") * rng.choice([0.0, 0.1, 0.3, 0.45])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(200, None, 1), (201, [0.0] * 24, 1), (202, [float("nan")] * 24, 1), (203, [None] * 24, 1), (204, rows[0][1], None), (205, [float("inf")] + [1.0] * 23, 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (208, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS tile")
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows, 0.93) and sum(n for n, _ in got.values()) > 100


def test_copies_are_links(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(50)], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df).collect()
    assert all(r.n_links == 49 and r.component_id == 0 and r.kept == (r.id == 0) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    from millrace.llm import embeddings

    v = [1.0, 0.0, 0.1]
    rows = [(1, v, 0), (1, v, 0), (2, [1.0, 0.01, 0.1], 0), (None, v, 0), (None, None, None), (3, [0.0, 1.0, 0.0], 0), (3, v, 0), (2**60 + 1, v, 0), (5, v, None), (6, [-0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS key", "2 AS n", "3 AS rep")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    # the vectors that link: v under 1, 3 and the large id, and its neighbour under 2
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 0, None, False), (None, 0, None, False), (3, 0, 3, True), (3, 3, 1, False), (2**60 + 1, 3, 1, False), (5, 0, 5, True), (6, 0, 6, True)]
    assert got == sorted(want, key=repr)


def test_wide_vectors_are_refused(spark, monkeypatch):
    from millrace.llm import embeddings

    df = spark.createDataFrame([(1, [1.0] * 8, 0)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "WIDEST", 4)
    with pytest.raises(Exception, match="more than"):
        embeddings.near_duplicates(df).collect()
