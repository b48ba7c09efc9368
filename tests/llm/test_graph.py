import math
import random

import pytest

from millrace.llm import common
from millrace.llm.graph import components


def plain(edges):
    """Smallest reachable node of every end, by repeated relabelling."""
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def run(spark, edges, kind="long", **options):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return {r.node: r.component for r in components(df, **options).collect()}


@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_rounds_on_paths(spark, order):
    n = 1000 if order != "random" else 300
    ids = list(range(n))
    if order == "random":
        random.Random(4).shuffle(ids)
    edges = list(zip(ids, ids[1:], strict=False)) if order != "descending" else [(b, a) for a, b in zip(ids, ids[1:], strict=False)][::-1]
    rounds: list[int] = []
    got = run(spark, edges, local=0, rounds=rounds)
    assert got == dict.fromkeys(range(n), 0)
    assert len(rounds) <= math.log2(n) and max(rounds) <= math.log2(n) + 2
    if order != "random":
        assert len(rounds) == 1


def test_components_against_relabelling(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(500, 500 + k) for k in range(40)]
    want = plain([e for e in edges if e[0] != e[1]])
    assert run(spark, [*edges, (None, 3), (7, None)]) == want  # one task
    monkeypatch.setattr(common, "HOT", 3)  # every hub is dealt out
    assert run(spark, edges, local=0) == want
    assert run(spark, [(str(a), str(b)) for a, b in edges], "string") == plain([(str(a), str(b)) for a, b in edges if a != b])
    assert run(spark, []) == {} and run(spark, [(1, 1)]) == {}


def test_look_up_of_hot_keys(spark, monkeypatch):
    rows = common.table(spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(60)] + [(None, None)], "i long, key string"), "t")
    known = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "key string, v int")
    plain_ = sorted(map(tuple, rows.join(known, "key", "left").select("i", "key", "v").collect()), key=repr)
    for hot in (5, 2_000):
        monkeypatch.setattr(common, "HOT", hot)
        assert sorted(map(tuple, common.look_up(rows, "key", known, "i").select("i", "key", "v").collect()), key=repr) == plain_
        assert common.look_up(rows, "key", known, "i", "inner").count() == 41
