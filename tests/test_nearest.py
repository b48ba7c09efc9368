"""The blocked search gives what the plain expression gives, and no query falls back to comparing row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.operators import nearest, retrieve
from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(q, docs, k, by, score):
    f = {"cosine": vector.cosine, "l2": lambda a, b: -vector.l2(a, b)}[score]
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "document_id")
    q = q.select("query_id", F.col("embedding").alias("_q")).where("_q IS NOT NULL")
    out = docs.crossJoin(q).select("query_id", *by, "document_id", F.round(f("_q", "embedding"), 9).alias("score"))
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("score", -F.col("score")) if score == "l2" else out


def shown(df):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x) for x in r) for r in df.collect())


def odd_vector(rng):
    few = [None, [1.0, None, 2.0], [float("nan"), 1.0, 0.5], [float("inf"), 1.0, 0.5], [1e200, 1e180, -1e190], [0.0] * 3, [0.0] * 2, [0.3, 0.4], [], [1.0, 2.0, 3.0], [1e-200, 0.0, 1e-190]]
    if rng.random() < 0.5:
        return rng.choice(few)
    return [float(rng.randint(-2, 2)) for _ in range(3)] if rng.random() < 0.5 else [rng.gauss(0, 1) for _ in range(3)]


@pytest.mark.parametrize("score", ["cosine", "l2"])
def test_blocks_give_what_the_expression_gives(spark, monkeypatch, score):
    rng = random.Random(5)
    docs = spark.createDataFrame([(f"d{k:03d}", rng.choice(["a", "b", None]), odd_vector(rng)) for k in range(150)], "document_id string, label string, embedding array<double>").cache()
    q = spark.createDataFrame([(k, odd_vector(rng)) for k in range(30)], "query_id long, embedding array<double>").cache()
    for block, by, k in ((16384, [], 4), (7, ["label"], 30)):
        monkeypatch.setattr(nearest, "BLOCK", block)
        assert shown(retrieve.top_k(q, docs, k, by, score=score)) == shown(plain(q, docs, k, by, score))


def test_copies_are_compared_once(monkeypatch):
    """However many rows hold one vector, only k of them meet a query, and the smallest ids win."""
    import pyarrow as pa

    met = []
    pairs = nearest.pair_scores
    monkeypatch.setattr(nearest, "pair_scores", lambda q, d, i, j, score: met.append(len(i)) or pairs(q, d, i, j, score))
    docs = pa.table({"document_id": list(range(5000))[::-1], "_v": pa.array([[1.0, 2.0]] * 5000)})
    q = nearest.Queries(pa.array(list(range(100))), pa.array([[1.0, 1.0]] * 100))
    out = pa.Table.from_batches(nearest.search(iter(docs.to_batches()), q, 3, "cosine"))
    assert out.num_rows == 300 and set(out.column("document_id").to_pylist()) == {0, 1, 2} and sum(met) == 3


def test_rounding_is_half_up_on_digits(spark):
    rng = random.Random(6)
    xs = [0.0, -1e-12, 0.1234567885, 0.1234567895, -0.1234567885, 0.9999999995, 1.0000000005, 123456.7890123455, 1e13 + 0.5, 1e300, float("inf"), *[rng.randint(-(10**10), 10**10) / 1e10 for _ in range(500)]]
    want = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(F.round("x", 9)).collect()]
    assert nearest.rounded(np.array(xs)).tolist() == want


def test_fusion_needs_no_texts(spark):
    """Identities in place of contents give the same, and hits of a query go through Python as one row."""
    from millrace.functions import text

    rng = random.Random(8)
    rows = [(q, c, r, f"d{rng.randint(0, 9)}", f"text {rng.randint(0, 6)} ", round(rng.random(), 2)) for q in range(6) for c in "abc" for r in range(1, 6)]
    hits = spark.createDataFrame(rows, "query_id int, collection string, rank int, document_id string, content string, score double")
    given = hits.withColumn("identity", text.content_identity("content")).drop("content")
    assert shown(retrieve.fuse(given, identity="identity")) == shown(retrieve.fuse(hits))
    assert "FlatMapGroups" not in retrieve.fuse(hits)._jdf.queryExecution().executedPlan().toString()


def test_budget_of_whole_rows(spark):
    rng = random.Random(9)
    rows = [(g, k, rng.choice([0, 1, 3, 20, 60, 200])) for g in range(9) for k in range(30)]
    df = spark.createDataFrame(rows, "query_id int, final_rank int, n int")
    one = retrieve.fit_budget(df, 100, cost=F.col("n"), whole=True)
    assert shown(one) == shown(retrieve.fit_budget(df, 100, cost=F.col("n"))) and len(one.columns) == 4


def test_flagship_searches_once(spark):
    plan = catalogue.QUERIES["flagship_retrieval"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


#: Queries that search vectors.
SEARCHES = ["vector_topk", "l2_topk", "collection_topk", "metadata_filter_topk", "rrf_fusion", "flagship_retrieval", "rrf_no_overlap", "used_in_prompt", "context_render", "context_selection"]


@pytest.mark.parametrize("name", SEARCHES)
def test_no_search_is_row_by_row(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
