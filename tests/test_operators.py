import pytest
from pyspark.sql import functions as F

from millrace.operators import chunk, evaluate, filters, index, leakage, matrix, prep, retrieve
from millrace.operators.filters import ContractError


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


HITS = "query_id long, collection string, rank int, document_id string, content string, score double, pair string"


def test_fusion_joins_copies_transitively(spark):
    rows = [(1, "t", 1, "A", "a", 0.9, "p1"), (1, "r", 1, "other", "o", 0.8, None), (1, "r", 2, "B", "b", 0.7, "p1")]
    df = spark.createDataFrame(rows, HITS).withColumnRenamed("pair", "refactoring_pair_id")
    got = {r.document_id: r for r in retrieve.fuse(df, keys=["refactoring_pair_id"]).collect()}
    assert set(got) == {"A", "other"} and got["A"].before == 3
    assert got["A"].rrf_score == pytest.approx(1 / 61 + 1 / 62) and got["A"].final_rank == 1


def test_fusion_counts_a_collection_once(spark):
    rows = [(1, "t", 1, "A", "a", 0.9, "p"), (1, "t", 2, "B", "b", 0.8, "p")]
    r = retrieve.fuse(spark.createDataFrame(rows, HITS), keys=["pair"]).collect()
    assert len(r) == 1 and r[0].rrf_score == pytest.approx(1 / 61)


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate([40, 100, 9, 4])], "query_id long, final_rank int, n int")
    got = retrieve.fit_budget(df.withColumn("content", F.lit("")), 53, cost=F.col("n")).orderBy("final_rank").collect()
    assert [r.tokens for r in got] == [40, 9, 4]


def test_first_wins_is_not_transitive(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["c"])], "query_id long, rank int, k array<string>")
    got = retrieve.dedup_hits(df, ["query_id"], [F.col("rank")], F.col("k")).collect()
    assert sorted(r.rank for r in got) == [1, 3]


def test_document_cap_and_pairs():
    assert retrieve.shorten("x" * 80, 5) == ("x" * 20, False)
    content = "Original Java code:\n" + "a" * 400 + "\n\nRefactored Java code:\n" + "b" * 400
    cut, paired = retrieve.shorten(content, 60)
    assert paired and retrieve.tokens_of(cut) <= 60 and "Refactored Java code:" in cut and "aaaa" in cut and "bbbb" in cut
    assert retrieve.shorten(content, 5) == ("", True)


@pytest.mark.parametrize("budget", [10, 60, 150, 400])
def test_context_never_exceeds_the_budget(spark, budget):
    docs = [(1, k, f"d{k}", "w" * (100 * k)) for k in range(1, 6)]
    df = spark.createDataFrame(docs, "query_id long, final_rank int, document_id string, content string")
    got = retrieve.select_context(df, 100, 4096, 1024, budget=budget, document_cap=80).collect()
    assert sum(r.tokens for r in got) <= budget and len(got) == 5


def test_top_k_is_limited_before_the_shuffle(spark):
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "document_id long, embedding array<float>")
    q = e.where("document_id < 2").withColumnRenamed("document_id", "query_id")
    got = retrieve.top_k(q, e, 3)
    assert "WindowGroupLimit" in plan_of(got) and got.count() == 6


def test_rerank_uses_the_input_side_only(spark):
    rows = [
        (1, "stuffed", "class X { void other(int a) }\n\nCorresponding test code:\nparseOrder parseOrder", 0.91, "Production Java code:\npublic int parseOrder(String s)"),
        (1, "relevant", "public int parseOrder(String raw)\n\nCorresponding test code:\nx", 0.86, "Production Java code:\npublic int parseOrder(String s)"),
    ]
    df = spark.createDataFrame(rows, "query_id long, document_id string, content string, score double, query string")
    assert retrieve.rerank(df).orderBy("final_rank").first().document_id == "relevant"


def test_leakage_makes_no_nested_loop_and_finds_all_kinds(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "z", None)], "id long, a string, b string")
    kinds = {"a": F.col("a"), "b": F.col("b")}
    got = leakage.overlaps(leakage.keys(df, "id", kinds), leakage.keys(spark.createDataFrame([(9, "y", "p")], df.schema), "id", kinds))
    assert "NestedLoop" not in plan_of(got)
    assert {(r.indexed_id, tuple(r.matched_by)) for r in got.collect()} == {(1, ("b",)), (2, ("a",))}


def test_disjoint_selection_counts_each_stage(spark):
    df = spark.createDataFrame([(1, "g1", "x"), (2, "g2", "y"), (3, "g3", "z"), (4, None, "w")], "id long, g string, k string")
    bench = spark.createDataFrame([(9, "g1", "y")], df.schema)
    out, by_group, by_key = leakage.disjoint(df, bench, "id", F.col("g"), {"k": F.col("k")})
    assert (sorted(r.id for r in out.collect()), by_group, by_key) == ([3, 4], 1, 1)
    with pytest.raises(ContractError):
        leakage.disjoint(df.where("id = 1"), bench, "id", F.col("g"), {"k": F.col("k")})


def test_metadata_predicate_guards_splits():
    with pytest.raises(ContractError):
        filters.metadata_predicate({"split": "test"}, ["train"])
    with pytest.raises(ContractError):
        filters.metadata_predicate({"x": []}, ["train"])
    with pytest.raises(ContractError):
        filters.metadata_predicate({}, [])


def test_ratio_split_sizes_do_not_depend_on_partitions(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in prep.ratio_split(df, "k").collect()}
    b = {r.k: r.split for r in prep.ratio_split(df.repartition(7), "k").collect()}
    sizes = [list(a.values()).count(s) for s in ("train", "val", "test")]
    assert a == b and sizes == [82, 10, 11]


def test_group_splits(spark):
    df = spark.createDataFrame([(g * 10 + k, f"g{g}") for g in range(6) for k in range(g + 1)], "id long, g string")
    got = prep.group_split_by_ratio(df, "g", {"train": 0.6, "test": 0.4})
    leakage.require_disjoint(got, "g", "split")
    assert got.count() == df.count()
    exact = prep.group_split_by_size(df, "g", "id", {"train": 9, "test": 6})
    assert {r[0]: r[1] for r in exact.groupBy("split").count().collect()} == {"train": 9, "test": 6}
    with pytest.raises(ContractError):
        prep.group_split_by_size(df, "g", "id", {"train": 100, "test": 6})


def test_group_key(spark):
    df = spark.createDataFrame([(None, " R ", "c1"), (None, None, None)], "project string, repo string, commit string")
    got = df.select(prep.group_key("commit", project=F.col("project"), repo=F.col("repo"), commit=F.col("commit"))).collect()
    assert [r[0] for r in got] == [["r", "c1"], None]


def test_first_valid_counts_what_it_looked_at(spark):
    df = spark.range(10)
    top, looked = prep.first_valid(df, F.col("id") % 3 == 2, "id", 2)
    assert [r.id for r in top.orderBy("id").collect()] == [2, 5] and looked == 6


def test_votes(spark):
    df = spark.createDataFrame([('[1, {"vote": 2}, {"label": -1}, "x", {"other": 5}]',), ("{}",)], "j string").select(F.parse_json("j").alias("v"))
    assert df.select(prep.votes("v")).first()[0] == [1, 2, -1]


def test_training_example(spark):
    df = spark.createDataFrame([([1, 2, 3], [7, 8]), ([1], []), ([1], [5, 6, 7, 8, 9])], "p array<long>, o array<long>")
    a, b, c = (r[0] for r in df.select(prep.training_example("p", "o", 4)).collect())
    assert (a.input_ids, a.labels) == ([2, 3, 7, 8], [-100, -100, 7, 8]) and b is None and c.input_ids == [5, 6, 7, 8]


def test_prose_chunks(spark):
    t = "# Title\nintro\n\n" + "a" * 150 + "\n\n" + "b" * 500 + "\n\nend"
    got = spark.createDataFrame([(1, t)], "id long, t string").select(chunk.prose_chunks("t", 200)).first()[0]
    assert max(map(len, got)) <= 200 and "".join(got).count("b") == 500 and got[0].startswith("# Title") and got[-1] == "end"


def test_pages(spark):
    pages = [(1, k, f"Report 2024 page {k}\nSome text that is hyphen-\nated here\n\nnext part\nACME Inc.") for k in range(3)]
    got = chunk.clean_pages(spark.createDataFrame(pages, "doc_id long, page int, text string")).orderBy("page").collect()
    assert got[0].text == "Some text that is hyphenated here\n\nnext part"


def test_java_signature(spark):
    src = "class A {\n  @Override\n  public int f(String a, final int b) throws E {\n  }\n}"
    s = spark.createDataFrame([(src,)], "c string").select(chunk.java_signature("c")).first()[0]
    assert (s.method_name, s.return_type, s.class_name, s.parameter_types) == ("f", "int", "A", ["String", "final int"])


def test_latest_and_resume(spark):
    runs = spark.createDataFrame([("a", 1, 1, "failed"), ("a", 2, 2, "success"), ("b", 1, 3, "success"), ("b", 1, 4, "failed")], "run_id string, attempt int, ordinal int, status string")
    assert {r.run_id: r.status for r in matrix.latest(runs).collect()} == {"a": "success", "b": "failed"}
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    go = lambda **o: {r.run_id: r.runs for r in matrix.plan(cells, runs, **o).collect()}
    assert go() == {"a": False, "b": False, "c": True} and go(retry_failed=True) == {"a": False, "b": True, "c": False} and all(go(force=True).values())


def test_case_pivot(spark):
    runs = spark.createDataFrame([("x", "m1", "success", 1.0), ("x", "m2", "success", 1.0), ("y", "m2", "failed", None)], "case_id string, mode string, status string, score double")
    got = {r.case_id: r for r in evaluate.case_pivot(runs, ["m1", "m2"]).collect()}
    assert got["x"].best_mode == "m1" and got["y"].m1_status == "not_run" and got["y"].best_mode == ""


def test_index_roundtrip(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, content string")
    one = index.rebuild(df, path, "one", {"embedding_model": "m"})
    index.rebuild(df.where("document_id = 1"), path, "two", {})
    assert one["count"] == 2 and index.collection(spark, path, "one").count() == 2
    index.rebuild(df, path, "two", {})
    assert index.collection(spark, path, "one").count() == 2 and index.read_manifest(spark, path, "two")["count"] == 2
    with pytest.raises(ContractError):
        index.collection(spark, path, "three")
    with pytest.raises(ContractError):
        index.require_compatible({"embedding_model": "a"}, {"embedding_model": "b"})


def test_upsert_and_digest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    got = index.upsert(old, new, "id")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert index.corpus_digest(got, "id") == index.corpus_digest(got.repartition(5), "id") != index.corpus_digest(old, "id")


def test_retrieve_end_to_end(spark):
    docs = spark.createDataFrame([("d1", "t", "train", "x", [1.0, 0.0]), ("d2", "r", "train", "y", [0.9, 0.1]), ("d3", "r", "test", "z", [1.0, 0.0])], "document_id string, collection string, split string, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    got = retrieve.retrieve(q, docs, retrieve.Request(["t", "r"], top_k=2, budget=10)).collect()
    assert {r.document_id for r in got} == {"d1", "d2"}
    assert retrieve.retrieve(q, docs, retrieve.Request([], mode="none")).count() == 0
    with pytest.raises(ContractError):
        retrieve.Request(["t", "t"])


def test_failed_generation_is_a_row(spark):
    def model(xs):
        if xs[0] == "bad":
            raise ValueError("no")
        return [xs[0].upper()]

    got = {r.prompt: r for r in retrieve.generate(spark.createDataFrame([("a",), ("bad",)], "prompt string"), model).collect()}
    assert got["a"].output == "A" and got["bad"].status == "failed" and "ValueError" in got["bad"].error
