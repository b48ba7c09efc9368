import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity, text
from millrace.functions.text import WHITE
from millrace.operators import build, chunk, evaluate, govern, index, knowledge, leakage, prep, prompt, records, retrieve
from millrace.operators.filters import ContractError, specific_identity
from millrace.sources import readers, writers

RECORD = "ordinal long, domain string, input string, output string, source string, repository string, id string, context_level string, refactoring_type string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for k in range(12):
        kind = "testing" if k % 2 else "Refactoring"
        made.append((k, kind, f"int f{k}(int a) {{ return a + {k}; }}", f"int g{k}(int a) {{ return {k} + a; }}", "", f"repo{k // 4}", f"c{k}" if k else None, None, "Rename Method"))
    return spark.createDataFrame(made, RECORD)


@pytest.fixture(scope="module")
def docs(rows):
    return knowledge.documents(rows, "Set", "in.jsonl").cache()


def test_specific_identity(spark):
    cases = [("c", "", "", "", "", ""), ("", "r", "k", "f", "", ""), ("", "r", "", "f", "", ""), ("", "r", "", "", "C", "m"), ("", "r", "k", "", "C", ""), ("", "", "k", "f", "C", "m"), (None,) * 6]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, case_id string, repository string, commit string, file_path string, class_name string, method_name string")
    got = df.orderBy("k").select(specific_identity(**{c: F.col(c) for c in df.columns[1:]})).collect()
    assert [r[0] for r in got] == [True, True, False, True, False, False, False]


def test_documents_have_ids_of_their_parts(docs, rows):
    got = {r.identity.case_id: r for r in docs.collect()}
    assert set(got) == {"record-0", *(f"c{k}" for k in range(1, 12))}
    r = got["c1"]
    assert r.canonical == "set|c1|repo0||in.jsonl#record=1||" and r.document_type == "test_example" and r.source == "Set" and r.context_level == "src_fm"
    lex = [sha("int f1 ( int a ) { return a + 1 ; }"), sha("int g1 ( int a ) { return 1 + a ; }")]
    assert r.fingerprint.input_code_hash == r.fingerprint.focal_method_hash == lex[0]
    assert r.pair_id == sha("|".join(["testing", r.canonical, *lex])) and r.input_id == sha("production|" + r.input_code) and r.output_id == sha("test|" + r.output_code)
    assert r.knowledge_id == sha("|".join(["Set", "train", "in.jsonl#record=1", r.canonical, r.content_hash])) and json.loads(r.content)["domain"] == "testing"
    assert [x.relationship_type for x in r.relationships] == ["tested_by"] and got["c2"].relationships[0].target_id == got["c2"].output_id


@pytest.mark.parametrize(("column", "value"), [("domain", "other"), ("input", "  "), ("output", None)])
def test_bad_records_are_errors(rows, column, value):
    with pytest.raises(ContractError, match="the first is 3"):
        knowledge.documents(rows.withColumn(column, F.when(F.col("ordinal") == 3, F.lit(value)).otherwise(F.col(column))), "Set")


def test_context_level_is_checked(rows):
    with pytest.raises(ContractError):
        knowledge.documents(rows, "Set", context_level="src_fm_fc")


def test_collections_hold_their_documents(spark, docs):
    lit = knowledge.literature(spark.createDataFrame([("# Head\n\n" + "word " * 600, "/x/book.md")], "content string, source_file string"), "Books")
    c = knowledge.corpora(docs.where("task = 'refactoring'"), docs.where("task = 'testing'"), lit, version="2").cache()
    by = {r[0]: r[1] for r in c.groupBy("collection").count().collect()}
    assert by["refactoring_db"] == by["testing_db"] == 6 and by["mixed"] == 12 + by["literature_db"] and by["literature_db"] > 1
    t = c.where("collection = 'testing_db'").orderBy("source_uri").first()
    assert t.embedding_text.startswith("Task: test generation\n\nMethods2Test context level: src_fm\n\nProduction Java code:\nint f") and "Corresponding test code:\n" in t.content and t.chunk_type == "production_test_pair"
    assert c.where("collection = 'literature_db'").first().embedding_text.startswith("Document: book\n\n")
    with pytest.raises(ContractError):
        knowledge.corpora(docs, docs)


def test_chunk_ids_tell_sources_apart(spark):
    df = spark.createDataFrame([("u", "text of it")], "uri string, t string")
    ids = {chunk.chunk_documents(df, "uri", "t", dataset=F.lit(a), split=F.lit(b)).first().chunk_id for a in "xy" for b in "xy"}
    assert len(ids) == 4 and sha("|".join(["x", "y", "u", "0", "1", sha("text of it")])) in ids
    assert chunk.whole_documents(df, "uri", "t", dataset=F.lit("x"), split=F.lit("y")).first().chunk_id in ids


def test_java_chunks_with_fallback(spark):
    df = spark.createDataFrame([("d", "train", "A.java", "class A { int f(int a) { return a; } A() {} }"), ("d", "train", "B.java", "no code"), ("d", "train", "C.java", None)], "dataset string, split string, source_uri string, content string")
    got = {(r.source_uri, r.chunk_type): r for r in knowledge.java_chunks(df).collect()}
    assert set(got) == {("A.java", "method"), ("A.java", "constructor"), ("B.java", "whole_document_fallback"), ("C.java", "whole_document_fallback")}
    assert got["A.java", "method"].method.method_name == "f" and got["B.java", "whole_document_fallback"].content == "no code" and len({r.document_id for r in got.values()}) == 4


def test_sorted_ids_digest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("ä",)], "id string").repartition(3)
    assert index.sorted_ids_digest(df, "id") == sha("a\nb\nä")


MANIFEST = {"allowed_for_indexing": True, "usage_role": "retrieval", "dataset_name": "s"}


def test_index_run(spark, docs, tmp_path):
    def pairs(d):
        return knowledge.pair_chunks(knowledge.bind(d.where("task = 'testing'"), "testing_db"))

    twice = docs.unionAll(docs.where("task = 'testing'"))
    r = build.index_run(twice, pairs, str(tmp_path / "i"), manifest=MANIFEST)
    assert (r["loaded"], r["produced"], r["indexed"], r["duplicates"], r["fallback"]) == (18, 12, 6, 6, 0)
    assert index.collection(spark, str(tmp_path / "i"), "testing_db").count() == 6
    with pytest.raises(ContractError):
        build.index_run(docs, pairs, str(tmp_path / "j"), allowed=("val",))
    with pytest.raises(ContractError):
        build.index_run(docs, pairs, str(tmp_path / "j"), manifest=MANIFEST | {"usage_role": "benchmark"})


def test_production_build(spark, docs, tmp_path):
    bench = docs.where("identity.repository = 'repo0'")
    embed = lambda df: df.withColumn("embedding", F.array(F.length("content").cast("double"), F.lit(1.0)))
    r = build.production_build(spark, str(tmp_path / "p"), docs.where("task = 'refactoring'"), docs.where("task = 'testing'"), bench, embed, manifest=MANIFEST)
    assert r["collections"] == {"mixed": 8, "refactoring_db": 4, "testing_db": 4} and r["duplicates"] == 0
    assert r["selection"]["testing"]["by_group"] == 2 and all(x["safe"] for x in r["leakage"].values())
    t = spark.read.parquet(str(tmp_path / "p"))
    assert t.where("embedding IS NULL").count() == 0 and t.select("document_id", "embedding").distinct().count() == 8


def test_leakage_by_identity_and_classes(spark, docs):
    keys = leakage.keys(docs, "knowledge_id", knowledge.fingerprint_keys(docs))
    assert {r[0] for r in keys.select("kind").distinct().collect()} == {"input_code_hash", "focal_method_hash", "full_document_hash", "structured_identity"}
    a = spark.createDataFrame([(k, "text", "same") for k in range(100)] + [(100, "text", "own")], "id long, kind string, key string")
    b = spark.createDataFrame([(k, "text", "same") for k in range(200, 250)], "id long, kind string, key string")
    assert [tuple(r) for r in leakage.class_overlaps(a, b).collect()] == [(0, 200, 100, 50, ["text"])]


def test_prompts(spark):
    df = spark.createDataFrame([(1, "testing", "int f() {}", "Do it. ", "Do it.", "[Context 1 | id=x]\nold"), (2, "refactoring", "b", "", None, "e")], "case_id int, task string, input string, instruction string, requirements string, evidence string")
    got = {r.case_id: r for r in prompt.build(df, "multi-rag").collect()}
    whole = prompt.template("testing").replace("<CASE_REQUIREMENTS>", "Do it.").replace("<SOURCE_CODE>", "int f() {}").replace("<PROJECT_CONTEXT>", "None.")
    assert got[1].prompt == whole.replace("<EVIDENCE_CONTENT>", "[Context 1 | id=x]\nold") and got[1].full_prompt_sha256 == sha(got[1].prompt)
    assert got[1].normalized_prompt_sha256 == sha(whole.replace("<EVIDENCE_CONTENT>", "<RETRIEVED_EVIDENCE>")) and got[1].prompt_template_sha256 == sha(prompt.template("testing"))
    assert "Case requirements: None.\n\nINPUT\nb\n\nPROJECT CONTEXT\nNone.\n\nRETRIEVED EVIDENCE\ne\n\nOUTPUT REQUIREMENTS\n" in got[2].prompt
    bare = prompt.build(df, "rag").select(F.sha2(prompt.without_evidence("prompt"), 256) == F.col("normalized_prompt_sha256")).collect()
    assert all(r[0] for r in bare)
    for approach, frame in (("direct", df), ("rag", df.withColumn("evidence", F.lit(" ")))):
        with pytest.raises(Exception, match="evidence"):
            prompt.build(frame, approach).collect()
    with pytest.raises(ContractError):
        prompt.build(df, "other")


def test_fairness_audit_sees_evidence_outside_its_place(spark):
    df = spark.createDataFrame([(1, "testing", "fine"), (2, "testing", "RETRIEVED EVIDENCE\nfoo <EVIDENCE_CONTENT>")], "case_id int, task string, input string")
    assert {r.case_id: r.passed for r in prompt.audit(df).collect()} == {1: True, 2: False}


def test_contracts(spark, tmp_path):
    assert govern.stable_sha256({"b": [1, "é"], "a": None}) == sha('{"a":null,"b":[1,"é"]}')
    m = {"collection_name": "x", "dataset_manifests": ["b", "a"], "created_at": "now"}
    assert govern.manifest_id(m) == govern.manifest_id({**m, "dataset_manifests": ["a", "b"], "created_at": "then"}) != govern.manifest_id({**m, "collection_name": "y"})
    config = {"model": "m", "k": 3, "splits": ["val", "train"], "new": None}
    payload = govern.contract(config, {"generation": {"model": "model"}, "rag": {"top_k": "k", "allowed_splits": "splits"}}, {"rag": {"pool": "new"}})
    assert payload == {"generation": {"model": "m"}, "rag": {"top_k": 3, "allowed_splits": ["train", "val"]}}
    assert govern.require_fingerprint(payload, govern.stable_sha256(payload))
    with pytest.raises(ContractError, match="expected other"):
        govern.require_fingerprint(payload, "other")
    with pytest.raises(ContractError, match="lacks"):
        govern.contract({}, {"a": {"b": "c"}})
    assert govern.preflight({"a": (1, 1)})["a"]["ok"]
    with pytest.raises(ContractError, match="b: expected 1, found 2"):
        govern.preflight({"a": (1, 1), "b": (1, 2)})
    first = govern.write_run(spark, str(tmp_path), "run-1", "started", {"a": 1}, now="t1")
    second = govern.write_run(spark, str(tmp_path), "run-1", "done", {"b": 2}, now="t2")
    assert first["created_at"] == second["created_at"] == "t1" and second["updated_at"] == "t2" and second["metadata"] == {"a": 1, "b": 2}
    assert govern.run_path("/r/runs", "/r/runs/ab/x/../y") == "/r/runs/ab/y"
    for bad in ("/r/runs", "/r/other/ab", "/r/runs/../x/ab", "/r/runs/A!/x"):
        with pytest.raises(ContractError):
            govern.run_path("/r/runs", bad)


def test_smoke_cases(spark, docs):
    rules = govern.RULES
    df = spark.createDataFrame(
        [("a", "testing", "C", "f", "int f() {}", rules["testing"], "f"), ("b", "refactoring", "C", "g", "int g() {}", ["code_compiles"], None), ("c", "testing", "C", "f", " ", rules["testing"], "other"), ("c", "play", "C", "f", "x", [], None)],
        "id string, task string, class_name string, focal_method string, source_code string, rules array<string>, must_call_method string",
    )
    got = sorted((r.id, r.problem.split(":")[0]) for r in govern.smoke_problems(df).collect())
    assert got == [("b", "rules lacking"), ("c", "expects another method than the focal one"), ("c", "no source"), ("c", "repeated id"), ("c", "unknown task")]
    cases = govern.smoke_cases(df.where("id IN ('a', 'b')").unionByName(df.where("id = 'a'").withColumns({"id": F.lit("d"), "source_code": F.lit("int f1(int a) { return a + 1; } // copied")})))
    retrieval = {t: docs.where(F.col("task") == t) for t in ("testing", "refactoring")}
    r = {x.collection: x for x in govern.smoke_leakage(cases, retrieval, {"testing_db": ["testing"], "refactoring_db": ["refactoring"], "mixed": ["testing", "refactoring"]}).collect()}
    assert (r["testing_db"].overlaps, r["testing_db"].safe, r["refactoring_db"].safe, r["mixed"].indexed, r["mixed"].overlaps) == (1, False, True, 12, 1)


def test_pair_ids(spark):
    of = identity.identity(dataset=F.lit(" D "), file_path=F.lit("A\\b.java"), method_name=F.lit("M\\n"))
    r = spark.range(1).select(identity.canonical(of).alias("c"), identity.pair_id("testing", of, F.lit("int  a; // x"), F.lit("b")).alias("p")).first()
    assert r.c == "d||||a/b.java||m\\n" and r.p == sha("|".join(["testing", r.c, sha("int a ;"), sha("b")]))


def test_answers_and_repairs(spark):
    def model(prompts):
        return ['```json\n{"task_type": "testing", "analysis_summary": "s", "generated_tests": "t"}\n```' if p.startswith("Repair") or p == "good" else "no" if p == "bad" else '{"task_type": "testing"}' for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "half")], "query_id int, prompt string")
    got = {r.query_id: r for r in records.structured(df, model, "testing").collect()}
    assert [got[k].attempts for k in (1, 2, 3)] == [1, 2, 2] and all(r.answer["generated_tests"] == "t" for r in got.values())
    last = {r.query_id: r for r in records.structured(df, model, "testing", retries=0).collect()}
    assert last[2].errors == ["no JSON object"] and last[2].answer is None and len(last[3].errors) == 2 and len(last) == 3


def test_records_of_runs(spark):
    paths = spark.createDataFrame([("/a/checkpoint-9",), ("/a/checkpoint-100",), ("/a/x",)], "path string")
    assert records.latest_checkpoint(paths).first().path == "/a/checkpoint-100" and records.latest_checkpoint(paths.where("path LIKE '%x'")).count() == 0
    raw = spark.createDataFrame([(0, None, "p", "", "g"), (1, "i", " ", "o", None)], "ordinal int, sample_id string, prompt string, output string, generated_output string")
    got = records.predictions(raw, "testing", "m").orderBy("id").collect()
    assert [(r.id, r.input, r.expected_output, r.prediction, r.domain) for r in got] == [("i", "", "o", "", "testing"), ("m:testing:0", "p", "", "g", "testing")]
    m = spark.createDataFrame([("m", "i", 0.5)], "model_name string, id string, f1 double")
    assert [r.f1 for r in records.with_metrics(records.predictions(raw, "testing", "m"), m).orderBy("id").collect()] == [0.5, None]
    records.require_below(["/d/a/x.pdf"], "/d/a")
    with pytest.raises(ContractError):
        records.require_below(["/d/a/../b/x.pdf"], "/d/a")
    runs = spark.createDataFrame([(1, 1, 1, "t", "none", "success", 1.0, None), (2, 1, 2, "t", "none", "failed", None, "E")], "run_id int, attempt int, ordinal int, task string, mode string, status string, score double, error_type string")
    files = records.report_files(runs, 2, spark.createDataFrame([("a", True)], "case_id string, passed boolean"))
    assert json.loads(files["summary.json"])["status"] == {"failed": 1, "success": 1} and json.loads(files["fairness.json"])["passed"] and "| t | none | 1 | 1 |" in files["report.md"]
    table = spark.createDataFrame([("a_b", 1.0, 0.5, -0.5, -50.0)], "task string, specialised double, shared double, difference double, percent double")
    out = records.interference_report(table)
    assert out["interference.csv"].splitlines()[1] == "a_b,1.0000,0.5000,-0.5000,-50.0000" and r"a\_b & " in out["interference.tex"]


def test_prepared_splits_are_whole_groups(spark):
    long = lambda x: x * 60
    df = spark.createDataFrame([(k, long(f"a{k}"), long(f"b{k}"), f"g{k % 5}") for k in range(20)] + [(99, "short", "short", "g0")], "ordinal long, input string, output string, repo string")
    out, stats = records.prepare(df, F.col("repo"), {"train": 0.6, "val": 0.2, "test": 0.2})
    assert out.count() == 20 and out.groupBy("repo").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty() and stats.count() == 3
    mix = records.refactoring_mix({"one": df, "two": df.limit(3)})
    assert sorted(r.position for r in mix.select("position").collect()) == list(range(1, 24))


def test_hybrid_retrieval_and_cells(spark):
    sig = "Production Java code:\nint add(int a) { return a; }"
    docs = spark.createDataFrame(
        [("n1", "t", "train", "near", [1.0, 0.0], None), ("n2", "t", "train", "same name", [0.0, 1.0], "add"), ("n3", "t", "train", "far", [-1.0, 0.0], "other"), ("x", "t", "test", "held out", [1.0, 0.0], "add")],
        "document_id string, collection string, split string, content string, embedding array<double>, method_name string",
    )
    q = spark.createDataFrame([(1, sig, [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    only = retrieve.retrieve(q, docs, retrieve.Request(["t"], top_k=1, mode="single", pool=1)).collect()
    assert [r.document_id for r in only] == ["n1"]
    request = retrieve.Request(["t"], top_k=3, mode="multi", pool=1, hybrid=True)
    both = retrieve.retrieve(q, docs, request)
    assert [r.document_id for r in both.orderBy("final_rank").collect()] == ["n1", "n2"]
    t = retrieve.trace(q, docs, request, both).first()
    assert t.candidates == {"t": 2} and t.returned == 2
    cases = spark.createDataFrame([(1, "testing", "int add(int a) { return a; }")], "query_id long, task string, input string")
    embed = lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    model = lambda ps: [p[-20:] for p in ps]
    for mode in ("none", "single", "multi"):
        r = records.run_cells(cases, docs, retrieve.Request(["t"], top_k=3, mode=mode, pool=2), model, embed, "testing").first()
        assert r.status == "success" and r.within_window and ("near" in r.prompt) == (mode != "none") and r.used == ([] if mode == "none" else ["n1", "n2"])


def test_queries_are_searched_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k % 7), float(k % 3) + 1]) for k in range(60)], "document_id long, embedding array<double>")
    q = e.where("document_id < 10").withColumnRenamed("document_id", "query_id")
    whole = sorted(map(tuple, retrieve.top_k(q, e, 3).select("query_id", "document_id", "rank").collect()))
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 200)
    assert sorted(map(tuple, retrieve.top_k(q, e, 3).select("query_id", "document_id", "rank").collect())) == whole


def test_budget_of_large_groups_is_that_of_a_plain_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(g, k, rng.choice([0, 1, 2, 3, 7, 30, 90, 200])) for g in range(4) for k in range(400)]
    df = spark.createDataFrame(rows, "query_id int, final_rank int, n int").withColumn("content", F.lit(""))
    want = []
    for g in range(4):
        used = 0
        for _, k, n in [r for r in rows if r[0] == g]:
            if used + n <= 100:
                used += n
                want.append((g, k))
    got = retrieve.fit_budget(df, 100, cost=F.col("n"))
    assert sorted((r.query_id, r.final_rank) for r in got.collect()) == want


def test_white_space_list():
    assert len(set(WHITE)) == len(WHITE) and all(c.isspace() for c in WHITE)


def test_generated_java_names(spark):
    df = spark.createDataFrame([("```java\npackage a.b;\nclass X {}\npublic final class Y {}\n```",), ("class Z {}",), ("",)], "t string")
    assert [tuple(r) for r in df.select(text.class_name("t"), text.package_name("t")).collect()] == [("Y", "a.b"), ("Z", ""), ("", "")]
    assert df.select(writers.prompt_names(F.lit("a/b c-1_é"), F.lit("p"))).first()[0] == "a_b_c-1_é-" + sha("p")[:12]


def test_written_reports(spark, docs, tmp_path):
    writers.write_fingerprints(docs, str(tmp_path / "f"))
    back = spark.read.json(str(tmp_path / "f"))
    assert back.count() == 12 and set(back.columns) == {"knowledge_id", "identity", "canonical", "fingerprint"}
    writers.write_report(spark, str(tmp_path / "r.json"), {"b": 1, "a": [2]})
    assert json.loads(index.read_text(spark, str(tmp_path / "r.json"))) == {"a": [2], "b": 1}
    with pytest.raises(ContractError):
        writers.markdown_table(docs.select("task"), most=3)


def test_matrix_runs_what_is_open(spark):
    from millrace.operators import matrix

    def model(ps):
        if ps == ["boom"]:
            raise ValueError("no")
        return [p.upper() for p in ps]

    cells = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "c")], "run_id int, prompt string")
    done = spark.createDataFrame([(1, 1, 1, "success"), (2, 2, 2, "failed")], "run_id int, attempt int, ordinal int, status string")
    got = {r.run_id: r for r in matrix.run(cells, done, model, "t").collect()}
    assert set(got) == {3} and got[3].output == "C" and got[3].attempt == 1
    got = {r.run_id: r for r in matrix.run(cells, done, model, "t", force=True).collect()}
    assert got[2].status == "failed" and "no" in got[2].error and (got[1].attempt, got[2].attempt) == (2, 3)


def test_samples_and_suites(spark):
    rows = spark.createDataFrame([(f"m{k % 5}", k, "x" * 3000) for k in range(20)], "model_name string, id int, prediction string")
    got = evaluate.samples(rows).collect()
    assert [(r.model_name, r.id) for r in got] == [("m0", 0), ("m0", 5), ("m1", 1), ("m1", 6), ("m2", 2), ("m2", 7)] and all(len(r.prediction) == 2000 for r in got)
    suite = [(f"{t}{d}{k}", t, d, f"int f{t}{d}{k}() {{}}") for t in ("testing", "refactoring") for d in ("easy", "medium", "hard") for k in range(4)]
    kinds = "id string, task string, difficulty string, source_code string"
    assert govern.smoke_suite(spark.createDataFrame(suite, kinds)) == []
    assert len(govern.smoke_suite(spark.createDataFrame([*suite[1:], suite[5]], kinds))) == 4


def test_storage_members_and_keys(spark):
    df = spark.createDataFrame([("z", m, m) for m in ("p/output/b/storage/x/A.java", "p/output/a/storage/x/B.java", "p/output/a/other/C.java", "D.java")], "archive string, member string, content string")
    assert [(r.member, r.file) for r in readers.storage_members(df).collect()] == [("p/output/a/storage/x/B.java", "x/B.java")]
    readers.require_keys({"a": {"b": None}}, ("a.b", "a"))
    with pytest.raises(ContractError, match="a.c, d"):
        readers.require_keys({"a": {"b": 1}}, ("a.c", "a.b", "d"))
    key = prep.group_key("commit", required=True, repository=F.col("archive"), commit=F.lit(" "))
    assert df.select(key).first()[0] == ["z"]
    with pytest.raises(Exception, match="without any part"):
        df.select(prep.group_key("repository", required=True, repository=F.lit(" "))).collect()
