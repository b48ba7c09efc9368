import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators.filters import ContractError
from millrace.sources import readers, writers
from millrace.streaming import runs


def test_jsonl_and_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": "1"}\n\n[1]\nbroken\n{"x": "2"}\n')
    good, bad = readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "x string")
    assert sorted(r.x for r in good.collect()) == ["1", "2"] and sorted(r.value for r in bad.collect()) == ["[1]", "broken"]


def test_json_shapes(spark, tmp_path):
    for name, payload in {"list": [{"x": "1"}, {"x": "2"}], "dict": {"n": 1, "rows": [{"x": "3"}]}, "one": {"x": "4"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload))
    got = {n: [r.x for r in readers.records(spark, str(tmp_path / f"{n}.json"), "x string").orderBy("ordinal").collect()] for n in ("list", "dict", "one")}
    assert got == {"list": ["1", "2"], "dict": ["3"], "one": ["4"]}
    with pytest.raises(ContractError):
        readers.records(spark, "x.parquet")


def test_csv_values_are_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"""\n')
    r = readers.records(spark, str(tmp_path / "a.csv")).first()
    assert (r.a, r.b) == ("1", 'x "y"')


def test_grouped_records(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Extract Method": [{"id": "1"}], "Move": [{"id": "2"}, {"id": "3"}]}))
    assert sorted((r.group, r.id) for r in readers.grouped_records(spark, str(tmp_path / "m.json"), "id string").collect()) == [("Extract Method", "1"), ("Move", "2"), ("Move", "3")]


def test_zip_pairs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for name, data in {"s/c1/before/A.java": "old", "s/c1/after/A.java": "new", "s/c1/before/B.java": "gone"}.items():
            z.writestr(name, data)
    got = readers.before_after(readers.zip_members(spark, str(tmp_path), ".java")).collect()
    assert [(r.commit, r.file, r.before, r.after) for r in got] == [("c1", "A.java", "old", "new")]


def test_benchmarks(spark, tmp_path):
    (tmp_path / "x_out.json").write_text(json.dumps([{"project_name": "my proj", "class_name": "A", "method_name": "f", "source_code": "code"}]))
    assert readers.benchmark(spark, "unit-tests", str(tmp_path)).first().case_id == "testbench:my-proj:A:f:0"
    (tmp_path / "y_out.json").write_text(json.dumps([{"class_name": " ", "source_code": " s ", "full_context": "c"}]))
    r = readers.benchmark(spark, "unit-tests", str(tmp_path / "."), level="full").where("source_file LIKE '%y_out%'").first()
    assert r.case_id == "testbench:y:unknown:method:0" and r.input == "Target package: \nTarget class: \nTarget method: \n\nJava source under test:\ns\n\nFull project context:\nc"
    rows = [{"isPureRefactoring": False}, {"isPureRefactoring": True, "uniqueId": " ", "sourceCodeBeforeForWhole": " w ", "type": "Move Method"}, {"isPureRefactoring": True, "uniqueId": "u", "sourceCodeBeforeRefactoring": "m"}]
    (tmp_path / "pure.json").write_text(json.dumps(rows))
    got = {r.case_id: r for r in readers.benchmark(spark, "refactorings", str(tmp_path / "pure.json")).collect()}
    assert set(got) == {"swe-refactor:1", "swe-refactor:u"} and got["swe-refactor:1"].input == "w" and got["swe-refactor:1"].whole_file and "type: Move Method. Return" in got["swe-refactor:1"].instruction
    assert got["swe-refactor:u"].refactoring_type == "unspecified refactoring" and not got["swe-refactor:u"].whole_file
    (tmp_path / "r.json").write_text(json.dumps([{"uniqueId": "1", "sourceCodeBeforeRefactoring": " ", "sourceCodeBeforeForWhole": "w", "isPureRefactoring": True}, {"uniqueId": "2", "isPureRefactoring": False}]))
    got = readers.benchmark(spark, "refactorings", str(tmp_path / "r.json")).collect()
    assert [(r.case_id, r.input, r.whole_file) for r in got] == [("swe-refactor:1", "w", True)]


def test_adapters(spark, tmp_path):
    import numpy as np

    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.ones((4, 2), "<f4")
    head, data = {}, b""
    for k, m in (("model.layers.3.q_proj.lora_A.weight", a), ("model.layers.3.q_proj.lora_B.weight", b)):
        head[k] = {"dtype": "F32", "shape": list(m.shape), "data_offsets": [len(data), len(data) + m.nbytes]}
        data += m.tobytes()
    h = json.dumps(head).encode()
    (tmp_path / "x.safetensors").write_bytes(len(h).to_bytes(8, "little") + h + data)
    r = readers.adapter_matrices(spark, str(tmp_path)).first()
    assert (r.module_key, r.layer, r.lora_a, len(r.lora_b)) == ("layers.3.q_proj", 3, a.tolist(), 4)


def test_flat_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, "x"), [1, 2])], "z int, s struct<b:int,a:string>, l array<int>")
    assert writers.flatten(df).columns == ["l", "s.a", "s.b", "z"]
    writers.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["l"] == "[1,2]"
    assert "| z |" in writers.markdown_table(df.select("z"))


def test_stream_keeps_the_latest_attempt(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *x: spark.createDataFrame(list(x), "run_id string, attempt int, ordinal int, status string")
    rows(("a", 1, 1, "failed"), ("b", 1, 2, "success")).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("run_id string, attempt int, ordinal int, status string").parquet(str(src))
    go = lambda: runs.merge_latest(stream, str(tmp_path / "out"), ["run_id"], "attempt", "ordinal").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    go()
    rows(("a", 2, 3, "success")).write.mode("append").parquet(str(src))
    go()
    got = spark.read.parquet(str(tmp_path / "out" / "a"))
    assert {r.run_id: r.status for r in got.collect()} == {"a": "success", "b": "success"}


def test_stream_first_seen(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "h string, t int").select("h", F.timestamp_seconds("t").alias("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("h string, ts timestamp").parquet(str(src))
    q = runs.first_seen(stream, "h", "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
