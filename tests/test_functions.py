from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from millrace.functions import code, text, vector


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column("c").alias("r")).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [(None, ""), ("", ""), (" a\t\n b ", "a b"), ("x y z", "x y z")],
)
def test_normalize_text(spark, given, want):
    assert one(spark, given, text.normalize_text) == want


def test_content_hash_ignores_line_ends_and_trailing_blanks(spark):
    assert one(spark, "a  \r\nb\t\r\n", text.content_hash) == one(spark, "a\nb", text.content_hash)
    assert one(spark, "a\n\nb", text.content_hash) != one(spark, "a\nb", text.content_hash)


def test_java_fingerprint_drops_comments_and_keeps_literals(spark):
    src = 'int a=1; // note\nString s = "x // y /* z */"; /* gone\n */ char c = \'\\\'\';'
    assert one(spark, src, text.java_fingerprint) == 'int a = 1 ; String s = "x // y /* z */" ; char c = \'\\\'\' ;'


def test_java_fingerprint_survives_a_very_long_literal(spark):
    assert len(one(spark, '"' + "a\\\\" * 100_000 + '"', text.java_fingerprint)) == 300_002


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("a", "", 0.0), ("a b", "a", 2 / 3), ("A a", "a", 1.0), ("x", "y", 0.0)])
def test_token_f1(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.token_f1("a", "b")).first()[0] == pytest.approx(want)


def test_semantic_tokens(spark):
    assert sorted(one(spark, "public class OrderItemTest { get_price(x) }", text.semantic_tokens)) == ["get", "item", "order", "price"]


def test_markers_take_the_first_occurrence(spark):
    assert one(spark, "pre Original Java code:\na Original Java code:\nb", lambda c: text.after_first(c, text.QUERY_MARKERS)) == "a Original Java code:\nb"
    assert one(spark, "x\n\nRefactored Java code:\ny", lambda c: text.before_first(c, text.EVIDENCE_MARKERS)) == "x"


@pytest.mark.parametrize(("params", "want"), [("", 0), ("Function<String, Integer> function", 1), ("String name, Map<String, Integer> values", 2), ("int[] a, Map<A, List<B, C>> m, int c", 3)])
def test_parameter_count(spark, params, want):
    assert one(spark, params, code.parameter_count) == want


@pytest.mark.parametrize(("src", "want"), [(None, 0), ("{{}{}}", 2), ("}}{", 1), ("{" * 5, 5)])
def test_max_depth(spark, src, want):
    assert one(spark, src, code.max_depth) == want


@pytest.mark.parametrize("src", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n"])
def test_text_lines_match_splitlines(spark, src):
    assert one(spark, src, code.text_lines) == src.splitlines()


def test_method_lengths_and_parameters(spark):
    src = "public int f(int a, int b) {\n  do {\n }\n return 1;\n}\n\nprivate void g() {\n}\n"
    assert [tuple(m) for m in one(spark, src, code.methods)] == [(2, 5), (0, 4)]  # white space before a header is part of its match


def test_edit_similarity_is_difflibs(spark):
    a, b = "public void run() { go(); }", "public int run(int x) { return go(x); }"
    got = spark.createDataFrame([(a, b)], "a string, b string").select(code.edit_similarity("a", "b")).first()[0]
    assert got == SequenceMatcher(None, a, b).ratio()


def test_test_metrics(spark):
    df = spark.createDataFrame([("public int add(int a, int b) {", "@Test void t() { assertEquals(3, add(1, 2)); assertTrue(x); }"), ("", "")], "i string, p string")
    rows = df.select(*[c.alias(k) for k, c in code.test_metrics("i", "p").items()]).collect()
    assert (rows[0]["target_method"], rows[0]["generated_test_quality_score"], rows[0]["coverage_proxy_label"]) == ("add", 8.0, "high")
    assert (rows[1]["generated_test_quality_score"], rows[1]["coverage_proxy_label"], rows[1]["trivial_test_smell"]) == (0.0, "invalid", True)


def test_shape(spark):
    s = one(spark, "public boolean isOk(List<A, B> x) { if (x == null) return false; }", code.shape)
    assert (s.category, s.name, s.parameters, s.controls) == ("boolean", "isok", 1, ["if"])
    assert one(spark, "no signature", code.shape) is None


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vector.cosine("a", "b"), vector.cosine("a", "z"), vector.l2("a", "b"), vector.norm("b")).first()
    assert r[0] == pytest.approx(0.5**0.5) and r[1] == 0.0 and r[2] == 1.0 and r[3] == pytest.approx(2**0.5)


def test_hashed_embedding_matches_the_driver_side(spark):
    t = "The quick brown fox_1 jumps 42 times, the end"
    assert one(spark, t, vector.hashed_embedding) == pytest.approx(vector.embed_query(t))
    assert one(spark, "", vector.hashed_embedding) == [0.0] * 64


def test_paths_and_status(spark):
    assert one(spark, "app\\src/main/java/a/B.java", text.test_directory) == "app/src/test/java/a"
    assert one(spark, "../src/main/java/B.java", text.test_directory) is None
    assert one(spark, "Failures: 2", lambda c: text.process_status(F.lit(1), c)) == "test_error"
    assert one(spark, "password = hunter2, x", text.redact) == "password = [REDACTED], x"
    assert one(spark, "```java\nint a;\n```", text.strip_fence) == "int a;"
    assert one(spark, "Test Generation", text.resolve_task) == "testing"
