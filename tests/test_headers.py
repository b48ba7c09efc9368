import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import code, headers, javasource, text

METHOD = re.compile(r"(?:public|private|protected|static|final|synchronized|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\(([^)]*)\)\s*\{")
TARGET = re.compile(r"(?:public|private|protected|static|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\(")


def plain(t):
    """Parameters and lines of each method by the regular expression and a scan for the closing brace."""
    out = []
    for m in METHOD.finditer(t):
        depth, stop = 0, None
        for k in range(m.start(), len(t)):
            depth += (t[k] == "{") - (t[k] == "}")
            if t[k] == "}" and depth == 0:
                stop = k
                break
        out.append((sum(1 for p in m.group(2).split(",") if p.strip()), 1 if stop is None else max(1, t.count("\n", m.start(), stop) + 1)))
    return out


def samples(n):
    rng = random.Random(5)
    words = ["public", "static", "privateint", "int", "x", "foo", "(", ")", "{", "}", "(", ") {", " ", "  ", "\n", "\t", ";", ",", "<T>", "()", "if (a) {", "xpublic"]
    return ["".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(n)]


def test_headers_are_those_of_the_expression():
    for t in samples(20_000):
        assert headers.methods(t) == plain(t), repr(t)
        found = TARGET.search(t)
        assert headers.first_name(t) == (found.group(1) if found else None), repr(t)


@pytest.mark.parametrize("t", ["public" + " " * 100_000 + "x", "public " * 30_000 + "(", "f(" * 50_000, "public void f() {" * 5_000, "\n" * 100_000 + "void f() {\n}"])
def test_headers_take_linear_time(t):
    start = time.time()
    headers.methods(t), headers.first_name(t)
    assert time.time() - start < 5


def test_long_runs_of_blanks(spark):
    df = spark.createDataFrame([("a" + " " * 100_000 + "b" + "\n\t ",), ("  x ",)], "t string")
    start = time.time()
    got = [r[0] for r in df.select(text.strip("t")).collect()]
    assert got == ["a" + " " * 100_000 + "b", "x"] and time.time() - start < 20
    assert df.select(F.length(text.normalize_content("t"))).first()[0] == 100_002 and time.time() - start < 40


def test_trivial_tests(spark):
    def rule(t):
        bare = t.strip()
        return not bare or bool(re.fullmatch(r"(?s)(//.*|\s|/\*.*\*/)*", bare)) or any(re.search(p, t) for p in code.SMELLS)

    cases = ["", " \n", "// x\nassertEquals(2, f());", "/* a */ // b\nfoo();", "/* a */ foo();", "/* a */ foo(); /* b */", "foo(); // x", "/* a", "/*/", "x /* a */", "assertTrue( true )", "foo();"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    assert [r[0] for r in df.orderBy("k").select(code.trivial_test("c")).collect()] == [rule(c) for c in cases]


JAVA = """package a.b;
import java.util.List;

/** Doc of {the class}. */
public class Shop<T> extends Base {
    private final String sign = "} { (";
    int[] sizes = {1, 2};

    // says hello
    /* twice */
    @Override
    public static <K> List<K> greet(final Map<String, Integer> names, int n) throws Exception {
        if (n > 0) { return null; } // }
        return null;
    }

    Shop(String x) {}

    abstract void later();

    enum Kind { A, B { int f() { return 1; } }; int size() { return 2; } }
}
"""


def test_java_methods_in_context():
    s = javasource.read(JAVA)
    assert s.package_name == "a.b" and s.imports == ["import java.util.List;"] and not s.failure
    by = {(m.class_name, m.method_name): m for m in s.methods}
    assert set(by) == {("Shop", "greet"), ("Shop", "Shop"), ("Shop", "later"), ("Kind", "size")}
    g = by["Shop", "greet"]
    assert g.return_type == "List<K>" and g.parameter_types == ["Map<String, Integer>", "int"] and g.annotations == ["@Override"]
    assert JAVA.split("\n")[g.start_line - 1].strip() == "@Override" and JAVA.split("\n")[g.end_line - 1].strip() == "}"
    assert g.content.startswith("package a.b;\nimport java.util.List;\n") and "// says hello\n    /* twice */" in g.content and 'String sign = "} { (";' in g.content
    assert "int[] sizes = {1, 2};" in g.content and "later" not in g.content and g.content.endswith("}\n}")
    assert by["Shop", "Shop"].return_type == "" and by["Shop", "Shop"].parameter_types == ["String"]


@pytest.mark.parametrize(("t", "why"), [("class A { void f( }", "Braces don't match."), ("int x;", "No method or constructor declaration found."), ("", "No method or constructor declaration found."), (None, "No method or constructor declaration found.")])
def test_sources_without_methods(t, why):
    assert javasource.read(t).failure == why
