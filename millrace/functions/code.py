"""Code columns: Java-like metrics, shapes and quality scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import headers
from millrace.functions.text import CONTROL_TOKENS, OPERATORS, col, normalize_text, strip

# Types that don't count as identifiers, assertions and smells of generated tests, and the form of a signature.
COMMON_TYPES = ["String", "Integer", "Boolean", "Long", "Double", "Float", "Object", "List", "Map", "Set", "Exception"]
ASSERTIONS = ["assertEquals", "assertTrue", "assertFalse", "assertNull", "assertNotNull", "assertThrows", "assertThat", "verify"]
ASSERTION_MARKERS = ["@Test", "assert", "Assert.", "Assertions.", "assertEquals", "assertTrue", "assertFalse", "assertNotNull", "assertNull", "fail("]
SMELLS = [r"assertTrue\s*\(\s*true\s*\)", r"true\s*==\s*true", r"assertEquals\s*\(\s*1\s*,\s*1\s*\)"]
SIGNATURE = r"\b(boolean|byte|short|int|long|float|double|char|void|String|[A-Za-z_$][A-Za-z0-9_$<>.?\[\]]*)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)"


def text_lines(c: Column | str) -> Column:
    """Lines without their ends; no empty line after the last line end; none for an empty text."""
    c = F.coalesce(col(c), F.lit(""))
    whole = F.split(F.regexp_replace(c, r"\R\z", ""), r"\R", -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(whole)


def max_depth(c: Column | str, opening: str = "{", closing: str = "}") -> Column:
    """Deepest nesting; a closing brace never takes the depth below zero."""
    marks = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"[\\{opening}\\{closing}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s: Column, x: Column) -> Column:
        d = F.when(x == opening, s["d"] + 1).otherwise(F.greatest(s["d"] - 1, F.lit(0)))
        return F.struct(d.alias("d"), F.greatest(s["m"], d).alias("m"))

    return F.aggregate(marks, start, step, lambda s: s["m"])


def identifier_reuse(c: Column | str) -> Column:
    """1 less the share of distinct ones among identifiers of two letters or more."""
    names = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0))
    names = F.filter(names, lambda n: (F.length(n) > 1) & ~n.isin(*COMMON_TYPES))
    share = F.size(F.array_distinct(names)) / F.size(names).cast("double")
    return F.when(F.size(names) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share)))


def methods(c: Column | str) -> Column:
    """Array of (parameters, lines) of the methods of a code column (an Arrow function, see :mod:`millrace.functions.headers`)."""

    @F.pandas_udf("array<struct<parameters:int,lines:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"parameters": p, "lines": n} for p, n in headers.methods(t)])

    return found(col(c))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def code_metrics(c: Column | str, of: Column | None = None) -> dict[str, Column]:
    """The metrics of one code column; ``of`` are its :func:`methods`, where they are computed already."""
    of = methods(c) if of is None else of
    t = F.coalesce(col(c), F.lit(""))
    ls = text_lines(t)
    filled = F.filter(ls, lambda x: strip(x) != "")
    comment = F.filter(filled, lambda x: strip(x).rlike(r"^(//|/\*|\*)"))
    params, lengths = of["parameters"], of["lines"]
    mean = lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    sizes = F.transform(ls, lambda x: F.length(x))
    classes = F.array_except(F.regexp_extract_all(t, F.lit(r"(?U)\b[A-Z][A-Za-z0-9_]+\b"), F.lit(0)), F.array(*map(F.lit, COMMON_TYPES)))
    branches = {k: count(t, p) for k, p in {"if_count": r"\bif\s*\(", "for_count": r"\bfor\s*\(", "while_count": r"\bwhile\s*\(", "case_count": r"\bcase\b", "catch_count": r"\bcatch\s*\(", "logical_operator_count": r"&&|\|\|"}.items()}
    out = {
        "lines_of_code": F.size(ls),
        "non_empty_lines": F.size(filled),
        "comment_lines": F.size(comment),
        "method_count_proxy": F.size(params),
        "class_count_proxy": count(t, r"\bclass\s+[A-Z]\w*"),
        "import_count": count(t, r"(?m)^\s*import\s+"),
        "average_line_length": mean(sizes),
        "max_line_length": F.coalesce(F.array_max(sizes), F.lit(0)),
        "else_count": count(t, r"\belse\b"),
        "switch_count": count(t, r"\bswitch\s*\("),
        **branches,
        "complexity_proxy_score": F.lit(1) + sum(branches.values(), F.lit(0)),
        "max_brace_nesting_depth": max_depth(t),
        "dot_call_count": count(t, r"\b[a-zA-Z_]\w*\.[a-zA-Z_]\w*\s*\("),
        "new_object_count": count(t, r"\bnew\s+[A-Z][A-Za-z0-9_]*\s*\("),
        "unique_class_like_identifiers": F.size(classes),
        "method_parameter_count_avg_proxy": mean(params),
        "avg_parameter_count_proxy": mean(params),
        "local_variable_count_proxy": count(t, r"\b(?:String|int|long|double|float|boolean|var|List|Map|Set)\s+\w+\s*(?:=|;)"),
        "identifier_reuse_proxy": identifier_reuse(t),
    }
    return out | {"avg_method_length_proxy": mean(lengths), "max_method_length_proxy": F.coalesce(F.array_max(lengths), F.lit(0))}


def clip(c: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def cohesion(m: dict[str, Column]) -> Column:
    score = 10.0 - F.least(F.lit(3.0), m["avg_method_length_proxy"] / 30.0) - F.least(F.lit(2.0), m["avg_parameter_count_proxy"] / 2.0)
    score = score - F.when(m["identifier_reuse_proxy"] < 0.1, 2.0).otherwise(0.0)
    n = m["method_count_proxy"]
    return clip(score + F.when(n == 0, -2.0).when(n <= 6, 0.5).otherwise(0.0))


def coupling(m: dict[str, Column]) -> Column:
    weights = {"import_count": 0.4, "dot_call_count": 0.15, "new_object_count": 0.6, "unique_class_like_identifiers": 0.25, "avg_parameter_count_proxy": 0.8}
    return clip(sum((m[k] * w for k, w in weights.items()), F.lit(0.0)))


def health_delta(before: dict[str, Column], after: dict[str, Column], non_empty: Column, differs: Column) -> Column:
    """5, up for lower complexity, nesting and method length, down for much higher ones; 0 for no output."""
    d = lambda k: after[k] - before[k]
    steps = [("complexity_proxy_score", 1.5, 3, -2.0), ("max_brace_nesting_depth", 1.0, 1, -1.0), ("avg_method_length_proxy", 1.0, 20, -1.0)]
    score = F.lit(5.0)
    for k, better, over, worse in steps:
        score = score + F.when(d(k) < 0, better).when(d(k) > over, worse).otherwise(0.0)
    return F.when(~non_empty, 0.0).otherwise(clip(score + F.when(differs, 1.0).otherwise(-2.0)))


def refactoring_quality(non_empty: Column, differs: Column, similarity: Column, health: Column, cohesion_: Column, coupling_: Column) -> Column:
    score = F.when(differs, 1.5).otherwise(0.0) + similarity * 2.5 + health * 0.25 + cohesion_ * 0.2 + F.greatest(F.lit(0.0), 10.0 - coupling_) * 0.15
    return F.when(~non_empty, 0.0).otherwise(clip(score))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching blocks of two texts, as the standard library's difflib counts it (an Arrow function).

    Its time grows with the product of the two lengths in the worst case; it is meant for answers, not for corpora.
    """
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return ratio(normalize_text(a), normalize_text(b))


def target_method(given: Column | str, *named: Column) -> Column:
    """The first name that is given, else that of the first header in the code; null without either."""

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(headers.first_name)

    return F.coalesce(*[F.when(n != "", n) for n in named], first(col(given)))


def trivial_test(c: Column | str) -> Column:
    """Blank, a comment from the first character on, or an assertion that always holds.

    A text that begins with a line comment counts as comment to its end; one that begins with a block comment does if
    nothing or a line comment follows one of the places where a block ends.
    """
    t = F.coalesce(col(c), F.lit(""))
    bare = strip(t)
    comment = F.startswith(bare, F.lit("//")) | bare.rlike(r"(?sU)\A/\*.*\*/\s*+(?://.*)?\z")
    return (bare == "") | comment | t.rlike("|".join(SMELLS))


def test_metrics(given: Column | str, prediction: Column | str, *named: Column) -> dict[str, Column]:
    """What a generated test has, and its score from 0 to 10."""
    p = F.coalesce(col(prediction), F.lit(""))
    target = target_method(given, *named)
    asserts = sum((count(p, a + r"\s*\(") for a in ASSERTIONS), F.lit(0))
    calls = F.coalesce(F.regexp_like(p, F.concat(F.lit(r"\b\Q"), target, F.lit(r"\E\s*\("))), F.lit(False))
    m = {
        "output_non_empty": strip(p) != "",
        "contains_test_annotation": F.contains(p, F.lit("@Test")),
        "test_method_count_proxy": count(p, r"(?U)@Test|void\s+\w+\s*\("),
        "assertion_count": asserts,
        "has_assertion": asserts > 0,
        "has_exception_test": p.rlike(r"assertThrows|expected\s*=|try\s*\{|catch\s*\(|\bthrows\b"),
        "has_mocking": p.rlike(r"Mockito|mock\s*\(|when\s*\(|verify\s*\("),
        "target_method": target,
        "target_method_invocation_proxy": calls,
        "trivial_test_smell": trivial_test(p),
    }
    points = {"output_non_empty": 1.0, "contains_test_annotation": 2.0, "has_assertion": 2.0, "target_method_invocation_proxy": 2.0, "has_exception_test": 1.0, "trivial_test_smell": -3.0}
    score = sum((F.when(m[k], v).otherwise(0.0) for k, v in points.items()), F.lit(0.0))
    score = score + F.when((asserts > 1) | (m["test_method_count_proxy"] > 1), 1.0).otherwise(0.0) - F.when(m["output_non_empty"], 0.0).otherwise(5.0)
    m["generated_test_quality_score"] = m["coverage_proxy_score"] = clip(score)
    m["coverage_proxy_label"] = F.when(clip(score) >= 7, "high").when(clip(score) >= 4, "medium").when(clip(score) > 0, "low").otherwise("invalid")
    return m


def shape(c: Column | str) -> Column:
    """Struct (category, name, parameters, controls, operators) of the first Java signature, else null."""
    t = col(c)
    kind, name, params = (F.regexp_extract(t, SIGNATURE, k) for k in (1, 2, 3))
    category = (
        F.when(kind == "boolean", "boolean")
        .when(kind.isin("byte", "short", "int", "long", "float", "double"), "numeric")
        .when(kind.isin("String", "char"), "text")
        .when(kind == "void", "void")
        .otherwise("object")
    )
    controls = F.filter(F.array(*map(F.lit, CONTROL_TOKENS)), lambda w: F.regexp_like(t, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))
    operators = F.filter(F.array(*map(F.lit, OPERATORS)), lambda o: F.contains(t, o))
    whole = F.struct(category.alias("category"), F.lower(name).alias("name"), parameter_count(params).alias("parameters"), controls.alias("controls"), operators.alias("operators"))
    return F.when(t.rlike(SIGNATURE), whole)


def parameter_count(params: Column | str) -> Column:
    """Parameters of a Java list; commas inside brackets don't separate."""
    p = strip(params)
    marks = F.regexp_extract_all(p, F.lit(r"[<(\[>)\],]"), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        d = F.when(x.isin("<", "(", "["), s["d"] + 1).when(x == ",", s["d"]).otherwise(F.greatest(s["d"] - 1, F.lit(0)))
        return F.struct(d.alias("d"), (s["n"] + F.when((x == ",") & (s["d"] == 0), 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0).alias("d"), F.lit(1).alias("n"))
    return F.when(p == "", 0).otherwise(F.aggregate(marks, start, step, lambda s: s["n"]))


def shape_similarity(a: Column, b: Column) -> Column:
    def sets(x: Column, y: Column) -> Column:
        n = F.size(F.array_union(x, y))
        return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / n.cast("double"))

    score = (
        F.when(a["category"] == b["category"], 0.4).otherwise(0.0)
        + 0.3 / (1.0 + F.abs(a["parameters"] - b["parameters"]))
        + 0.15 * sets(a["controls"], b["controls"])
        + 0.15 * sets(a["operators"], b["operators"])
    )
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def name_bonus(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & (a["name"] == b["name"]), 0.2).otherwise(0.0)


def with_code_metrics(df: DataFrame, c: str, prefix: str) -> DataFrame:
    """Add the code metrics of a column, names prefixed; methods are looked for once."""
    df = df.withColumn("_methods", methods(c))
    return df.withColumns({f"{prefix}{k}": v for k, v in code_metrics(c, F.col("_methods")).items()}).drop("_methods")
