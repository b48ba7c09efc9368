"""Chunks of prose and code, and pages put back into prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import boundary_key, col, content_hash, joined_hash, strip

#: Fixed value: the form of a method's head.
METHOD_HEAD = (
    r"(?m)^\s*(?:@[A-Za-z_$][A-Za-z0-9_$.]*(?:\([^\n]*\))?\s*)*"
    r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|default)\s+)*"
    r"([A-Za-z_$][A-Za-z0-9_$<>,.?\[\] ]*)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)\s*(?:throws\s+[^\{]+)?\{"
)


def prose_chunks(c: Column | str, most: int = 1800) -> Column:
    """Array of chunks: paragraphs and headings packed greedily to ``most`` characters, longer ones cut hard."""
    if most < 200:
        raise ValueError("chunks need at least 200 characters")
    units = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\n\s*\n|(?m)(?=^#{1,6}\s)"), strip), lambda u: u != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, u: Column) -> Column:
        flush = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(u) - 1) / most).cast("int")), lambda k: F.substr(u, k * most + 1, F.lit(most)))
        return (
            F.when(F.length(u) > most, F.struct(F.concat(flush, cut).alias("done"), F.lit("").alias("open")))
            .when(s["open"] == "", F.struct(s["done"].alias("done"), u.alias("open")))
            .when(F.length(s["open"]) + F.length(u) + 2 <= most, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n\n"), u).alias("open")))
            .otherwise(F.struct(flush.alias("done"), u.alias("open")))
        )

    return F.aggregate(units, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def section(c: Column | str) -> Column:
    """The text of the first Markdown heading, else empty."""
    return strip(F.regexp_extract(col(c), r"(?m)^\s*#{1,6}\s+(.+)$", 1))


def chunk_id(dataset: Column | str, split: Column | str, uri: Column | str, index: Column | str, version: Column | str, hash_: Column | str) -> Column:
    """What names a chunk: its source, its place there, the version of the pipeline and its content."""
    return joined_hash(dataset, split, uri, index, version, hash_)


def chunk_documents(df: DataFrame, id_col: str, text_col: str, most: int = 1800, version: str = "1", dataset: Column | None = None, split: Column | None = None) -> DataFrame:
    """(id, chunk_index, content, section, content_hash, chunk_id), one row per chunk; the id is the source's address."""
    empty = F.lit("")
    of = [F.col(id_col).alias("id"), (empty if dataset is None else dataset).alias("_d"), (empty if split is None else split).alias("_s")]
    rows = df.select(*of, F.posexplode(prose_chunks(text_col, most)).alias("chunk_index", "content"))
    rows = rows.withColumn("section", section("content")).withColumn("content_hash", content_hash("content"))
    return rows.withColumn("chunk_id", chunk_id("_d", "_s", "id", "chunk_index", F.lit(version), "content_hash")).drop("_d", "_s")


def whole_documents(df: DataFrame, id_col: str, text_col: str, version: str = "1", dataset: Column | None = None, split: Column | None = None) -> DataFrame:
    """The same columns with one chunk for each document, its text as it is."""
    empty = F.lit("")
    rows = df.select(F.col(id_col).alias("id"), F.lit(0).alias("chunk_index"), F.col(text_col).alias("content"), (empty if dataset is None else dataset).alias("_d"), (empty if split is None else split).alias("_s"))
    rows = rows.withColumn("section", section("content")).withColumn("content_hash", content_hash("content"))
    return rows.withColumn("chunk_id", chunk_id("_d", "_s", "id", "chunk_index", F.lit(version), "content_hash")).drop("_d", "_s")


def java_signature(c: Column | str) -> Column:
    """Struct (return_type, method_name, parameter_types, class_name, start_line, end_line) of the first method, else null."""
    t = col(c)
    head = F.regexp_extract(t, METHOD_HEAD, 0)
    before = F.substr(t, F.lit(1), F.instr(t, head) - 1)
    line = lambda x: F.regexp_count(x, F.lit("\n")) + 1
    params = F.filter(F.transform(F.split(F.regexp_extract(t, METHOD_HEAD, 3), ","), strip), lambda p: F.contains(p, F.lit(" ")))
    made = F.struct(
        strip(F.regexp_extract(t, METHOD_HEAD, 1)).alias("return_type"),
        F.regexp_extract(t, METHOD_HEAD, 2).alias("method_name"),
        F.transform(params, lambda p: F.regexp_replace(p, r" [^ ]*$", "")).alias("parameter_types"),
        F.regexp_extract(before, r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1).alias("class_name"),
        line(before).alias("start_line"),
        F.greatest(line(before), line(t)).alias("end_line"),
    )
    return F.when(t.rlike(METHOD_HEAD), made)


def pair_signature(left: Column | str, right: Column | str, most: int = 50_000) -> Column:
    """Signature of a pair: that of its input side, else of its output side; null for long inputs and unified diffs."""
    side = lambda c: F.when((F.length(col(c)) <= most) & ~col(c).rlike(r"(?m)^(?:@@ |diff --git |\+\+\+ |--- )"), java_signature(c))
    return F.coalesce(side(left), side(right))


def repeated_boundaries(pages: DataFrame, doc: str = "doc_id", text: str = "text", share: float = 0.6) -> DataFrame:
    """(doc, place, key): first and last lines that at least two and 60 % of a document's pages have in common."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\R"), strip), lambda x: x != "")
    ends = pages.select(F.col(doc), lines.alias("ls")).where(F.size("ls") > 0)
    both = F.explode(F.array(F.struct(F.lit("header").alias("place"), F.element_at("ls", 1).alias("line")), F.struct(F.lit("footer").alias("place"), F.element_at("ls", -1).alias("line"))))
    keyed = ends.select(doc, both.alias("b")).select(doc, "b.place", boundary_key("b.line").alias("key"))
    counts = keyed.groupBy(doc, "place", "key").agg(F.count("*").alias("n"))
    total = counts.groupBy(doc, "place").agg(F.sum("n").alias("pages"))
    need = F.greatest(F.lit(2), F.ceil(F.col("pages") * share))
    return counts.join(total, [doc, "place"]).where((F.col("pages") >= 2) & (F.col("n") >= need) & (F.col("key") != "")).select(doc, "place", "key", "n")


def clean_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """Pages without repeated headers and footers, wrapped lines joined and hyphens undone."""
    marks = repeated_boundaries(pages, doc, text)
    known = marks.groupBy(doc).agg(F.collect_set(F.when(F.col("place") == "header", F.col("key"))).alias("_h"), F.collect_set(F.when(F.col("place") == "footer", F.col("key"))).alias("_f"))
    out = pages.join(known, doc, "left").withColumn("_ls", F.transform(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n"), strip))
    filled = F.filter(F.sequence(F.lit(0), F.size("_ls") - 1), lambda k: F.get(F.col("_ls"), k) != "")
    out = out.withColumn("_at", filled)
    is_head = lambda k: (k == F.element_at("_at", 1)) & F.coalesce(F.array_contains("_h", boundary_key(F.get(F.col("_ls"), k))), F.lit(False))
    is_foot = lambda k: (k == F.element_at("_at", -1)) & F.coalesce(F.array_contains("_f", boundary_key(F.get(F.col("_ls"), k))), F.lit(False))
    kept = F.when(F.size("_at") == 0, F.col("_ls")).otherwise(F.transform("_ls", lambda x, k: F.when(is_head(k) | is_foot(k), "").otherwise(x)))
    return out.withColumn(text, join_wrapped(kept)).drop("_h", "_f", "_ls", "_at")


def join_wrapped(lines: Column) -> Column:
    """Paragraphs from lines: blank lines part them, a hyphen before a small letter joins words."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        joined = (
            F.when(s["open"] == "", x)
            .when(F.endswith(s["open"], F.lit("-")) & x.rlike(r"^\p{Ll}"), F.concat(F.substr(s["open"], F.lit(1), F.length(s["open"]) - 1), x))
            .otherwise(F.concat(s["open"], F.lit(" "), x))
        )
        flush = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.when(x == "", F.struct(flush.alias("done"), F.lit("").alias("open"))).otherwise(F.struct(s["done"].alias("done"), joined.alias("open")))

    whole = F.aggregate(lines, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return strip(F.array_join(whole, "\n\n"))
