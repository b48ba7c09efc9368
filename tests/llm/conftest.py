import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows with the other columns filled."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "x " * 30_000), (6, "same text here and there"), (7, "same text here and there"), (None, "no id"), (8, "tie a b c"), (8, "tie a b c"),
    (9, "ünïcödé … 日本 \x00 \x1f"), (2**60 + 1, "an id beyond what a double holds"),
]


CLASHES = [
    "id", "fp", "node", "piece", "length", "block", "salt", "removed_lines", "score", "_text_", "held_out", "component_id", "x", "_text", "_score", "_id", "_hits", "_chunks", "_gone", "_done", "_found",
    "hits", "cut", "gone", "done", "of", "row", "ranges", "_row", "_ranges", "_hot", "_place", "key", "found", "rep", "digest", "units", "slot", "ids", "media", "n_bytes", "_metadata",
]


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    clash = {c: F.lit(1) for c in CLASHES}
    return docs_of(ODD).withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
