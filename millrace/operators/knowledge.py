"""Knowledge documents: records with identity and fingerprints, their embedding texts, and collections of them."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import identity as ident
from millrace.functions import javasource
from millrace.functions.text import col, content_hash, joined_hash, strip
from millrace.operators.chunk import chunk_documents, chunk_id, pair_signature
from millrace.operators.filters import ContractError, require

TYPES = {"testing": "test_example", "refactoring": "refactoring_example"}
# Headings of embedding texts and evidence, and names of their templates.
TEMPLATES = {("refactoring_example", "1"): "refactoring_pair", ("refactoring_example", "2"): "refactoring_input", ("test_example", "1"): "production_test_pair", ("test_example", "2"): "production_test_input"}
LITERATURE = "software_engineering_literature"
COLLECTIONS = {"refactoring": "refactoring_db", "testing": "testing_db", "literature": "literature_db", "mixed": "mixed"}


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that there are and that isn't empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))


def case_identity(df: DataFrame, dataset: str, ordinal: Column | str, uri: Column) -> Column:
    """Identity of a raw record: its own id, else its place; repository, commit and file by their usual names."""
    case = F.coalesce(_first(df, "id", "case_id", "refactoring_id"), F.concat(F.lit("record-"), col(ordinal).cast("string")))
    parts = {"repository": _first(df, "repository", "project"), "commit": _first(df, "commit_sha", "commit"), "file_path": F.coalesce(_first(df, "file_path", "source_file"), uri)}
    return ident.identity(dataset=F.lit(dataset), case_id=case, **parts, class_name=_first(df, "class_name"), method_name=_first(df, "method_name"))


def documents(df: DataFrame, dataset: str, path: str = "", ordinal: str = "ordinal", split: str = "train", role: str = "retrieval", context_level: str | None = None) -> DataFrame:
    """Knowledge documents of normalised records (domain, input, output and whatever else they have), one row each.

    A record of another domain, without a side or of another context level than ``context_level`` is an error that names how many
    there are and the first. The whole record as JSON with sorted names is the content. Pair ids and the ids of both
    sides' code depend on the domain; null text counts as empty.
    """
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    domain = F.lower(text("domain"))
    level = F.coalesce(_first(df, "context_level"), F.lit("src_fm"))
    fits = (domain != "testing") | (level == context_level) if context_level else F.lit(True)
    good = df.select(ordinal, (domain.isin(*TYPES) & (text("input") != "") & (text("output") != "") & fits).alias("ok"))
    require(good, F.col("ok"), "records with a known domain, both sides and the expected context level", ordinal)
    uri = F.coalesce(_first(df, "source_file"), F.concat(F.lit(f"{path}#record="), F.col(ordinal).cast("string")))
    names = sorted(c for c in df.columns if c != ordinal)
    base = df.select(
        F.to_json(F.struct(*names)).alias("content"), domain.alias("task"), F.coalesce(F.nullif(text("source"), F.lit("")), F.lit(dataset)).alias("source"), F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"), F.lit(role).alias("usage_role"), F.lit("java").alias("language"), uri.alias("source_uri"), case_identity(df, dataset, ordinal, uri).alias("identity"),
        text("instruction").alias("instruction"), text("input").alias("input_code"), text("output").alias("output_code"), level.alias("context_level"),
        F.coalesce(_first(df, "refactoring_type"), F.lit("unknown")).alias("refactoring_type"), text("diff").alias("diff"),
    )
    testing = F.col("task") == "testing"
    side = lambda a, b, c: F.when(testing, ident.code_id(a, c)).otherwise(ident.code_id(b, c))
    out = base.withColumns({
        "document_type": F.when(testing, TYPES["testing"]).otherwise(TYPES["refactoring"]), "canonical": ident.canonical("identity"), "content_hash": content_hash("content"),
        "fingerprint": ident.fingerprint("input_code", "content"), "pair_id": ident.pair_id(F.col("task"), "identity", "input_code", "output_code"),
        "input_id": side("production", "original", "input_code"), "output_id": side("test", "refactored", "output_code"),
    })
    relation = F.struct(F.when(testing, "tested_by").otherwise("refactored_to").alias("relationship_type"), F.col("output_id").alias("target_id"))
    return out.withColumns({"knowledge_id": joined_hash("dataset", "split", "source_uri", "canonical", "content_hash"), "relationships": F.array(relation)})


def literature(df: DataFrame, dataset: str, split: str = "train", role: str = "retrieval") -> DataFrame:
    """Knowledge documents of texts (content, source_file); the file's name is the case."""
    name = F.element_at(F.split("source_file", "/"), -1)
    out = df.select(
        strip("content").alias("content"), F.lit(LITERATURE).alias("task"), name.alias("source"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit(role).alias("usage_role"),
        F.lit("").alias("language"), F.col("source_file").alias("source_uri"), ident.identity(dataset=F.lit(dataset), case_id=name, file_path="source_file").alias("identity"),
        F.lit("literature").alias("document_type"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
    )
    out = out.withColumns({"canonical": ident.canonical("identity"), "content_hash": content_hash("content")})
    return out.withColumn("knowledge_id", joined_hash("dataset", "split", "source_uri", "canonical", "content_hash"))


def fingerprint_keys(df: DataFrame) -> dict[str, Column]:
    """The kinds of keys by which a document may leak (see :mod:`millrace.operators.leakage`): three hashes and a specific identity."""
    from millrace.operators.filters import specific_identity

    i = {p: F.col("identity")[p] for p in ident.PARTS}
    kinds = {k: F.col("fingerprint")[k] for k in ("input_code_hash", "focal_method_hash", "full_document_hash")}
    return kinds | {"structured_identity": F.when(specific_identity(**i), F.col("canonical"))}


def pair_text(version: str = "1") -> Column:
    """Embedding text of paired documents: both sides (version 1) or the input alone (version 2)."""
    if version not in ("1", "2"):
        raise ContractError(f"unknown template version {version!r}")
    both = version == "1"
    testing = ["Task: test generation", F.concat(F.lit("Methods2Test context level: "), F.col("context_level")), F.concat(F.lit("Production Java code:\n"), F.col("input_code"))]
    change = ["Task: refactoring", F.concat(F.lit("Refactoring type: "), F.col("refactoring_type")), F.concat(F.lit("Original Java code:\n"), F.col("input_code"))]
    if both:
        testing.append(F.concat(F.lit("Corresponding test code:\n"), F.col("output_code")))
        change += [F.concat(F.lit("Refactored Java code:\n"), F.col("output_code")), F.when(F.col("diff") != "", F.concat(F.lit("Change summary or diff:\n"), F.col("diff")))]
    lit = lambda xs: [F.lit(x) if isinstance(x, str) else x for x in xs]
    return F.when(F.col("document_type") == TYPES["testing"], F.concat_ws("\n\n", *lit(testing))).otherwise(F.concat_ws("\n\n", *lit(change)))


def literature_text(section: Column | str = "") -> Column:
    part = F.lit("") if isinstance(section, str) and section == "" else strip(col(section))
    return F.concat_ws("\n\n", F.concat(F.lit("Document: "), F.col("title")), F.when(part != "", F.concat(F.lit("Section: "), part)), strip("content"))


def bind(docs: DataFrame, collection: str, version: str = "1") -> DataFrame:
    """Paired documents as members of a collection: evidence as content, the template's text to embed, code moved aside."""
    name = F.when(F.col("document_type") == TYPES["testing"], TEMPLATES["test_example", version]).otherwise(TEMPLATES["refactoring_example", version])
    return docs.withColumns({
        "content": pair_text("1"), "embedding_text": pair_text(version), "collection": F.lit(collection), "embedding_text_template": name, "embedding_text_template_version": F.lit(version),
        "_input_code": F.col("input_code"), "_output_code": F.col("output_code"),
    }).drop("input_code", "output_code", "diff", "instruction", "content_hash")


def require_type(docs: DataFrame, kind: str) -> DataFrame:
    """docs, or an error if one is of another type."""
    return require(docs, F.col("document_type") == kind, f"of the type {kind}")


def pair_chunks(bound: DataFrame, version: str = "rag-v2") -> DataFrame:
    """One chunk for each pair, with the signature of its input and whether both sides have one (else it is a fallback)."""
    one = lambda c: pair_signature(c, c)
    out = bound.withColumns({"content_hash": content_hash("content"), "chunk_index": F.lit(0), "signature": one("_input_code"), "parse_success": one("_input_code").isNotNull() & one("_output_code").isNotNull()})
    kind = F.when(F.col("document_type") == TYPES["testing"], "production_test_pair").otherwise("refactoring_pair")
    out = out.withColumn("chunk_type", F.when(F.col("parse_success"), kind).otherwise(F.concat(kind, F.lit("_fallback"))))
    return out.withColumn("document_id", chunk_id("dataset", "split", "source_uri", "chunk_index", F.lit(version), "content_hash"))


_METHOD = "struct<content:string,class_name:string,method_name:string,method_signature:string,return_type:string,start_line:int,end_line:int,parameter_types:array<string>,annotations:array<string>>"


def java_chunks(docs: DataFrame, text: str = "content", version: str = "rag-v2") -> DataFrame:
    """One row per method or constructor of Java sources, in declaration context; a source without any, or whose braces don't
    match, is one chunk as a whole with the reason.

    Adds chunk_index, chunk_type, method (a struct, null for a whole source), package_name, parse_success, failure, parent_id,
    content_hash and document_id; content becomes the chunk's. Extra columns stay. docs: dataset, split, source_uri, content.
    """

    @F.pandas_udf(f"struct<package_name:string,failure:string,methods:array<{_METHOD}>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [javasource.read(t) for t in texts]
        return pd.DataFrame({"package_name": [s.package_name for s in found], "failure": [s.failure for s in found], "methods": [[vars(m) for m in s.methods] for s in found]})

    parent = F.sha2(F.concat_ws("|", "source_uri", F.coalesce(F.col(text), F.lit(""))), 256)
    out = docs.withColumn("_s", read(text)).withColumn("parent_id", parent)
    out = out.select("*", F.posexplode_outer("_s.methods").alias("_k", "method"))
    ok = F.col("method").isNotNull()
    kind = F.when(~ok, "whole_document_fallback").when(F.col("method.return_type") == "", "constructor").otherwise("method")
    out = out.withColumns({"chunk_index": F.coalesce("_k", F.lit(0)), text: F.when(ok, F.col("method.content")).otherwise(F.col(text)), "parse_success": ok, "chunk_type": kind, "package_name": F.col("_s.package_name"), "failure": F.col("_s.failure")})
    out = out.drop("_s", "_k").withColumn("content_hash", content_hash(text))
    return out.withColumn("document_id", chunk_id("dataset", "split", "source_uri", "chunk_index", F.lit(version), "content_hash"))


def literature_chunks(docs: DataFrame, collection: str, most: int = 1800, version: str = "rag-v2") -> DataFrame:
    """Chunks of literature with the document's name and section in front of the text to embed."""
    rows = chunk_documents(docs, "source_uri", "content", most, version, F.col("dataset"), F.col("split")).withColumnRenamed("id", "source_uri").withColumnRenamed("chunk_id", "document_id")
    rows = rows.join(docs.drop("content", "content_hash"), "source_uri")
    return rows.withColumns({"collection": F.lit(collection), "embedding_text": literature_text("section"), "parse_success": F.lit(True), "chunk_type": F.lit("literature")})


def corpora(refactoring: DataFrame, testing: DataFrame, lit: DataFrame | None = None, names: Mapping[str, str] = COLLECTIONS, version: str = "1") -> DataFrame:
    """Chunks of all collections, told apart by ``collection``: each type's own and the mixed one, which holds all.

    Documents of another type than their slot's are an error. A mixed chunk has the id that its own collection gives it.
    """
    require_type(refactoring, TYPES["refactoring"])
    require_type(testing, TYPES["testing"])
    keep = ["document_id", "collection", "content", "embedding_text", "document_type", "dataset", "split", "source", "source_uri", "task", "content_hash", "chunk_index", "chunk_type", "parse_success", "knowledge_id", "canonical"]
    out = pair_chunks(bind(refactoring, names["refactoring"], version)).select(*keep).unionByName(pair_chunks(bind(testing, names["testing"], version)).select(*keep))
    if lit is not None:
        require_type(lit, "literature")
        out = out.unionByName(literature_chunks(lit, names["literature"]).select(*keep))
    return out.withColumn("collection", F.explode(F.array("collection", F.lit(names["mixed"]))))

