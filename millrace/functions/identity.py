"""Identities, pair ids and fingerprints of code samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col, content_hash, java_hash, joined_hash, strip

PARTS = ["dataset", "case_id", "repository", "commit", "file_path", "class_name", "method_name"]


def identity(**parts: Column | str) -> Column:
    """Struct of all identity parts as strings; those that aren't given are empty."""
    if unknown := set(parts) - set(PARTS):
        raise ValueError(f"unknown identity parts: {sorted(unknown)}")
    return F.struct(*[F.coalesce(col(parts[p]).cast("string"), F.lit("")).alias(p) if p in parts else F.lit("").alias(p) for p in PARTS])


def canonical(of: Column | str) -> Column:
    """One text for an identity: its parts stripped and lower-cased, joined by ``|``; paths with slashes."""
    i = col(of)
    clean = lambda p: F.replace(i[p], F.lit("\\"), F.lit("/")) if p == "file_path" else i[p]
    return F.concat_ws("|", *[F.lower(strip(clean(p))) for p in PARTS])


def pair_id(kind: Column | str, of: Column | str, given: Column | str, output: Column | str) -> Column:
    """Hash of a pair's kind (a column or a word), identity and the lexical hashes of both sides."""
    return joined_hash(F.lit(kind) if isinstance(kind, str) else kind, canonical(of), java_hash(given), java_hash(output))


def code_id(role: str, code: Column | str) -> Column:
    """Hash of a piece of code in a role, such as original or test."""
    return joined_hash(F.lit(role), strip(F.coalesce(col(code), F.lit(""))))


def fingerprint(given: Column | str, full: Column | str, focal: Column | str | None = None) -> Column:
    """Struct of a sample's three hashes: its input code, its focal method (the input where none is named) and its whole text."""
    of = col(given) if focal is None else F.coalesce(F.nullif(col(focal), F.lit("")), col(given))
    return F.struct(java_hash(given).alias("input_code_hash"), java_hash(of).alias("focal_method_hash"), content_hash(full).alias("full_document_hash"))
