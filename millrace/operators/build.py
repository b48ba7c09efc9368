"""Index runs and the whole build of collections, with the guards that come before anything is written."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import index, knowledge, leakage
from millrace.operators.filters import ContractError, require_splits


def require_indexable(manifest: Mapping[str, Any]) -> None:
    """The gate of a data set: its manifest allows indexing and its role is retrieval."""
    if manifest.get("allowed_for_indexing") is not True or manifest.get("usage_role") != "retrieval":
        raise ContractError(f"data set {manifest.get('dataset_name', '?')!r} is not meant for indexing")


def index_run(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], path: str, allowed: Sequence[str] = ("train",), manifest: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Chunk documents and write each collection, de-duplicated by content; what was loaded, made, written and repeated.

    The manifest and the splits are checked before anything is written; a disallowed split is an error. Collections are
    overwritten whole, in the order of their names, so a run that is repeated gives the same table.
    """
    if manifest is not None:
        require_indexable(manifest)
    require_splits(docs, allowed)
    chunks = chunker(docs)
    chunks = chunks if "parse_success" in chunks.columns else chunks.withColumn("parse_success", F.lit(True))
    stats = chunks.groupBy("collection").agg(F.count("*").alias("n"), F.count_if(~F.col("parse_success")).alias("fallback"))
    by = {r["collection"]: r for r in stats.collect()}  # one row per collection
    writes = []
    for name in sorted(by):
        one = index.first_wins(chunks.where(F.col("collection") == name), "content_hash", "document_id").dropDuplicates(["document_id"])
        done = index.rebuild(one, path, name, manifest or {})
        writes.append({"collection": name, "received": by[name]["n"], "indexed": done["count"], "duplicates": by[name]["n"] - done["count"]})
    return {
        "loaded": docs.count(), "produced": sum(r["n"] for r in by.values()), "fallback": sum(r["fallback"] for r in by.values()),
        "writes": writes, "indexed": sum(w["indexed"] for w in writes), "duplicates": sum(w["duplicates"] for w in writes),
    }


def leakage_report(docs: DataFrame, benchmark: DataFrame) -> dict[str, Any]:
    """How many samples a corpus and a benchmark have and how many rows of the corpus share a fingerprint or identity with it."""
    a, b = (leakage.keys(x, "knowledge_id", knowledge.fingerprint_keys(x)) for x in (docs, benchmark))
    n = leakage.touched(a, b).count()
    return {"indexed_samples": docs.count(), "benchmark_samples": benchmark.count(), "overlaps": n, "safe": n == 0}


def production_build(
    spark: SparkSession, path: str, refactoring: DataFrame, testing: DataFrame, benchmark: DataFrame, embed: Callable[[DataFrame], DataFrame], literature: DataFrame | None = None,
    manifest: Mapping[str, Any] | None = None, version: str = "1", group: str = "identity.repository",
) -> dict[str, Any]:
    """Select, audit, chunk, embed once and write the specialised and the mixed collections; a report of every step.

    Documents (see :func:`millrace.operators.knowledge.documents`) that share a repository, a fingerprint or an identity with the
    benchmark are left out first; what remains is audited again and must be safe. ``embed`` adds ``embedding`` to chunks; the mixed
    collection takes the vectors of the specialised ones by document id, so nothing is embedded twice. In the end the mixed
    collection must hold exactly the others' documents.
    """
    if manifest is not None:
        require_indexable(manifest)
    report: dict[str, Any] = {"selection": {}, "leakage": {}}
    chosen = {}
    for name, docs in (("refactoring", refactoring), ("testing", testing)):
        kept, by_group, by_key = leakage.disjoint(docs, benchmark, "knowledge_id", F.nullif(F.lower(F.col(group)), F.lit("")), knowledge.fingerprint_keys(docs))
        report["selection"][name] = {"by_group": by_group, "by_key": by_key}
        report["leakage"][name] = leakage_report(kept, benchmark)
        if not report["leakage"][name]["safe"]:
            raise ContractError(f"{name} still overlaps with the benchmark")
        chosen[name] = kept
    names = knowledge.COLLECTIONS
    chunks = knowledge.corpora(chosen["refactoring"], chosen["testing"], literature, names, version)
    mixed = F.col("collection") == names["mixed"]
    own = chunks.where(~mixed).withColumn("_k", F.concat_ws("|", "collection", "content_hash"))
    own = index.first_wins(own, "_k", "document_id").drop("_k").dropDuplicates(["document_id"])
    report["collections"] = {}
    for name in sorted(r[0] for r in own.select("collection").distinct().collect()):
        done = index.rebuild(embed(own.where(F.col("collection") == name)), path, name, manifest or {})
        report["collections"][name] = done["count"]
    stored = spark.read.parquet(path).where(~mixed)
    both = chunks.where(mixed).join(stored.select("document_id").distinct(), "document_id", "left_semi").dropDuplicates(["document_id"])
    done = index.rebuild(index.with_vectors(both, stored, "document_id"), path, names["mixed"], manifest or {})
    report["collections"][names["mixed"]] = done["count"]
    table = spark.read.parquet(path)
    if not leakage.same_ids(table.where(mixed), table.where(~mixed), "document_id"):
        raise ContractError("the mixed collection doesn't hold the others' documents")
    report["received"], report["unique"] = chunks.where(mixed).count(), done["count"]
    report["duplicates"] = report["received"] - report["unique"]
    return report
