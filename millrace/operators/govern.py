"""Contracts of experiments: canonical hashes, manifests, preflight checks, run layouts and audits."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identity as ident
from millrace.functions.text import content_hash, java_hash, strip
from millrace.operators import index, leakage
from millrace.operators.filters import ContractError

#: Fixed value: the form of a run's id.
RUN_ID = re.compile(r"[a-z0-9][a-z0-9._-]{1,63}")
FOLDERS = ["predictions", "metrics", "reports", "samples", "analysis"]
# What must agree for a corpus to count as the same, and the rules that each task's smoke cases need.
CONTENT_FIELDS = ["collection_name", "dataset_manifests", "document_count", "chunker_name", "chunker_version", "ingestion_pipeline_version", "embedding_template_version"]
RULES = {"testing": ["code_compiles", "generated_tests_pass", "invokes_focal_method", "minimum_test_methods", "required_scenarios"], "refactoring": ["code_compiles", "behavior_tests_pass", "public_api_preserved"]}


def stable_sha256(value: Any) -> str:
    """SHA-256 of a value's JSON with sorted names and no blanks."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest_id(manifest: Mapping[str, Any]) -> str:
    """What names a collection's manifest: all of it but the time it was made; data sets without order."""
    return stable_sha256({k: sorted(v) if k == "dataset_manifests" else v for k, v in manifest.items() if k != "created_at"})


def content_id(manifest: Mapping[str, Any]) -> str:
    """What names a collection's corpus and how it was cut, whatever it was embedded with."""
    return stable_sha256({k: sorted(manifest[k]) if k == "dataset_manifests" else manifest[k] for k in CONTENT_FIELDS})


def contract(config: Mapping[str, Any], sections: Mapping[str, Mapping[str, str]], optional: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Any]:
    """The part of a configuration that a fingerprint protects.

    ``sections`` names, for each section, its fields and the configuration's keys they come from; a key that isn't there is an error.
    ``optional`` does the same for fields that are left out where the configuration has no value, so that a newer field doesn't change
    older fingerprints. Lists called allowed_splits are compared without order.
    """
    tidy = lambda k, v: sorted(v) if k == "allowed_splits" else v
    out: dict[str, Any] = {}
    for name, fields in sections.items():
        if missing := [k for k in fields.values() if k not in config]:
            raise ContractError(f"the configuration lacks {', '.join(missing)}")
        out[name] = {f: tidy(f, config[k]) for f, k in fields.items()}
    for name, fields in (optional or {}).items():
        out.setdefault(name, {}).update({f: tidy(f, config[k]) for f, k in fields.items() if config.get(k) is not None})
    return out


def require_fingerprint(payload: Mapping[str, Any], expected: str) -> str:
    """The payload's fingerprint; another one than expected is an error before anything runs."""
    if (found := stable_sha256(payload)) != expected:
        raise ContractError(f"the effective contract has the fingerprint {found}, expected {expected}")
    return found


def preflight(checks: Mapping[str, tuple[Any, Any]]) -> dict[str, Any]:
    """All checks (name: expected, found) with whether they hold; an error that lists every difference if one doesn't."""
    rows = {k: {"expected": a, "found": b, "ok": a == b} for k, (a, b) in checks.items()}
    if bad := [f"{k}: expected {r['expected']!r}, found {r['found']!r}" for k, r in rows.items() if not r["ok"]]:
        raise ContractError("preflight failed: " + "; ".join(bad))
    return rows


def collection_checks(spark: SparkSession, path: str, names: Sequence[str], expected: Mapping[str, Any], fields: Sequence[str] = index.EMBEDDING_FIELDS) -> dict[str, tuple[Any, Any]]:
    """Preflight checks of stored collections: their manifests' fields, and their count against the table itself."""
    out = {}
    counts = {r[0]: r[1] for r in spark.read.parquet(path).where(F.col("collection").isin(*names)).groupBy("collection").count().collect()}
    for name in names:
        found = index.read_manifest(spark, path, name)
        out |= {f"{name}.{f}": (expected.get(f), found.get(f)) for f in fields if f in expected}
        out[f"{name}.count"] = (found.get("count"), counts.get(name, 0))
    return out


def run_id(value: str) -> str:
    """A run's id: 2 to 64 small letters, digits, dots, underscores or hyphens, a letter or digit first."""
    if not RUN_ID.fullmatch(value.strip()):
        raise ContractError(f"{value!r} is no run id")
    return value.strip()


def run_path(root: str, path: str) -> str:
    """The path, if it lies below a run of the given root; else an error. Dots that climb out are resolved first."""
    import posixpath

    whole, base = posixpath.normpath(path), posixpath.normpath(root)
    if not whole.startswith(base + "/"):
        raise ContractError(f"{path} is not inside {root}")
    run_id(whole[len(base) + 1 :].split("/")[0])
    return whole


def write_run(spark: SparkSession, root: str, run: str, status: str, metadata: Mapping[str, Any] | None = None, now: str | None = None) -> dict[str, Any]:
    """Write a run's manifest over the one before: its first time stays, its metadata are merged."""
    path = f"{root}/{run_id(run)}/run_manifest.json"
    before = json.loads(index.read_text(spark, path)) if index.exists(spark, path) else {}
    now = now or datetime.now(UTC).isoformat()
    made = {
        "schema_version": "1", "artifact_type": "evaluation_run", "run_id": run, "status": status, "created_at": before.get("created_at", now), "updated_at": now,
        "path": f"{root}/{run}", "layout": {f: f for f in FOLDERS}, "metadata": {**before.get("metadata", {}), **(metadata or {})},
    }
    index.write_text(spark, path, json.dumps(made, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return made


def smoke_cases(df: DataFrame) -> DataFrame:
    """Smoke cases (id, task, class_name, focal_method, source_code, ...) with their three hashes and identity, as a corpus has them."""
    code = F.coalesce("source_code", F.lit(""))
    of = ident.identity(dataset=F.lit("handcrafted_smoke_v1"), case_id="id", class_name="class_name", method_name="focal_method")
    marks = F.struct(java_hash(code).alias("input_code_hash"), java_hash(F.coalesce(F.col("focal_code"), code) if "focal_code" in df.columns else code).alias("focal_method_hash"), content_hash(code).alias("full_document_hash"))
    out = df.withColumns({"identity": of, "fingerprint": marks, "input_code_hash": F.sha2(code, 256)})
    return out.withColumns({"canonical": ident.canonical("identity"), "knowledge_id": F.col("id")})


def smoke_problems(cases: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with smoke cases; no rows if nothing is. ``rules`` is each case's array of rule names.

    Ids must be unique and source not blank; each task needs its rules; a test case's expected call is its focal method; stored
    hashes (where there are such columns) are those of the source.
    """
    need = F.when(F.col("task") == "testing", F.array(*map(F.lit, RULES["testing"]))).when(F.col("task") == "refactoring", F.array(*map(F.lit, RULES["refactoring"])))
    lacking = F.array_except(need, F.coalesce("rules", F.array().cast("array<string>")))
    found = [
        F.when(need.isNull(), F.lit("unknown task")), F.when(F.size(lacking) > 0, F.concat(F.lit("rules lacking: "), F.array_join(lacking, ", "))),
        F.when(F.coalesce(strip("source_code"), F.lit("")) == "", F.lit("no source")),
    ]
    if "must_call_method" in cases.columns:
        found.append(F.when((F.col("task") == "testing") & ~F.col("must_call_method").eqNullSafe(F.col("focal_method")), F.lit("expects another method than the focal one")))
    if "stored_hash" in cases.columns:
        found.append(F.when(~F.col("stored_hash").eqNullSafe(java_hash("source_code")), F.lit("stored hash differs")))
    own = cases.select("id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))
    return own.unionAll(cases.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem")))


def smoke_suite(cases: DataFrame, total: int = 24, per_cell: int = 4, tasks: Sequence[str] = ("testing", "refactoring"), difficulties: Sequence[str] = ("easy", "medium", "hard")) -> list[str]:
    """What is wrong with the suite as a whole: its size, the cases of each task and difficulty, ids and sources that repeat."""
    n, ids, codes = cases.agg(F.count("*"), F.count_distinct("id"), F.count_distinct(java_hash("source_code"))).first()
    out = [f"{n} cases instead of {total}"] * (n != total) + [f"{n - ids} ids repeat"] * (ids != n) + [f"{n - codes} sources repeat"] * (codes != n)
    found = {(r[0], r[1]): r[2] for r in cases.groupBy("task", "difficulty").count().collect()}  # a row for each task and difficulty
    out += [f"{found.get((t, d), 0)} cases of {t}, {d} instead of {per_cell}" for t in tasks for d in difficulties if found.get((t, d), 0) != per_cell]
    return out + [f"unknown task or difficulty: {t}, {d}" for t, d in sorted(found, key=str) if t not in tasks or d not in difficulties]


def smoke_leakage(cases: DataFrame, retrieval: Mapping[str, DataFrame], collections: Mapping[str, Sequence[str]]) -> DataFrame:
    """(collection, tasks, indexed, cases, overlaps, safe): each collection's samples against the smoke cases of its tasks.

    ``retrieval`` holds each task's samples, with identity, canonical and fingerprint like :func:`smoke_cases`.
    """
    from millrace.operators.knowledge import fingerprint_keys

    rows, spark = [], cases.sparkSession
    for name, tasks in collections.items():
        own = cases.where(F.col("task").isin(*tasks))
        bench = leakage.keys(own, "id", fingerprint_keys(own))
        n = hits = 0
        for t in tasks:
            n += retrieval[t].count()
            hits += leakage.touched(leakage.keys(retrieval[t], "knowledge_id", fingerprint_keys(retrieval[t])), bench).count()
        rows.append((name, list(tasks), n, own.count(), hits, hits == 0))
    return spark.createDataFrame(rows, "collection string, tasks array<string>, indexed long, cases long, overlaps long, safe boolean")
