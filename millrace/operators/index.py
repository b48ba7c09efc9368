"""Collections of chunks with vectors: de-duplication, upserts, rebuilds and manifests.

A collection is a Parquet table partitioned by ``collection``, so a query of named collections reads nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.filters import ContractError

#: Fields of a manifest that must agree before a collection is read or written to, and those an embedding needs.
EMBEDDING_FIELDS = ["embedding_provider", "embedding_model", "embedding_revision", "embedding_dimension", "distance", "normalized"]
MANIFEST_FIELDS = [*EMBEDDING_FIELDS, "collection", "datasets", "splits", "pipeline_version", "chunker", "template_version", "language", "role", "schema_version"]


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by ``order`` of each key; minima are combined before the shuffle, so a hot key is no problem."""
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return df.join(first, [key, order], "left_semi")


def new_only(df: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    return first_wins(df, key, order).join(existing.select(key).distinct(), key, "left_anti")


def dedup_counts(df: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """received, unique and duplicates, per ``by`` where given."""
    per = df.groupBy(*([by] if by else []), key).agg(F.count("*").alias("n"))
    out = per.groupBy(*([by] if by else [])).agg(F.sum("n").alias("received"), F.count("*").alias("unique"))
    return out.withColumn("duplicates", F.col("received") - F.col("unique"))


def sorted_ids_digest(df: DataFrame, id_col: str) -> str:
    """SHA-256 of all ids, sorted and joined by line feeds. Sorted by the cluster and streamed through the driver partition by
    partition, so it is for collections whose largest partition fits there; :func:`corpus_digest` is for any size."""
    import hashlib

    digest, first = hashlib.sha256(), True
    for r in df.select(F.col(id_col).cast("string").alias("i")).orderBy("i").toLocalIterator():
        digest.update((r[0] if first else "\n" + r[0]).encode())
        first = False
    return digest.hexdigest()


def corpus_digest(df: DataFrame, id_col: str) -> str:
    """A digest of the set of ids that doesn't depend on order: sums of two hashes and a count, combined by the cluster.

    Not the digest of :func:`sorted_ids_digest`, but one that nothing has to be sorted or moved for.
    """
    d = df.select(F.col(id_col).cast("string").alias("i")).distinct()
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    n, a, b = d.agg(F.count("*"), wide(F.xxhash64("i")), wide(F.xxhash64(F.lit("salt"), "i"))).first()
    import hashlib

    return hashlib.sha256(f"{n}|{a}|{b}".encode()).hexdigest()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new`` (its last row of a key by all columns) and the rows of ``old`` whose key it lacks."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in new.columns if c != key])
    latest = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return latest.unionByName(old.join(latest.select(key), key, "left_anti"), allowMissingColumns=True)


def rebuild(df: DataFrame, path: str, collection: str, manifest: Mapping[str, Any]) -> dict[str, Any]:
    """Replace one collection of the table at ``path``; its manifest is written last, with the final count."""
    out = df.withColumn("collection", F.lit(collection))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)
    spark = df.sparkSession
    n = spark.read.parquet(path).where(F.col("collection") == collection).count()
    done = {**manifest, "collection": collection, "count": n}
    write_text(spark, f"{path}/_manifests/{collection}.json", json.dumps(done, sort_keys=True, indent=2))
    return done


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An existing collection; reading never makes one."""
    if not exists(spark, f"{path}/collection={name}"):
        raise ContractError(f"there is no collection {name!r}")
    return spark.read.parquet(path).where(F.col("collection") == name)


def read_manifest(spark: SparkSession, path: str, name: str) -> dict[str, Any]:
    return json.loads(read_text(spark, f"{path}/_manifests/{name}.json"))


def mismatches(found: Mapping[str, Any], expected: Mapping[str, Any], fields: list[str] = MANIFEST_FIELDS) -> list[str]:
    """Fields that differ; lists of data sets and splits are compared without order."""
    same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b)) if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)) else a == b
    return [f for f in fields if not same(found.get(f), expected.get(f))]


def require_compatible(found: Mapping[str, Any], expected: Mapping[str, Any], fields: list[str] = MANIFEST_FIELDS) -> None:
    if bad := mismatches(found, expected, fields):
        raise ContractError(f"incompatible collection: {', '.join(bad)}")


def with_vectors(docs: DataFrame, vectors: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """Documents with stored vectors; a document without one is an error when its row is computed."""
    out = docs.join(vectors.select(id_col, vector_col), id_col, "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col(id_col).cast("string")))
    return out.withColumn(vector_col, F.when(F.col(vector_col).isNull(), missing).otherwise(F.col(vector_col)))


def flat_metadata(df: DataFrame, keep: tuple[str, ...] = ("int", "bigint", "double", "float", "boolean", "string")) -> DataFrame:
    """Scalar columns as they are; all others folded into one JSON column, keys sorted; names with ``_`` in front dropped."""
    names = [(n, t) for n, t in df.dtypes if not n.startswith("_")]
    nested = sorted(n for n, t in names if t not in keep)
    out = [F.col(n) for n, t in names if t in keep]
    return df.select(*out, *([F.to_json(F.struct(*nested)).alias("domain_metadata_json")] if nested else []))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, by way of a neighbour that is renamed, on any file system Spark knows."""
    p, fs = _path(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(side, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(side, p):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that may exist with the same content, but not with another."""
    if exists(spark, path):
        if read_text(spark, path) != text:
            raise ContractError(f"{path} exists with other content")
    else:
        write_text(spark, path, text)
