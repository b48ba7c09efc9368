"""Leakage between corpora: keys exploded to rows, so every match is an equi-join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.filters import ContractError

#: N-grams of a benchmark that are broadcast; more are joined by a shuffle.
FEW = 500_000


def keys(df: DataFrame, id_col: str, kinds: Mapping[str, Column]) -> DataFrame:
    """(id, kind, key), a row for each key that isn't null or empty."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in kinds.items()]))
    out = df.select(F.col(id_col).alias("id"), pairs.alias("p")).select("id", "p.kind", "p.key")
    return out.where("key is not null AND key != ''").distinct()


def overlaps(indexed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(indexed_id, benchmark_id, matched_by) for all pairs that share a key of any kind.

    Both sides as :func:`keys` gives them. Every pair is the result asked for; use :func:`touched` where the rows alone matter.
    """
    a, b = indexed.withColumnRenamed("id", "indexed_id"), benchmark.withColumnRenamed("id", "benchmark_id")
    pairs = a.join(b, ["kind", "key"]).groupBy("indexed_id", "benchmark_id")
    return pairs.agg(F.array_sort(F.collect_set("kind")).alias("matched_by"))


def classes(found: DataFrame) -> DataFrame:
    """(rep, n, id, kind, key): rows with the very same keys are one class, named by its smallest id; a row for each class and key."""
    own = found.groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("kind", "key")))), 256).alias("all"))
    named = own.groupBy("all").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return found.join(named, "id").select("id", "n", "kind", "key")


def class_overlaps(indexed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(indexed_id, benchmark_id, matched_by, indexed_rows, benchmark_rows) for classes of rows with the same keys that share any.

    Both sides as :func:`keys` gives them. A text that a third of all rows share is one class, not a pair for each two rows.
    """
    a = classes(indexed).toDF("indexed_id", "indexed_rows", "kind", "key")
    b = classes(benchmark).toDF("benchmark_id", "benchmark_rows", "kind", "key")
    both = a.join(b, ["kind", "key"]).groupBy("indexed_id", "benchmark_id", "indexed_rows", "benchmark_rows")
    return both.agg(F.array_sort(F.collect_set("kind")).alias("matched_by"))


def touched(indexed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Ids of indexed rows that share any key: a semi-join, so a hot key makes no pairs."""
    return indexed.join(benchmark.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("id").distinct()


def disjoint(df: DataFrame, benchmark: DataFrame, id_col: str, group: Column, kinds: Mapping[str, Column]) -> tuple[DataFrame, int, int]:
    """Rows that share neither group nor any key with the benchmark, and how many each stage removed."""
    groups = benchmark.select(group.alias("_g")).where("_g is not null").distinct()
    with_group = df.withColumn("_g", group)
    one = with_group.join(groups, "_g", "left_anti").drop("_g")  # rows without a group match nothing and stay
    hit = touched(keys(one, id_col, kinds), keys(benchmark, id_col, kinds))
    two = one.join(hit.withColumnRenamed("id", id_col), id_col, "left_anti")
    n, n1, n2 = df.count(), one.count(), two.count()
    if not n2:
        raise ContractError("nothing is left")
    return two, n - n1, n1 - n2


def group_overlaps(df: DataFrame, group: str, partition: str) -> DataFrame:
    """Groups that stand in more than one partition: (group, partitions, n). Partitions are few, so sets stay small."""
    got = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(partition)).alias("partitions"), F.count("*").alias("n"))
    return got.where(F.size("partitions") > 1)


def ungrouped(df: DataFrame, group: str, partition: str) -> DataFrame:
    return df.where(F.col(group).isNull()).groupBy(partition).agg(F.count("*").alias("n"))


def require_disjoint(df: DataFrame, group: str, partition: str) -> None:
    if bad := group_overlaps(df, group, partition).limit(5).collect():
        raise ContractError(f"groups in several partitions: {[r[0] for r in bad]}")


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct word n-grams of a text, joined by spaces; empty for shorter texts."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")

    def grams(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(w, k, n), " "))

    # transform over a one-element array, so the words are split once and not for each n-gram
    return F.array_distinct(F.flatten(F.transform(F.array(words), grams)))


def passage_overlaps(docs: DataFrame, benchmark: DataFrame, n: int = 8, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, shared) for documents that hold word n-grams of benchmark items.

    Only the benchmark's n-grams are compared, as hashes first and then as text.
    """
    b = benchmark.select(F.col(item_col), F.explode(shingles(F.col("text"), n)).alias("gram")).withColumn("h", F.xxhash64("gram"))
    if b.limit(FEW + 1).count() <= FEW:
        b = F.broadcast(b)  # then no n-gram of a document is shuffled
    d = docs.select(F.col(id_col), F.explode(shingles(F.col("text"), n)).alias("g2")).withColumn("h", F.xxhash64("g2"))
    return d.join(b, "h").where("g2 = gram").groupBy(id_col, item_col).agg(F.count("*").alias("shared"))


def same_ids(a: DataFrame, b: DataFrame, id_col: str) -> bool:
    """Whether two tables hold the same set of ids."""
    x, y = a.select(id_col).distinct(), b.select(id_col).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
