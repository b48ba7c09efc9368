"""Instruction records, mixes and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import col, first_filled, normalize_text, strip
from millrace.operators.filters import ContractError

# Where raw records keep their two sides.
FIELDS = {
    "refactoring": (["input", "source", "original", "before", "before_code", "code", "method"], ["output", "target", "refactored", "after", "after_code", "refactored_code"]),
    "testing": (["input", "focal_method", "method", "source", "code"], ["output", "test", "test_code", "unit_test", "junit_test"]),
}
REFACTORINGS = [
    "Extract Method", "Move Method", "Pull Up Method", "Push Down Method", "Inline Method", "Rename Method", "Move Attribute",
    "Pull Up Attribute", "Push Down Attribute", "Rename Attribute", "Extract Class", "Move Class", "Rename Class",
    "Extract Interface", "Extract Superclass", "Remove Parameter", "Add Parameter", "Rename Variable",
]


def instruction_records(df: DataFrame, domain: str, instruction: str, keep: Sequence[str] = ()) -> DataFrame:
    """instruction, input, output, domain (after the columns to ``keep``) from the first filled candidate columns; rows without both sides are dropped."""
    sides = []
    for names in FIELDS[domain]:
        have = [normalize_text(F.col(n).cast("string")) for n in names if n in df.columns]
        sides.append(first_filled(*have) if have else F.lit(""))
    out = df.select(*keep, F.lit(instruction).alias("instruction"), sides[0].alias("input"), sides[1].alias("output"), F.lit(domain).alias("domain"))
    return out.where("input != '' AND output != ''")


def votes(c: Column | str) -> Column:
    """Integers of a variant array whose items are numbers or objects with one of the usual names."""
    v = col(c)
    keys = ["", ".vote", ".votes", ".evaluation", ".label", ".value"]
    n = F.size(F.try_variant_get(v, "$", "array<variant>"))
    items = F.try_variant_get(v, "$", "array<variant>")
    one = lambda x: F.coalesce(*[F.try_variant_get(x, "$" + k, "int") for k in keys])
    return F.when(n >= 0, F.filter(F.transform(items, one), lambda x: x.isNotNull()))


def repository(c: Column | str) -> Column:
    """What a commit link belongs to."""
    return F.substring_index(col(c), "/commit/", 1)


def group_key(level: str, required: bool = False, **fields: Column) -> Column:
    """Array of the parts that name a record's group; null where none is known (``required``: an error when the row is
    computed). Null and blank parts are left out."""
    get = lambda *ks: F.coalesce(*[F.nullif(F.lower(strip(fields[k].cast("string"))), F.lit("")) for k in ks if k in fields], F.lit(None).cast("string"))
    folder = F.nullif(F.lower(F.element_at(F.split(fields["source_file"], "/"), -2)), F.lit("")) if "source_file" in fields else F.lit(None).cast("string")
    project = F.coalesce(get("project", "project_id"), folder)
    repo = F.coalesce(get("repository", "repo", "repository_url"), project)
    commit, method = get("commit_sha", "commit"), get("method_id", "case_id", "refactoring_id")
    parts = {"project": [repo, project], "repository": [repo], "commit": [repo, commit], "method": [repo, project, commit, method]}[level]
    key = F.filter(F.array(*parts), lambda x: x.isNotNull())
    none = F.raise_error(F.lit(f"a record without any part of a {level} group")) if required else F.lit(None)
    return F.when(F.size(key) > 0, key).otherwise(none)


def order_key(seed: int, *cols: Column | str) -> Column:
    """A seeded order that depends on nothing but the row: md5 of the seed and the key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def ranks(df: DataFrame, order: Sequence[Column | str], out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Add 1-based ranks in the given order (within ``by``), by range partitioning and partition offsets.

    A plain window without keys would put all rows into one task; here only the partitions' counts meet on the driver.
    """
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = {f"_o{k}": col(c) for k, c in enumerate(order)}
    ranged = df.withColumns(cols).repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*cols))).persist()
    sizes = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}
    start, base = 0, {}
    for p in sorted(sizes):
        base[p], start = start, start + sizes[p]
    if not base:
        return df.withColumn(out, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in base.items() for x in kv]), F.col("_part").cast("long"))
    return ranged.withColumn(out, offset + F.col("_in")).drop("_part", "_in", *cols)


def ratio_split(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Add split: train, val or test of exact sizes int(n * ratio), in a seeded order of the key."""
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    ranked = ranks(df, [order_key(seed, key), key], "_r")
    return ranked.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "val").otherwise("test")).drop("_r")


def assign_groups(sizes: list[tuple[str, int]], targets: Mapping[str, float]) -> dict[str, str]:
    """Whole groups, largest first, each to the split that lacks most; of equal ones to the emptier."""
    got = dict.fromkeys(targets, 0)
    out = {}
    for name, n in sizes:
        to = max(targets, key=lambda s: (targets[s] - got[s], -got[s]))
        out[name], got[to] = to, got[to] + n
    return out


def _assigned(df: DataFrame, group: str, targets: Mapping[str, float], seed: int, needed: int, most_groups: int) -> tuple[DataFrame, list, dict]:
    """The greedy assignment runs over one row per group; ``most_groups`` bounds what the driver takes."""
    counts = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), order_key(seed, group), group)
    sizes = [(r[0], r[1]) for r in counts.limit(most_groups + 1).collect()]
    if len(sizes) > most_groups:
        raise ContractError(f"more than {most_groups} groups")
    if len(sizes) < needed:
        raise ContractError(f"{needed} groups are needed, {len(sizes)} are there")
    to = assign_groups(sizes, targets)
    table = df.sparkSession.createDataFrame(list(to.items()), f"{group} string, split string")
    return df.join(table, group), sizes, to


def group_split_by_ratio(df: DataFrame, group: str, ratios: Mapping[str, float], seed: int = 42, most_groups: int = 1_000_000) -> DataFrame:
    """Add split so that no group is in two splits and sizes come near the ratios."""
    if not ratios or min(ratios.values()) < 0 or abs(sum(ratios.values()) - 1) > 1e-8:
        raise ContractError("ratios must be non-negative and sum to 1")
    n = df.count()
    return _assigned(df, group, {k: n * r for k, r in ratios.items()}, seed, sum(r > 0 for r in ratios.values()), most_groups)[0]


def group_split_by_size(df: DataFrame, group: str, key: str, sizes: Mapping[str, int], seed: int = 42, most_groups: int = 1_000_000) -> DataFrame:
    """Add split with exactly the given sizes, whole groups first; rows beyond a size are left out, shortages an error."""
    if not sizes or min(sizes.values()) < 0:
        raise ContractError("sizes must be non-negative")
    out, groups, to = _assigned(df, group, sizes, seed, sum(s > 0 for s in sizes.values()), most_groups)
    got = {s: sum(n for g, n in groups if to[g] == s) for s in sizes}
    if short := {s: n - got[s] for s, n in sizes.items() if got[s] < n}:
        raise ContractError(f"whole groups leave splits short: {short}")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("split"))
    position = F.row_number().over(Window.partitionBy("split").orderBy(order_key(seed, key), key))
    return out.withColumn("_r", position).where(F.col("_r") <= limit).drop("_r")


def balanced_mix(parts: Mapping[str, DataFrame], n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows of each part in a seeded order (top-n, no full sort), with their part's name; too few rows are an error."""
    out = None
    for name, df in parts.items():
        top = df.withColumn("part", F.lit(name)).orderBy(order_key(seed, key), key).limit(n)
        out = top if out is None else out.unionByName(top, allowMissingColumns=True)
    counts = {r[0]: r[1] for r in out.groupBy("part").count().collect()}
    if short := {k: counts.get(k, 0) for k in parts if counts.get(k, 0) < n}:
        raise ContractError(f"too few rows: {short}")
    return out


def first_valid(df: DataFrame, valid: Column, order: str, n: int) -> tuple[DataFrame, int]:
    """The first n valid rows by ``order``, and how many rows were looked at up to the n-th."""
    top = df.where(valid).orderBy(order).limit(n)
    last, got = top.agg(F.max(order), F.count("*")).first()
    looked = df.count() if got < n else df.where(F.col(order) <= last).count()
    return top, looked


def split_stats(df: DataFrame, split: str = "split", given: str = "input", output: str = "output") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.avg(F.length(given)).alias("avg_input"), F.avg(F.length(output)).alias("avg_output"))


def training_example(prompt: Column | str, output: Column | str, most: int, ignore: int = -100) -> Column:
    """Struct (input_ids, labels) of token arrays: the output is cut from the right, the prompt from the left, its labels masked."""
    p, o = col(prompt), F.slice(col(output), 1, most)
    room = F.greatest(F.lit(most) - F.size(o), F.lit(0))
    kept = F.when(room == 0, F.slice(p, 1, 0)).when(F.size(p) <= room, p).otherwise(F.slice(p, F.size(p) - room + 1, room))
    made = F.struct(F.concat(kept, o).alias("input_ids"), F.concat(F.transform(kept, lambda x: F.lit(ignore).cast("long")), o.cast("array<long>")).alias("labels"))
    return F.when(F.size(o) > 0, made)
