"""Evaluation: scores per row, grouped comparisons and adapter similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import code, text, vector
from millrace.functions.text import col

QUALITY = ["avg", "median", "min", "max"]


def mean(c: Column | str) -> Column:
    """Mean of what is a number; booleans count as 0 and 1; 0.0 where nothing is."""
    return F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0))


def median(c: Column | str) -> Column:
    return F.coalesce(F.median(col(c).cast("double")), F.lit(0.0))


def scores(df: DataFrame, by: Sequence[str] = (), reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """count, exact_match and token_f1 per group."""
    exact = (text.strip(F.coalesce(F.col(reference), F.lit(""))) == text.strip(F.coalesce(F.col(prediction), F.lit("")))).cast("double")
    rows = df.select(*by, exact.alias("e"), text.token_f1(reference, prediction).alias("f"))
    return rows.groupBy(*by).agg(F.count("*").alias("count"), mean("e").alias("exact_match"), mean("f").alias("token_f1"))


def rollup_scores(df: DataFrame, by: str, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """The scores of each group and of all (group null), in one pass."""
    exact = (text.strip(F.coalesce(F.col(reference), F.lit(""))) == text.strip(F.coalesce(F.col(prediction), F.lit("")))).cast("double")
    rows = df.select(by, exact.alias("e"), text.token_f1(reference, prediction).alias("f"))
    return rows.rollup(by).agg(F.count("*").alias("count"), mean("e").alias("exact_match"), mean("f").alias("token_f1"))


def testing_aggregate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    rates = ["contains_test_annotation", "has_assertion", "has_exception_test", "target_method_invocation_proxy", "trivial_test_smell"]
    q = "generated_test_quality_score"
    return df.groupBy(*by).agg(
        F.count("*").alias("count"), *[mean(r).alias(f"{r}_rate") for r in rates],
        mean(q).alias("avg_quality"), median(q).alias("median_quality"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"), mean("coverage_proxy_score").alias("avg_coverage_proxy"),
    )


def refactoring_aggregate(df: DataFrame, by: Sequence[str]) -> DataFrame:
    rates = ["output_non_empty", "output_differs_from_input"]
    means = ["normalized_edit_similarity", "code_health_delta_score", "cohesion_proxy_score", "coupling_proxy_score", "refactoring_quality_score"]
    deltas = ["predicted_complexity_delta", "predicted_loc_delta"]
    q = "refactoring_quality_score"
    return df.groupBy(*by).agg(
        F.count("*").alias("count"), *[mean(r).alias(f"{r}_rate") for r in rates], *[mean(m).alias(f"avg_{m}") for m in [*means, *deltas]],
        median(q).alias("median_quality"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"),
    )


def testing_rows(df: DataFrame, given: str = "input", prediction: str = "prediction") -> DataFrame:
    return df.withColumns(code.test_metrics(given, prediction))


def refactoring_rows(df: DataFrame, given: str = "input", reference: str = "expected_output", prediction: str = "prediction") -> DataFrame:
    """Add the refactoring metrics of each prediction; method lengths and edit similarity are the only Arrow functions."""
    out = code.with_code_metrics(code.with_code_metrics(df, given, "_in_"), prediction, "_out_")
    names = [c.removeprefix("_in_") for c in out.columns if c.startswith("_in_")]
    a, b = ({k: F.col(f"_{s}_{k}") for k in names} for s in ("in", "out"))
    m = text.text_metrics(given, reference, prediction)
    out = out.withColumns({"output_non_empty": m["output_non_empty"], "output_differs_from_input": m["output_differs_from_input"], "normalized_edit_similarity": code.edit_similarity(reference, prediction)})
    ok, differs = F.col("output_non_empty"), F.col("output_differs_from_input")
    out = out.withColumns({
        "predicted_complexity_delta": b["complexity_proxy_score"] - a["complexity_proxy_score"], "predicted_loc_delta": b["lines_of_code"] - a["lines_of_code"],
        "cohesion_proxy_score": code.cohesion(b), "coupling_proxy_score": code.coupling(b), "code_health_delta_score": code.health_delta(a, b, ok, differs),
    })
    quality = code.refactoring_quality(ok, differs, *[F.col(c) for c in ("normalized_edit_similarity", "code_health_delta_score", "cohesion_proxy_score", "coupling_proxy_score")])
    return out.withColumn("refactoring_quality_score", quality).drop(*[f"_{s}_{k}" for s in ("in", "out") for k in names])


def case_pivot(runs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """One row per case: status and score of each mode (``not_run`` where there is none) and the best mode, the first of equals."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(modes) for x in (m, k)]), F.col("mode"))
    aggs = []
    for m in modes:
        of = F.col("mode") == m
        aggs += [F.coalesce(F.max(F.when(of, F.col("status"))), F.lit("not_run")).alias(f"{m}_status"), F.max(F.when(of, F.col("score"))).alias(f"{m}_score")]
    best = F.max_by(F.when(F.col("score").isNotNull(), F.col("mode")), F.when(F.col("score").isNotNull(), F.struct("score", -order)))
    return runs.groupBy("case_id").agg(*aggs, F.coalesce(best, F.lit("")).alias("best_mode"))


def interference(metrics: DataFrame, shared: str, special: Mapping[str, str], model: str = "model", value: str = "value", task: str = "task") -> DataFrame:
    """(task, specialised, shared, difference, percent) of a shared model against each task's own; a model without a value is an error."""
    rows = None
    for t, m in special.items():
        of = metrics.where(F.col(task) == t).agg(F.max(F.when(F.col(model) == m, F.col(value))).alias("specialised"), F.max(F.when(F.col(model) == shared, F.col(value))).alias("shared"))
        of = of.select(F.lit(t).alias("task"), "*")
        rows = of if rows is None else rows.unionAll(of)
    for c, who in (("specialised", "its specialised model"), ("shared", f"the shared model {shared}")):
        missing = F.raise_error(F.concat(F.lit("task "), F.col("task"), F.lit(f" has no value of {who}")))
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), missing).otherwise(F.col(c)))
    gap = F.col("shared") - F.col("specialised")
    return rows.withColumns({"difference": gap, "percent": F.when(F.col("specialised") != 0, 100 * gap / F.col("specialised"))})


def best(df: DataFrame, metric: str, name: str = "model", lower: bool = False, order: str | None = None) -> DataFrame:
    """One row: the best name; of equals the first by ``order`` (by name without one)."""
    rank = -F.col(metric) if lower else F.col(metric)
    tie = F.col(order or name)
    return df.orderBy(rank.desc_nulls_last(), tie).limit(1).select(name, metric)


def pair_similarity(modules: DataFrame, pairs: Sequence[tuple[str, str]], key: str = "module_key", model: str = "model", vec: str = "vector") -> DataFrame:
    """(left, right, key, cosine, l2) of the modules that two models share. The list of pairs is a parameter."""
    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs]))
    a = modules.select(key, F.col(model).alias("left"), F.col(vec).alias("va")).withColumn("p", wanted).where("left = p.left").select(key, "left", F.col("p.right").alias("right"), "va")
    b = modules.select(key, F.col(model).alias("right"), F.col(vec).alias("vb"))
    return a.join(b, [key, "right"]).select("left", "right", key, vector.cosine("va", "vb").alias("cosine"), vector.l2("va", "vb").alias("l2"))


def all_similarities(modules: DataFrame, key: str = "module_key", model: str = "model", vec: str = "vector") -> DataFrame:
    """The same for all models that share a module, each two once, the lesser name on the left: joined by module on the cluster."""
    a = modules.select(key, F.col(model).alias("left"), F.col(vec).alias("va"))
    b = modules.select(key, F.col(model).alias("right"), F.col(vec).alias("vb"))
    return a.join(b, key).where("left < right").select("left", "right", key, vector.cosine("va", "vb").alias("cosine"), vector.l2("va", "vb").alias("l2"))


def similarity_levels(rows: DataFrame, *levels: str) -> DataFrame:
    """mean, median cosine and mean L2 per pair by each level and overall, in one pass of grouping sets."""
    sets = [["left", "right", x] for x in levels] + [["left", "right"]]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "left", "right", *levels)
    return out.agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"), F.median("cosine").alias("median_cosine"), F.avg("l2").alias("mean_l2"))


def closest_pair(layers: DataFrame, layer: str = "layer", pair: str = "pair", value: str = "cosine", tie: float = 1e-12) -> DataFrame:
    """(layer, closest) with ``tie`` where the two highest are within ``tie`` of each other."""
    w = Window.partitionBy(layer).orderBy(F.desc(value), pair)
    top = layers.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(layer)
    out = top.agg(F.max(F.when(F.col("_r") == 1, F.col(pair))).alias("p"), F.max(F.when(F.col("_r") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("b"))
    return out.select(layer, F.when(F.col("a") - F.col("b") <= tie, "tie").otherwise(F.col("p")).alias("closest"))


def top_groups(df: DataFrame, by: str, item: str, value: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(value), item)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def layer_norms(modules: DataFrame, models: Sequence[str], layer: str = "layer", model: str = "model", value: str = "norm") -> DataFrame:
    """One row per layer from 0 on: sum, mean, max and count of the modules' norms of each model, wide by model."""
    rows = modules.where(F.col(layer) >= 0).groupBy(layer).pivot(model, list(models))
    return rows.agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))


def samples(rows: DataFrame, per: int = 2, most: int = 6, clip: int = 2000, model: str = "model_name", order: str = "id", texts: Sequence[str] = ("input", "expected_output", "prediction")) -> DataFrame:
    """Rows to show: the first ``per`` of each model, ``most`` in all, long texts clipped."""
    w = Window.partitionBy(model).orderBy(order)
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).orderBy(model, order).limit(most).drop("_r")
    return top.withColumns({c: F.substring(c, 1, clip) for c in texts if c in rows.columns})


def module_norms(modules: DataFrame, a: str = "lora_a", b: str = "lora_b") -> DataFrame:
    """Norms of both factors, of their product's bound and of the product, for matrices as arrays of rows."""
    flat = lambda c: vector.norm(F.flatten(F.col(c)))
    return modules.withColumns({"a_norm": flat(a), "b_norm": flat(b)}).withColumns({"proxy_norm": F.col("a_norm") * F.col("b_norm"), "delta_norm": vector.low_rank_norm(a, b)})
