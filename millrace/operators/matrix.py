"""Resumable matrices of runs: plans, latest attempts and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.filters import should_run
from millrace.operators.retrieve import generate


def latest(runs: DataFrame, key: Sequence[str] = ("run_id",), attempt: str = "attempt", order: str = "ordinal") -> DataFrame:
    """The last attempt of each run, of equal attempts the later row. Maxima are combined before the shuffle, so a run
    with very many attempts is no hot group."""
    others = [c for c in runs.columns if c not in key]
    top = runs.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(attempt, order)).alias("r"))
    return top.select(*key, "r.*").select(*runs.columns)


def plan(cells: DataFrame, history: DataFrame, key: Sequence[str] = ("run_id",), force: bool = False, retry_failed: bool = False) -> DataFrame:
    """Planned cells with the status of their last attempt and whether they run now."""
    last = latest(history, key).select(*key, F.col("status").alias("last_status"))
    return cells.join(last, list(key), "left").withColumn("runs", should_run("last_status", force, retry_failed))


def run(cells: DataFrame, history: DataFrame, model: Callable, now: str, key: Sequence[str] = ("run_id",), force: bool = False, retry_failed: bool = False) -> DataFrame:
    """The records of the cells that run now: output, status, error, attempt (one more than the last) and time.

    A cell that fails is a row with its error and doesn't end the others; append the rows to the history to resume later. cells: the key,
    prompt and other columns.
    """
    todo = plan(cells, history, key, force, retry_failed).where("runs").drop("runs", "last_status")
    tries = history.groupBy(*key).agg(F.max("attempt").alias("_a"))
    ready = todo.join(tries, list(key), "left").withColumn("attempt", F.coalesce(F.col("_a"), F.lit(0)) + 1).drop("_a")
    return generate(ready, model).withColumn("started_at", F.lit(now))


def summary(runs: DataFrame, by: Sequence[str] = ("task", "mode")) -> DataFrame:
    return runs.groupBy(*by).agg(
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("score"), 6).alias("average_score")
    )


def failures(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'failed'").groupBy(F.coalesce("error_type", F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def retrieval_analysis(runs: DataFrame, by: str = "mode") -> DataFrame:
    """Means per mode of documents retrieved and used, tokens, and suspected truncations (fewer prompt tokens seen than 90 %)."""
    cut = F.coalesce(F.col("prompt_eval_count") < 0.9 * F.col("prompt_tokens"), F.lit(False))
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.avg(F.size("retrieved")).alias("mean_retrieved"), F.avg(F.size("used")).alias("mean_used"), F.avg("retrieval_tokens").alias("mean_tokens"), F.count_if(cut).alias("suspected_truncations")
    )


def fair(prompts: DataFrame, case: str = "case_id", normalized: str = "normalized") -> DataFrame:
    """(case_id, variants, fair): whether all modes of a case have the same prompt once evidence is taken out."""
    return prompts.groupBy(case).agg(F.count_distinct(F.sha2(normalized, 256)).alias("variants")).withColumn("fair", F.col("variants") == 1)
