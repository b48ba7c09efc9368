"""Predictions, training logs, data set preparation, structured answers and single cells of an experiment."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import col, first_filled, retrieval_query, strip, strip_fence
from millrace.operators import filters, leakage, matrix, prep, prompt, retrieve
from millrace.operators.filters import ContractError

# The names under which prediction files keep the same thing, and the fields that answers need.
PREDICTION_FIELDS = {"input": ["input", "prompt", "code_before"], "expected_output": ["expected_output", "output", "code_after", "reference_output"], "prediction": ["prediction", "generated_output", "output_prediction"]}
ANSWER_FIELDS = {"testing": ["task_type", "analysis_summary", "generated_tests"], "refactoring": ["task_type", "analysis_summary", "refactored_code"]}


def predictions(df: DataFrame, task: str, model: str, ordinal: str = "ordinal") -> DataFrame:
    """id, task, model_name, source, domain, input, expected_output, prediction of raw prediction rows; an id that is lacking is made of
    model, task and place."""
    pick = lambda names, other: F.coalesce(F.nullif(first_filled(*[n for n in names if n in df.columns]), F.lit("")), other) if any(n in df.columns for n in names) else other
    have = lambda n, other: F.coalesce(F.col(n).cast("string"), F.lit(other)) if n in df.columns else F.lit(other)
    ident = pick(["id", "sample_id", "refactoring_id"], F.concat(F.lit(f"{model}:{task}:"), F.col(ordinal).cast("string")))
    sides = [pick(names, F.lit("")).alias(k) for k, names in PREDICTION_FIELDS.items()]
    return df.select(ident.alias("id"), F.lit(task).alias("task"), F.lit(model).alias("model_name"), have("source", "").alias("source"), have("domain", task).alias("domain"), *sides)


def with_metrics(rows: DataFrame, metrics: DataFrame, n: int | None = None) -> DataFrame:
    """Predictions with their metrics by model and id (null where there are none); with ``n`` the first of them by model and id."""
    out = rows.join(metrics, ["model_name", "id"], "left")
    return out if n is None else out.orderBy("model_name", "id").limit(n)


def used_in_prompt(hits: DataFrame, used: DataFrame, key: Sequence[str] = ("query_id", "document_id")) -> DataFrame:
    """Hits with used_in_prompt: whether the prompt holds them."""
    return hits.join(used.select(*key).distinct().withColumn("_u", F.lit(True)), list(key), "left").withColumn("used_in_prompt", F.coalesce("_u", F.lit(False))).drop("_u")


def status_counts(runs: DataFrame, status: str = "status") -> DataFrame:
    return runs.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the path with the highest number after ``checkpoint-``; no row where none has one."""
    step = F.expr(f"try_cast(nullif(regexp_extract(`{path}`, 'checkpoint-([0-9]+)/*$', 1), '') as bigint)")
    top = paths.select(path, step.alias("step")).where("step IS NOT NULL").agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))
    return top.where("step IS NOT NULL")


def longest_example(df: DataFrame, given: str = "input", output: str = "output", order: str = "ordinal") -> DataFrame:
    """One row: the record with the most characters on both sides, the first of equal ones."""
    size = F.length(F.coalesce(given, F.lit(""))) + F.length(F.coalesce(output, F.lit("")))
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(size, -F.col(order))).alias("r")).select("r.*").where(F.col(order).isNotNull())


def losses(log: DataFrame, step: str = "step", by: Sequence[str] = ()) -> DataFrame:
    """best_eval_loss, last_eval_loss, last_train_loss of a log whose rows have eval_loss or loss, per ``by`` where given."""
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(step)))
    return log.groupBy(*by).agg(F.min("eval_loss").alias("best_eval_loss"), last("eval_loss").alias("last_eval_loss"), last("loss").alias("last_train_loss"))


def refactoring_mix(parts: Mapping[str, DataFrame], seed: int = 42, key: str = "ordinal") -> DataFrame:
    """The records of all parts (domain, input, output, ...) that are fit for training, in a seeded order: position from 1 on."""
    rows = None
    for name, df in parts.items():
        one = df.withColumn("part", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    good = rows.where(filters.valid_refactoring_pair("input", "output"))
    return prep.ranks(good, [prep.order_key(seed, "part", key), "part", key], "position")


def prepare(df: DataFrame, group: Column, ratios: Mapping[str, float], seed: int = 42, most_in: int = 12_000, most_out: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """Fit records split by whole groups, and the audit of the splits: groups in several (none, or it is an error)."""
    good = df.where(filters.valid_refactoring_pair("input", "output", most_in, most_out)).withColumn("_group", group)
    out = prep.group_split_by_ratio(good.where(F.col("_group").isNotNull()), "_group", ratios, seed)
    leakage.require_disjoint(out, "_group", "split")
    return out.drop("_group"), prep.split_stats(out)


def archive_report(spark: SparkSession, path: str, shown: int = 20) -> tuple[DataFrame, int]:
    """The first ZIP archives below a folder by path with their sizes, and how many there are. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "length")
    return files.orderBy("path").limit(shown), files.count()


def require_below(paths: Sequence[str], root: str) -> None:
    """An error if a path is not the root itself or inside it once dots are resolved."""
    import posixpath

    base = posixpath.normpath(root)
    if bad := [p for p in paths if posixpath.normpath(p) != base and not posixpath.normpath(p).startswith(base + "/")]:
        raise ContractError(f"outside {root}: {', '.join(bad)}")


def answers(df: DataFrame, task: str, raw: str = "raw") -> DataFrame:
    """Add answer (a map of the response's fields as JSON text) and errors: what keeps a response from being a valid answer.

    The response is one JSON object, in a Markdown fence or not, that has all fields its task needs as text that isn't null.
    """
    body = strip_fence(raw)
    parsed = F.try_parse_json(body)
    object_ = F.coalesce(F.startswith(body, F.lit("{")) & parsed.isNotNull(), F.lit(False))
    value = lambda f: F.try_variant_get(parsed, f"$.{f}", "string")
    lacking = [F.when(value(f).isNull(), F.lit(f"{f}: field required")) for f in ANSWER_FIELDS[task]]
    wrong = F.when(value("task_type").isNotNull() & (value("task_type") != task), F.lit(f"task_type: not {task}"))
    errors = F.when(~object_, F.array(F.lit("no JSON object"))).otherwise(F.filter(F.array(*lacking, wrong), lambda x: x.isNotNull()))
    made = F.create_map(*[x for f in ANSWER_FIELDS[task] for x in (F.lit(f), value(f))])
    return df.withColumns({"errors": errors, "answer": F.when(F.size(errors) == 0, made)})


def repaired(raw: Column | str, errors: Column, schema: Mapping) -> Column:
    """The prompt that asks for the same answer in the right form."""
    # Fixed value: the wording of the request.
    lead = F.lit("Repair only the JSON structure and required fields. Do not add commentary or markdown.\nValidation errors: ")
    return F.concat(lead, F.to_json(errors), F.lit(f"\nRequired JSON Schema: {json.dumps(schema, sort_keys=True)}\nInvalid response: "), F.coalesce(col(raw), F.lit("")))


def structured(prompts: DataFrame, model: Callable, task: str, retries: int = 2, schema: Mapping | None = None, save: Callable[[DataFrame, int], DataFrame] = lambda df, k: df) -> DataFrame:
    """Answers to prompts (prompt and other columns), with bounded repairs: answer, errors, attempts, and the last raw response.

    Each round asks the model only for rows that are not valid yet, with the errors found. ``save`` may write a round's rows and
    read them back, so that no answer is asked for twice when a task is repeated. Rows still invalid at the end keep their errors.
    """
    if retries < 0:
        raise ContractError("retries must not be negative")
    keep = [c for c in prompts.columns if c != "prompt"]
    open_, done = prompts, None
    for k in range(retries + 1):
        got = retrieve.generate(open_, model).withColumnRenamed("output", "raw").drop("status", "error")
        got = save(answers(got, task).withColumn("attempts", F.lit(k + 1)), k)
        good = got if k == retries else got.where(F.size("errors") == 0)
        done = good if done is None else done.unionByName(good)
        bad = got.where(F.size("errors") > 0)
        if k == retries or bad.isEmpty():
            break
        open_ = bad.select(*keep, repaired("raw", F.col("errors"), schema or {}).alias("prompt"))
    return done.drop("prompt")


def run_cells(cases: DataFrame, docs: DataFrame, request: retrieve.Request, model: Callable, embed: Callable[[DataFrame], DataFrame], task: str, window: int = 4096, reserve: int = 1024, margin: int = 256) -> DataFrame:
    """Whole cells of an experiment in one plan: query, retrieval, budget, prompt, generation, record.

    cases: query_id, task, input and what :func:`millrace.operators.prompt.build` takes. ``embed`` adds ``embedding`` to (query_id, query).
    A record has the prompt's hashes, its tokens, the documents found and used, the output, status and error.
    """
    queries = embed(cases.select("query_id", retrieval_query(task, "input").alias("query")))
    approach = {"none": "direct", "single": "rag", "multi": "multi_rag"}[request.mode]
    direct = prompt.build(cases.drop("evidence"), "direct")
    if approach == "direct":
        ready = direct.withColumns({"retrieved": F.array().cast("array<string>"), "used": F.array().cast("array<string>"), "retrieval_tokens": F.lit(0)})
    else:
        hits = retrieve.retrieve(queries, docs, request).select("query_id", F.col("document_id").cast("string").alias("document_id"), "content", "score", "final_rank")
        fixed = direct.agg(F.max(F.ceil(F.length("prompt") / 4))).first()[0] or 0
        chosen = retrieve.select_context(hits, int(fixed), window, reserve, margin, request.budget).where("content IS NOT NULL")
        source = docs.select(F.col("document_id").cast("string").alias("document_id"), F.col("collection").alias("source")).dropDuplicates(["document_id"])
        shown = chosen.withColumnRenamed("position", "final_rank").join(hits.select("query_id", "document_id", "score"), ["query_id", "document_id"]).join(source, "document_id")
        evidence = retrieve.render(shown, grouped=request.mode == "multi").withColumnRenamed("context", "evidence")
        found = hits.groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("retrieved"))
        used = chosen.groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("used"), F.sum("tokens").cast("int").alias("retrieval_tokens"))
        with_evidence = cases.drop("evidence").join(evidence, "query_id", "left").join(found, "query_id", "left").join(used, "query_id", "left")
        some = F.coalesce(strip("evidence"), F.lit("")) != ""
        ready = prompt.build(with_evidence.where(some), approach).unionByName(prompt.build(with_evidence.where(~some), "direct"))
    ready = ready.withColumn("prompt_tokens", F.ceil(F.length("prompt") / 4).cast("int"))
    ready = ready.withColumn("within_window", F.col("prompt_tokens") + reserve + margin <= window)
    return retrieve.generate(ready, model)


def report_files(runs: DataFrame, planned: int, fairness: DataFrame | None = None) -> dict[str, str]:
    """The files of a matrix report by name: overview, per cell, failures, cases, retrieval and Markdown. Reports are small: one
    row per cell kind, case or error type."""
    last = matrix.latest(runs)
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    cells, failed = rows(matrix.summary(last).orderBy("task", "mode")), rows(matrix.failures(last).orderBy("error_type")) if "error_type" in last.columns else []
    states = {r["status"]: r["n"] for r in rows(status_counts(last))}
    overview = {"planned_runs": planned, "completed_runs": sum(states.values()), "status": states, "complete": states.get("success", 0) == planned}
    table = ["| task | mode | success | failed | average score |", "|-|-|-|-|-|", *(f"| {c['task']} | {c['mode']} | {c['success']} | {c['failed']} | {c.get('average_score', '')} |" for c in cells)]
    out = {
        "summary.json": json.dumps(overview, indent=2, sort_keys=True) + "\n", "cells.jsonl": "".join(json.dumps(c, sort_keys=True) + "\n" for c in cells), "failures.jsonl": "".join(json.dumps(f, sort_keys=True) + "\n" for f in failed),
        "report.md": "# Runs\n\n" + f"{overview['completed_runs']} of {planned} planned runs.\n\n" + "\n".join(table) + "\n",
    }
    if fairness is not None:
        checked = rows(fairness.select("case_id", "passed").orderBy("case_id"))
        out["fairness.json"] = json.dumps({"passed": bool(checked) and all(c["passed"] for c in checked), "cases": checked}, indent=2, sort_keys=True) + "\n"
    return out


def interference_report(table: DataFrame) -> dict[str, str]:
    """Markdown, LaTeX and CSV of an interference table (task, specialised, shared, difference, percent)."""
    names = ["task", "specialised", "shared", "difference", "percent"]
    rows = [[r["task"], *[f"{r[n]:.4f}" if r[n] is not None else "" for n in names[1:]]] for r in table.orderBy("task").collect()]  # one row per task
    head, rule = "| " + " | ".join(names) + " |", "|" + "-|" * len(names)
    latex = ["\\begin{tabular}{lrrrr}", " & ".join(names) + r" \\ \hline", *(" & ".join(r).replace("_", r"\_") + r" \\" for r in rows), "\\end{tabular}"]
    return {"interference.md": "\n".join([head, rule, *("| " + " | ".join(r) + " |" for r in rows)]) + "\n", "interference.tex": "\n".join(latex) + "\n", "interference.csv": "\n".join(",".join(r) for r in [names, *rows]) + "\n"}
