"""Predicates and contracts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.code import ASSERTION_MARKERS
from millrace.functions.text import col, strip


class ContractError(ValueError):
    """A table breaks a contract it was to fulfil."""


def length_between(c: Column | str, low: int, high: int) -> Column:
    return F.coalesce(F.length(strip(c)).between(low, high), F.lit(False))


def valid_test_pair(given: Column | str, output: Column | str, in_max: int = 4000, out_max: int = 6000, low: int = 50) -> Column:
    """Both of a fair length and the output holds an assertion."""
    asserts = F.coalesce(col(output).rlike("|".join(re.escape(m) for m in ASSERTION_MARKERS)), F.lit(False))
    return length_between(given, low, in_max) & length_between(output, low, out_max) & asserts


def valid_refactoring_pair(before: Column | str, after: Column | str, in_max: int = 12_000, out_max: int = 12_000, low: int = 50, must_differ: bool = False) -> Column:
    ok = length_between(before, low, in_max) & length_between(after, low, out_max)
    return ok & (strip(before) != strip(after)) if must_differ else ok


def candidate_code_file(path: Column | str, length: Column | str) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.contains(name, F.lit(".java")) & ~F.contains(name, F.lit("-astc")) & (col(length) > 0)


def usable_page(c: Column | str, minimum: int = 20) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^\p{L}\p{N}]", "")) >= minimum


def specific_identity(**parts: Column) -> Column:
    """An identity that names one case, file or method and not just a data set: a case id, or a repository with commit and
    file path, or a repository with class and method. Parts that aren't given count as empty."""
    has = lambda *ks: reduce(and_, [F.coalesce(parts[k].cast("string"), F.lit("")) != "" if k in parts else F.lit(False) for k in ks])
    return has("case_id") | has("repository", "commit", "file_path") | has("repository", "class_name", "method_name")


def metadata_predicate(wanted: Mapping[str, Any], allowed_splits: Sequence[str], split_col: str = "split") -> Column:
    """Equality or membership for each key, and the splits that may be read. Asking for another split is an error."""
    if not allowed_splits:
        raise ContractError("no split may be read")
    asked = wanted.get(split_col)
    if asked is not None and not set(asked if isinstance(asked, (list, tuple, set)) else [asked]) <= set(allowed_splits):
        raise ContractError("the filter asks for a split that may not be read")
    out = F.col(split_col).isin(*allowed_splits)
    for k, v in wanted.items():
        if k == split_col:
            continue
        if isinstance(v, (list, tuple, set)):
            if not v:
                raise ContractError(f"filter {k!r} has no values")
            out = out & F.col(k).isin(*v)
        else:
            out = out & (F.col(k) == v)
    return out


def require(df: DataFrame, good: Column, what: str, order: str | None = None) -> DataFrame:
    """df itself, or an error that says how many rows break the contract and which comes first. One pass."""
    bad = ~F.coalesce(good, F.lit(False))
    first = F.min(F.when(bad, F.col(order))) if order else F.lit(None)
    n, at = df.agg(F.count_if(bad), first).first()
    if n:
        raise ContractError(f"{n} rows are not {what}" + (f"; the first is {at}" if at is not None else ""))
    return df


def require_count(df: DataFrame, n: int, what: str) -> DataFrame:
    if (found := df.count()) != n:
        raise ContractError(f"{what}: {found} rows instead of {n}")
    return df


def require_splits(df: DataFrame, allowed: Sequence[str], split_col: str = "split") -> DataFrame:
    """The indexing gate: no row of another split."""
    return require(df, F.col(split_col).isin(*allowed), f"of the splits {', '.join(allowed)}")


def should_run(status: Column | str, force: bool = False, retry_failed: bool = False) -> Column:
    """Whether a planned cell runs, from the status of its last attempt (null: never run)."""
    s = col(status)
    return F.lit(True) if force else F.when(s.isNull(), not retry_failed).when(s == "success", False).otherwise(retry_failed)


def select_runs(cases: DataFrame, modes: DataFrame, tasks: Sequence[str] = (), difficulties: Sequence[str] = (), case_ids: Sequence[str] = ()) -> DataFrame:
    """Planned cells: the chosen cases with every mode. ``modes`` is the short list of a study, at most some dozens of rows."""
    known = {r[0] for r in cases.where(F.col("case_id").isin(*case_ids)).select("case_id").distinct().collect()} if case_ids else set()
    if missing := sorted(set(case_ids) - known):
        raise ContractError(f"unknown cases: {', '.join(map(str, missing))}")
    for name, values in (("task", tasks), ("difficulty", difficulties), ("case_id", case_ids)):
        if values:
            cases = cases.where(F.col(name).isin(*values))
    names = [r[0] for r in modes.select("mode").limit(1001).collect()]
    if len(names) > 1000:
        raise ContractError("more than 1000 modes")
    return cases.withColumn("mode", F.explode(F.array(*map(F.lit, names)))) if names else cases.withColumn("mode", F.lit(None).cast("string")).limit(0)
