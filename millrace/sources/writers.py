"""Writers."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.filters import ContractError
from millrace.operators.index import write_text


def flat_columns(schema: T.StructType, prefix: str = "") -> dict[str, Column]:
    """Leaf columns by dotted name; arrays and maps as JSON."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        c = F.col(".".join(f"`{x}`" for x in name.split(".")))
        if isinstance(f.dataType, T.StructType):
            out |= flat_columns(f.dataType, f"{name}.")
        else:
            out[name] = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c
    return out


def flatten(df: DataFrame) -> DataFrame:
    """One column per leaf, in order of name."""
    cols = flat_columns(df.schema)
    return df.select(*[cols[k].alias(k) for k in sorted(cols)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flatten(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Add run records to a log; a failed job leaves none of its rows."""
    df.write.mode("append").json(path)


def write_fingerprints(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The identities and fingerprints of documents, a JSON object a line, as a later audit reads them."""
    write_jsonl(docs.select("knowledge_id", "identity", "canonical", "fingerprint"), path, mode)


def write_report(spark: SparkSession, path: str, report: Mapping[str, Any]) -> None:
    """A small report (an audit, a manifest, a leakage report) as one JSON file."""
    write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as Markdown; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"a table of more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def prompt_names(case_id: str = "case_id", prompt: str = "prompt") -> Column:
    """A safe file name for a prompt: the case and twelve digits of its digest."""
    return F.concat(F.regexp_replace(case_id, r"(?U)[^\p{Alnum}_-]", "_"), F.lit("-"), F.substring(F.sha2(prompt, 256), 1, 12))
