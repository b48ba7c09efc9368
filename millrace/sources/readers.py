"""Readers. Every record comes with where it stood (file, ordinal), since rows of a DataFrame have no order of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import slug, strip
from millrace.operators.filters import ContractError


def located(df: DataFrame) -> DataFrame:
    """Add source_file and ordinal. Ordinals follow file and place, are unique, and have gaps."""
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "ordinal": F.monotonically_increasing_id()})


def data_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jsonl", "json", "csv")) -> DataFrame:
    """path and length of the data files below a folder, sorted; none is an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(path)
    out = df.select("path", "length").orderBy("path")
    if out.isEmpty():
        raise ContractError(f"no data files in {path}")
    return out


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return located(r.json(path))


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that are no objects of that schema with their file. Blank lines are neither."""
    lines = located(spark.read.text(path)).where(strip("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    object_ = F.startswith(strip("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()
    return parsed.where(object_).select("r.*", "source_file", "ordinal"), parsed.where(~object_).select("value", "source_file", "ordinal")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of whole-file JSON: those of a list, of an object's first list, or the object itself."""
    files = spark.read.text(path, wholetext=True).withColumn("source_file", F.col("_metadata.file_path"))
    v = files.withColumn("v", F.try_parse_json("value"))
    # members in their order; get_json_object takes a path column in SQL alone
    members = F.expr("transform(json_object_keys(value), k -> get_json_object(value, concat('$[\\'', k, '\\']')))")
    first = F.filter(members, lambda x: F.startswith(F.ltrim(x), F.lit("[")))
    whole = F.when(F.startswith(strip("value"), F.lit("[")), F.col("value")).when(F.size(first) > 0, F.get(first, F.lit(0))).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = v.select("source_file", F.posexplode(F.from_json(whole, f"array<struct<{schema}>>")).alias("ordinal", "r"))
    return rows.select("r.*", "source_file", "ordinal")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every value is a string."""
    return located(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a file by its ending: .jsonl, .json or .csv."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "jsonl":
        return jsonl(spark, path, schema)
    if kind == "json" and schema:
        return json_records(spark, path, schema)
    if kind == "json":
        return located(spark.read.option("multiLine", True).json(path))
    if kind == "csv":
        return csv(spark, path)
    raise ContractError(f"unsupported file type {kind!r}")


def corpus_files(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """One JSON object per ``*_corpus.json`` below a split's folder, with its project (the parent folder)."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_corpus.json").json(f"{path}/{split}")
    return located(df).withColumns({"split": F.lit(split), "project": F.element_at(F.split("source_file", "/"), -2)})


def grouped_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an object whose values are lists, with the key they stood under."""
    files = spark.read.text(path, wholetext=True).withColumn("source_file", F.col("_metadata.file_path"))
    by_key = files.select("source_file", F.explode(F.from_json("value", f"map<string,array<struct<{schema}>>>")).alias("group", "rs"))
    return by_key.select("source_file", "group", F.posexplode("rs").alias("ordinal", "r")).select("group", "ordinal", "source_file", "r.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per .txt, .md or .markdown file; empty ones are an error when read."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,markdown}").text(path, wholetext=True)
    df = df.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_file"))
    return df.withColumn("content", F.when(strip("content") == "", F.raise_error(F.concat(F.lit("empty document "), F.col("source_file")))).otherwise(F.col("content")))


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of the files in ZIP archives, decoded leniently. Nothing is unpacked to disk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        if not info.is_dir() and info.filename.endswith(suffix):
                            yield pd.DataFrame({"archive": [name], "member": [info.filename], "content": [z.read(info).decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, member string, content string")


def storage_members(members: DataFrame) -> DataFrame:
    """Members below the first (by name) ``output/<name>/storage/`` folder of their archive, with ``file``, their path in it."""
    found = members.withColumn("_root", F.nullif(F.regexp_extract("member", r"^((?:.*/)?output/[^/]+/storage/)", 1), F.lit(""))).where("_root IS NOT NULL")
    first = found.groupBy("archive").agg(F.min("_root").alias("_root"))
    return found.join(first, ["archive", "_root"]).withColumn("file", F.substr("member", F.length("_root") + 1)).drop("_root")


def before_after(members: DataFrame) -> DataFrame:
    """Pairs of a commit's before and after trees, joined on path: members named ``<commit>/before|after/<path>``."""
    m = members.withColumns({"commit": F.regexp_extract("member", r"([^/]+)/(?:before|after)/", 1), "side": F.regexp_extract("member", r"/(before|after)/", 1), "file": F.regexp_extract("member", r"/(?:before|after)/(.*)$", 1)})
    side = lambda s: m.where(F.col("side") == s).select("archive", "commit", "file", F.col("content").alias(s))
    return side("before").join(side("after"), ["archive", "commit", "file"])


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, page, text, error); a file that can't be read is one row with its error. Needs pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs pypdf") from e

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                try:
                    got = [(name, k, page.extract_text() or "", None) for k, page in enumerate(PdfReader(io.BytesIO(data)).pages)]
                except Exception as e:  # one bad file doesn't end the load
                    got = [(name, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(got, columns=["source_file", "page", "text", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, page int, text string, error string")


# What benchmark cases ask for.
TESTING_INSTRUCTION = (
    "Generate one complete, compilable JUnit Jupiter test class for the target Java method. "
    "Include the package declaration, required imports, test class, and meaningful assertions. "
    "Return only Java source code without explanations."
)
REFACTORING_INSTRUCTION = "Refactor the supplied Java code while preserving its behavior. Requested refactoring type: {}. Return the refactored code."


def unit_test_cases(spark: SparkSession, path: str, level: str = "source") -> DataFrame:
    """Benchmark cases of ``*_out.json`` lists: case_id from slugs and place, input with the chosen level of context.

    A project without a name is its file's; a class or method without one is ``class`` or ``method``, and a name of no usable
    character is ``unknown``.
    """
    if level not in ("source", "simple", "full"):
        raise ContractError(f"unknown context level {level!r}")
    names = ["project_name", "package", "class_name", "method_name", "file_name", "relative_path", "execute_path", "source_code", "simple_context", "full_context"]
    rows = json_records(spark, f"{path}/*_out.json", ", ".join(f"{n} string" for n in names))
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"_out\.json$", "")
    named = lambda c, other: F.coalesce(F.nullif(slug(strip(F.coalesce(F.col(c), other))), F.lit("")), F.lit("unknown"))
    parts = [named("project_name", stem), named("class_name", F.lit("class")), named("method_name", F.lit("method"))]
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    body = [F.concat(F.lit(f"Target {k}: "), text(c)) for k, c in (("package", "package"), ("class", "class_name"), ("method", "method_name"))]
    body.append(F.concat(F.lit("\nJava source under test:\n"), text("source_code")))
    if level != "source":
        body.append(F.when(text(f"{level}_context") != "", F.concat(F.lit(f"\n{level.title()} project context:\n"), text(f"{level}_context"))))
    ident = F.concat_ws(":", F.lit("testbench"), *parts, F.col("ordinal").cast("string"))
    return rows.select(ident.alias("case_id"), F.lit("testing").alias("task"), F.lit(TESTING_INSTRUCTION).alias("instruction"), F.concat_ws("\n", *body).alias("input"), F.lit(level).alias("context_level"), "source_file", *names)


def refactoring_cases(spark: SparkSession, path: str) -> DataFrame:
    """Pure refactorings with code before and after, the method's where there is one, else the file's.

    case_id is the record's own id after ``swe-refactor:``, its place in the file where it has none.
    """
    schema = "uniqueId string, type string, projectName string, commitId string, sourceCodeBeforeRefactoring string, sourceCodeAfterRefactoring string, sourceCodeBeforeForWhole string, sourceCodeAfterForWhole string, isPureRefactoring boolean"
    rows = json_records(spark, path, schema).where("isPureRefactoring")
    pick = lambda *cs: F.coalesce(*[F.when(strip(c) != "", strip(c)) for c in cs], F.lit(""))
    kind = strip(F.coalesce("type", F.lit("unspecified refactoring")))
    before, after = REFACTORING_INSTRUCTION.split("{}")
    return rows.select(
        F.concat(F.lit("swe-refactor:"), F.coalesce(F.nullif(strip("uniqueId"), F.lit("")), F.col("ordinal").cast("string"))).alias("case_id"),
        F.lit("refactoring").alias("task"), kind.alias("refactoring_type"), F.concat(F.lit(before), kind, F.lit(after)).alias("instruction"),
        pick("sourceCodeBeforeRefactoring", "sourceCodeBeforeForWhole").alias("input"), pick("sourceCodeAfterRefactoring", "sourceCodeAfterForWhole").alias("reference"),
        F.coalesce("projectName", F.lit("")).alias("project"), F.coalesce("commitId", F.lit("")).alias("commit_sha"),
        (F.coalesce(strip("sourceCodeBeforeRefactoring"), F.lit("")) == "").alias("whole_file"),
    )


BENCHMARKS = {"unit_tests": unit_test_cases, "refactorings": refactoring_cases}


def benchmark(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    key = name.strip().lower().replace("-", "_")
    if key not in BENCHMARKS:
        raise ContractError(f"unknown benchmark {name!r}; known: {', '.join(BENCHMARKS)}")
    return BENCHMARKS[key](spark, path, **options)


def adapter_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, module_key, layer, lora_a, lora_b) of safetensors files, matrices as arrays of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import numpy as np

        kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}
        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                size = int.from_bytes(data[:8], "little")
                head = json.loads(data[8 : 8 + size])
                rows = []
                for k, t in head.items():
                    if k == "__metadata__":
                        continue
                    raw = data[8 + size + t["data_offsets"][0] : 8 + size + t["data_offsets"][1]]
                    flat = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4") if t["dtype"] == "BF16" else np.frombuffer(raw, kinds[t["dtype"]])
                    rows.append((name, k, [list(map(float, r)) for r in flat.reshape(t["shape"])]))
                yield pd.DataFrame(rows, columns=["source_file", "tensor", "matrix"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path)
    t = files.select("path", "content").mapInPandas(run, "source_file string, tensor string, matrix array<array<double>>")
    t = t.withColumns({"module_key": F.regexp_extract("tensor", r"(layers\.\d+\..*?)\.lora_[AB]", 1), "side": F.lower(F.regexp_extract("tensor", r"\.(lora_[AB])", 1))}).where("side != ''")
    layer = F.coalesce(F.expr("try_cast(nullif(regexp_extract(module_key, 'layers\\\\.([0-9]+)', 1), '') as int)"), F.lit(-1))
    pick = lambda s: F.first(F.when(F.col("side") == s, F.col("matrix")), ignorenulls=True).alias(s)
    return t.groupBy("source_file", "module_key").agg(pick("lora_a"), pick("lora_b")).withColumn("layer", layer)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_matches(spark: SparkSession, path: str, digest: str, rows: int, df: DataFrame) -> None:
    """An error unless the files at ``path`` have that digest (of their digests in path order) and df that many rows."""
    import hashlib

    found = [r[0] for r in file_digests(spark, path).orderBy("path").select("sha256").collect()]  # one per source file
    whole = found[0] if len(found) == 1 else hashlib.sha256("\n".join(found).encode()).hexdigest()
    if whole != digest:
        raise ContractError("the source differs from its manifest")
    if (n := df.count()) != rows:
        raise ContractError(f"the source has {n} rows, its manifest {rows}")


def config(path: str, required: tuple[str, ...] = ()) -> dict:
    """A YAML file with ``defaults:`` files merged in below it; a lacking ``required`` key (dotted) is an error. Needs PyYAML."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML") from e
    from pathlib import Path

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    base: dict = {}
    for name in own.pop("defaults", []):
        base = merge(base, config(str(Path(path).parent / name)))
    out = merge(base, own)
    require_keys(out, required)
    return out


def require_keys(of: dict, dotted: tuple[str, ...]) -> None:
    """An error that names the dotted keys that a nested dict lacks."""

    def has(d: object, names: list[str]) -> bool:
        return not names or (isinstance(d, dict) and names[0] in d and has(d[names[0]], names[1:]))

    if missing := [k for k in dotted if not has(of, k.split("."))]:
        raise ContractError(f"the configuration lacks {', '.join(missing)}")


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
