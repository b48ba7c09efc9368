"""Vector columns: arrays of numbers, computed in double precision."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def valid(a: Column | str, size: int | None = None) -> Column:
    """Not null or empty, all components finite, and of the given size."""
    a = col(a)
    ok = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & (F.size(a) == size) if size else ok, F.lit(False))


def hashed_terms(c: Column | str, dim: int = 64) -> Column:
    """Array of structs (idx, sign), one for each word: the hashed bag of words of the offline embedding."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"), F.lit(0))

    def term(h: Column) -> Column:
        sign = F.when(F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
        return F.struct((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("idx"), sign.alias("sign"))

    # hashed by a transform of its own, so that a word is hashed once
    return F.transform(F.transform(tokens, lambda t: F.sha2(t, 256)), term)


def hashed_embedding(c: Column | str, dim: int = 64) -> Column:
    """Unit vector of the hashed bag of words; zeros for a text without words. One fold over the words of a row."""
    zero = F.array_repeat(F.lit(0.0), dim)
    add = lambda v, t: F.transform(v, lambda x, k: x + F.when(k == t["idx"], t["sign"]).otherwise(0.0))
    raw = F.aggregate(hashed_terms(c, dim), zero, add)
    # transform over one-element arrays names the vector and its norm once
    sized = F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.transform(sized, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, 0.0).otherwise(x / s["n"])))[0]


def embed_query(text: str, dim: int = 64) -> list[float]:
    """The same embedding of one query text, on the driver."""
    import re

    v = [0.0] * dim
    for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+", text.lower()):
        d = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def low_rank_norm(a: Column | str, b: Column | str) -> Column:
    """Frobenius norm of the product BA of two matrices (arrays of rows), in an Arrow function."""
    @F.pandas_udf("double")
    def size(x: pd.Series, y: pd.Series) -> pd.Series:
        import numpy as np

        def one(p, q):
            p, q = np.array([list(r) for r in p], float), np.array([list(r) for r in q], float)
            return float(np.linalg.norm(q @ p)) if q.shape[1] == p.shape[0] else float(np.sqrt((p**2).sum() + (q**2).sum()))

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return size(col(a), col(b))


def hashed_weights(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, idx, weight) of the hashed bag of words before normalisation, for texts of any length."""
    t = df.select(id_col, F.explode(hashed_terms(text_col, dim)).alias("t"))
    return t.groupBy(id_col, F.col("t.idx").alias("idx")).agg(F.sum("t.sign").alias("weight"))
