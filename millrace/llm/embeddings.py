"""Near-duplicate vectors by an exact tiled comparison in PCA order.

Equal vectors of a label become one class first. Vectors are normalised and rotated to their principal
axes, largest variance first. Cosine >= t means a distance of at most sqrt(2 - 2t), so vectors further
apart than that along any leading axis cannot be linked: the first ``AXES`` axes are cut into cells of
that width and only neighbouring cells of a label meet. Cells are dealt out into blocks of about
``BLOCK`` vectors, and a pair of blocks is a tile: one task's work, of bounded size however many vectors
share a label. Within a tile, products are summed over leading dimensions first; the rest of a product is
at most the product of the two suffix norms, so most pairs are given up after ``STEP`` dimensions. Pairs
that remain are decided by the cosine of the original vectors in double precision. A tile returns each
vector's number of links and a star for each group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, look_up, read, table
from millrace.llm.graph import components, local_stars

BLOCK, STEP, AXES = 4096, 16, 2
#: Products that a step of a tile holds.
AT_ONCE = 1 << 19
SLACK = 1e-9
#: Components of a vector at most: the driver holds a square matrix of that side for each size.
WIDEST = 4096


def usable(v: str = "embedding"):
    """True for a vector that can be linked: not null, without null or non-finite components, not zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the second moments of the unit vectors, summed by the cluster over all rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for p in parts:
            if p["dim"].max() > WIDEST:
                raise ValueError(f"vectors of more than {WIDEST} components")
            for d, group in p.groupby("dim"):
                x = unit(np.stack(group["embedding"].to_list()).astype(np.float64))
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pd.DataFrame({"dim": d, "k": np.arange(d * d), "v": m.ravel()})

    sums = classes.select("dim", "embedding").mapInPandas(run, "dim int, k int, v double").groupBy("dim", "k").agg(F.sum("v").alias("v"))
    got = sums.toPandas()  # dim x dim numbers for each dimension, whatever the number of rows
    return {int(d): g.sort_values("k")["v"].to_numpy().reshape(int(d), int(d)) for d, g in got.groupby("dim")}


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(m: np.ndarray) -> np.ndarray:
    return np.linalg.eigh(m)[1][:, ::-1]


def linked(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` with cosine >= threshold (i < j where the two are the same tile side).

    Rows of ``a`` are taken some at a time, so that no step holds more than ``AT_ONCE`` products.
    """
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    steps = [*range(min(STEP, ra.shape[1]), ra.shape[1], STEP), ra.shape[1]]
    # what the dimensions from each step on can still add: at most the product of the two suffix norms
    rest_a, rest_b = ({k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0)) for k in steps} for r in (ra, rb))
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = max(1, AT_ONCE // max(len(b), 1))
    for at in range(0, len(a), rows):
        part, k = slice(at, at + rows), steps[0]
        lead = ra[part, :k] @ rb[:, :k].T
        i, j = np.nonzero(lead + np.outer(rest_a[k][part], rest_b[k]) >= threshold - SLACK)
        dot, i = lead[i, j], i + at
        if same:
            below = i < j
            i, j, dot = i[below], j[below], dot[below]
        for n in steps[1:]:
            dot += np.einsum("ij,ij->i", ra[i, k:n], rb[j, k:n])
            keep = dot + rest_a[n][i] * rest_b[n][j] >= threshold - SLACK
            i, j, dot, k = i[keep], j[keep], dot[keep], n
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            cos = np.einsum("ij,ij->i", a[i], b[j]) / (na[i] * nb[j])
        odd = ~np.isfinite(cos)
        cos[odd] = np.einsum("ij,ij->i", ua[i[odd]], ub[j[odd]])
        out_i.append(i[cos >= threshold])
        out_j.append(j[cos >= threshold])
    return np.concatenate(out_i), np.concatenate(out_j)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their sizes are equal and their cosine is
    at least ``threshold`` (> 0). Vectors that are null, zero, or hold null or non-finite components, and
    vectors without a label, link with nothing: n_links 0, own component. Rows without an id neither link nor count:
    n_links 0, component_id null, kept false. Rows that repeat an id with an equal vector and label are one vector (each
    row is returned); different vectors under one id are vectors of their own and count as such. Equal vectors are
    recognised by 128 bits of hash, so that the result is joined without moving vectors again. Extra columns are
    ignored. An empty table gives an empty result.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # floats travel as floats and are widened to compare
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("embedding"))
    v = v.withColumn("ok", usable() & F.col("label").isNotNull() & F.col("id").isNotNull())
    zero = F.lit(0.0).cast(kind[6:-1])
    v = v.withColumn("embedding", F.when(F.col("ok"), F.transform("embedding", lambda x: x + zero)))
    v = v.withColumn("key", F.struct("label", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")))
    classes = v.where("ok").groupBy("key").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("w"), F.first("embedding").alias("embedding"))
    classes = table(classes.select("key", "key.label", "embedding", "rep", "w", "key.dim"), "vectors")
    basis = {d: axes(m) for d, m in moments(classes).items()}
    width = float(np.sqrt(max(2 - 2 * threshold, 1e-12))) + 1e-9

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            spots = np.zeros((len(p), AXES), np.int64)
            for d in p["dim"].unique():
                at = np.flatnonzero(p["dim"].to_numpy() == d)
                x = unit(np.stack(p["embedding"].iloc[at].to_list()).astype(np.float64)) @ basis[int(d)][:, :AXES]
                spots[at, : x.shape[1]] = np.floor(x / width)
            yield p.assign(**{f"c{k}": spots[:, k] for k in range(AXES)})

    cs = [f"c{k}" for k in range(AXES)]
    schema = f"label string, embedding {kind}, rep long, w long, dim int, " + ", ".join(f"{c} long" for c in cs)
    placed = table(classes.drop("key").mapInPandas(cells, schema), "cells")
    key = ["label", "dim", *cs]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = sizes.select(*key, "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    name = F.struct(*key, "block")
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in key], F.col("block").alias("o_block"))
    near = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"d{k}") for k, x in enumerate(o)]) for o in product((-1, 0, 1), repeat=AXES)]))
    tiles = blocks.select(*key, "block", near.alias("d")).select(*key, "block", *[(F.col(f"c{k}") + F.col(f"d.d{k}")).alias(f"o_c{k}") for k in range(AXES)])
    tiles = tiles.withColumns({"o_label": F.col("label"), "o_dim": F.col("dim")}).join(other, [f"o_{c}" for c in key])
    tiles = tiles.withColumn("one", name).withColumn("two", F.struct(*[F.col(f"o_{c}").alias(c) for c in key], F.col("o_block").alias("block"))).where("one <= two")
    tiles = table(tiles.select("one", "two", F.monotonically_increasing_id().alias("tile")), "tiles")
    sides = tiles.select(F.col("one").alias("at"), "tile", F.lit(0).alias("side")).union(tiles.where("one < two").select("two", "tile", F.lit(1)))
    dealt = placed.join(sizes.select(*key, "blocks"), key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("at", name).join(sides, "at").select("tile", "side", "rep", "w", "dim", "embedding")

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("side", kind="stable")
        n = int((p["side"] == 0).sum())
        x, w, rep = np.stack(p["embedding"].to_list()).astype(np.float64), p["w"].to_numpy(), p["rep"].to_numpy()
        same = n == len(p)
        i, j = linked(x[:n], x[:n] if same else x[n:], basis[int(p["dim"].iloc[0])], threshold, same)
        j = j if same else j + n
        degree = np.zeros(len(p), np.int64)
        np.add.at(degree, i, w[j])
        np.add.at(degree, j, w[i])
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(p), np.int64)
        place[order] = np.arange(len(p))
        root = rep[order][local_stars(len(p), place[i], place[j])][place]
        some = degree > 0
        return pd.DataFrame({"rep": rep[some], "degree": degree[some], "root": root[some]})

    stars = table(dealt.groupBy("tile").applyInPandas(compare, "rep long, degree long, root long"), "stars")
    drop(tiles, placed)
    degrees = stars.groupBy("rep").agg(F.sum("degree").alias("degree"))
    comp = components(stars, "rep", "root").withColumnRenamed("node", "rep")
    known = classes.select("key", "rep", "w").join(degrees, "rep", "left").join(comp, "rep", "left")
    known = table(known.select("key", (F.coalesce("degree", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("c")), "named")
    drop(classes, stars, comp)
    rows = table(v.select("id", F.when(F.col("ok"), F.col("key")).alias("key")), "keys")
    out = look_up(rows, "key", known, "id").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings at cosine >= 0.93."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
