"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by a walk over pairs of trie nodes.

The fingerprints form a binary trie. Two subtries can hold a linked pair only if the bits on the way to
their roots differ in at most ``budget`` places, so the self-join walks pairs of nodes downwards, adds up
differing bits and prunes a pair once the budget is spent. The top ``depth`` bits are walked by the
cluster: each fingerprint visits the nodes within the budget of its own. The rest is walked inside a
task, level by level with NumPy. ``depth`` follows the number of distinct fingerprints, so a node holds
about ``NODE`` of them; a node that holds far more (a hot group) is split into blocks of at most about
``BLOCK`` owners and every visitor meets each block, so no task gets an unbounded group. A task returns a star for each
group of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, fresh, look_up, read, table
from millrace.llm.graph import components, local_stars

if TYPE_CHECKING:
    import pyarrow as pa

NODE, BLOCK, DEEPEST = 256, 4096, 24
#: Hot nodes, at most one for every ``BLOCK`` classes, that are broadcast; more are joined by a shuffle.
FEW = 200_000
#: Classes of a candidate group that a task compares with all others of the group.
EXACT = 256
#: Index pairs that a step of the local walk compares at once.
AT_ONCE = 1 << 20


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text; zero for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    k = min(shingle, len(words))
    ends = (start + size)[k - 1 :].tolist()
    digest, spots = xxhash.xxh64_intdigest, zip(start.tolist(), ends, strict=False)
    h = np.fromiter((digest(joined[a:b], seed) for a, b in spots), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long. Null and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in b.column("_text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, "id long, fp long")


def _pairs(lo1, hi1, lo2, hi2, same) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All index pairs of the given range pairs, in bounded steps: which pair, index on the left, index on the right."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    size = n1 * n2
    cut = np.searchsorted(np.cumsum(size), np.arange(AT_ONCE, size.sum() + AT_ONCE, AT_ONCE), side="left") + 1
    at = 0
    for end in cut:
        end = min(int(end), len(size))
        if end <= at:
            continue
        s = size[at:end]
        which = np.repeat(np.arange(at, end), s)
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        i, j = lo1[which] + k // n2[which], lo2[which] + k % n2[which]
        at = end
        ok = i < j if same else slice(None)
        yield which[ok], i[ok], j[ok]


def walk(a: np.ndarray, b: np.ndarray | None, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of sorted, distinct uint64 arrays whose low ``bits`` bits differ in at most ``budget`` places.

    The bits above agree within an array. With ``b`` None: pairs i < j within ``a``.
    """
    same = b is None
    b = a if same else b
    none = np.empty(0, np.int64)
    if not len(a) or not len(b):
        return none, none
    f = [np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)]
    out_i, out_j = [none], [none]
    for bit in range(bits - 1, -2, -1):
        lo1, hi1, lo2, hi2, used = f
        leaf = ((hi1 - lo1) * (hi2 - lo2) <= 256) if bit >= 0 else np.ones(len(lo1), bool)
        if leaf.any():
            for _, i, j in _pairs(lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf], same):
                near = np.bitwise_count((a[i] ^ b[j]) & np.uint64((1 << bits) - 1)) <= budget
                out_i.append(i[near])
                out_j.append(j[near])
        if leaf.all():
            break
        lo1, hi1, lo2, hi2, used = (x[~leaf] for x in f)
        one = np.uint64(1 << bit)
        mid = []
        for v, lo, hi in ((a, lo1, hi1), (b, lo2, hi2)):
            # within a node the bits above agree, so the values with this bit set start at one place
            first = (v[lo] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
            mid.append(np.clip(np.searchsorted(v, first), lo, hi))
        m1, m2 = mid
        del one
        sides = [(lo1, m1, lo2, m2, used), (m1, hi1, m2, hi2, used), (lo1, m1, m2, hi2, used + 1), (m1, hi1, lo2, m2, used + 1)]
        if same:  # an inner pair of a node with itself has its mixed children once
            sides[3] = tuple(x[(lo1 != lo2)] for x in sides[3])
        f = [np.concatenate(x) for x in zip(*sides, strict=True)]
        keep = (f[1] > f[0]) & (f[3] > f[2]) & (f[4] <= budget)
        f = [x[keep] for x in f]
        if not len(f[0]):
            break
    return np.concatenate(out_i), np.concatenate(out_j)


def _hot(placed: DataFrame, *node: str) -> DataFrame:
    """node, blocks: the nodes that hold more than ``BLOCK`` classes and the blocks they are split into."""
    hot = placed.groupBy(*node).count().where(F.col("count") > BLOCK)
    hot = table(hot.select(*node, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    return F.broadcast(hot) if hot.count() <= FEW else hot


def links(classes: DataFrame, budget: int = 2) -> DataFrame:
    """Stars (a, b) that connect the classes whose fingerprints differ in 1 to ``budget`` bits.

    ``classes``: (fp, rep) with distinct fp. Every link between two classes is found; the stars have the
    same components as the links.
    """
    n = classes.count()
    depth = max(0, min(DEEPEST, ceil(log2(max(n, 1) / NODE)))) if n > NODE else 0
    masks = [sum(1 << p for p in c) for k in range(min(budget, depth) + 1) for c in combinations(range(depth), k)]
    low = 64 - depth
    node = F.shiftrightunsigned("fp", low) if depth else F.lit(0).cast("long")
    own = classes.withColumn("node", node)
    hot = _hot(own, "node")
    own = own.join(hot, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    tries = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    seen = own.select("node", "fp", "rep", "block", tries.alias("mask"))
    seen = seen.select(F.col("node").bitwiseXOR(F.col("mask")).alias("at"), "node", "fp", "rep", "mask", F.col("block").alias("of"))
    seen = seen.where("at <= node").join(hot.withColumnRenamed("node", "at"), "at", "left")
    # a visitor meets every block of the node; of its own node, its own block and those before it
    last = F.when(F.col("mask") == 0, F.col("of")).otherwise(F.coalesce("blocks", F.lit(1)) - 1)
    seen = seen.withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    seen = seen.select(
        "at", "block", "fp", "rep", F.bit_count("mask").cast("int").alias("used"),
        ((F.col("mask") == 0) & (F.col("of") == F.col("block"))).alias("owner"),
    )

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        v = p["fp"].to_numpy(np.int64, copy=True).view(np.uint64)
        order = np.argsort(v, kind="stable")
        v, rep = v[order], p["rep"].to_numpy()[order]
        owner, used = p["owner"].to_numpy(bool)[order], p["used"].to_numpy()[order]
        mask = np.uint64((1 << low) - 1)
        # visitors come from several nodes, so only the low bits are compared; the high ones cost what was used
        mine = np.flatnonzero(owner)
        i, j = walk(v[mine] & mask, None, low, budget)
        ii, jj = [mine[i]], [mine[j]]
        for u in range(budget + 1):
            others = np.flatnonzero(~owner & (used == u))
            if len(others):
                bits = v[others] & mask
                by = np.argsort(bits, kind="stable")
                uniq, first, n_of = np.unique(bits[by], return_index=True, return_counts=True)
                i, k = walk(v[mine] & mask, uniq, low, budget - u)
                reps = n_of[k]
                ii.append(np.repeat(mine[i], reps))
                step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                jj.append(others[by[np.repeat(first[k], reps) + step]])
        root = local_stars(len(v), np.concatenate(ii), np.concatenate(jj))
        moved = root != np.arange(len(v))
        return pd.DataFrame({"a": rep[moved], "b": rep[root[moved]]})

    return seen.groupBy("at", "block").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, budget: int = 2) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links of at most ``budget`` bits reach.

    Null, empty and wordless texts have fingerprint zero and link like any other. Equal fingerprints are
    one class, whatever their number. Rows with a null id are kept with component_id null; a repeated id
    keeps its rows. Extra columns are ignored. An empty table gives an empty result.
    """
    fps = table(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    classes = table(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    stars = table(links(classes, budget), "stars")
    comp = components(stars)
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = table(named.select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    drop(classes, stars, comp)
    out = look_up(fps, "fp", named, "id")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every document; 3-word shingles, at most 2 differing bits."""
    found = near_duplicates(read(spark, sf_dir, "documents"), shingle=3, seed=42, budget=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WIDE = 4  # words of 64 bits in a wide signature
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit stream of hashes (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((int(_MIX[0]) * (k + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of lower-cased word shingles; a shorter text is one shingle, a wordless one none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    k = min(shingle, len(words))
    ends = (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(start.tolist(), ends, strict=False)), np.uint64, len(ends)))


def signature(text: str | None, shingle: int = 5) -> np.ndarray:
    """SimHash of ``WIDE`` * 64 bits over distinct lower-cased word shingles; zero for a text without words."""
    return _signed(shingles(text, shingle))


def _signed(h: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDE, np.uint64)
    if not len(h):
        return out
    for w in range(WIDE):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            bits = np.unpackbits(_mixed(h[at : at + 65536], w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64 if len(bits) > 60000 else np.uint16)
        out[w] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _digest(h: np.ndarray) -> bytes:
    """128 bits that stand for a whole shingle set."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def differing(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets with that Jaccard similarity (or cosine 2J / (1 + J))."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def within(budget: int, off: float, total: int = 64 * WIDE) -> float:
    """Probability that of ``total`` bits, each different with probability ``off``, at most ``budget`` differ."""
    return sum(comb(total, k) * off**k * (1 - off) ** (total - k) for k in range(budget + 1))


def plan(similarity: float, recall: float, depth: int) -> tuple[int, int]:
    """Budget of differing bits (mean + 3 standard deviations at ``similarity``) and number of tries, such that a pair
    of that similarity is within the budget and meets in a trie with probability ``recall``."""
    off, total = differing(similarity), 64 * WIDE
    budget = int(total * off + 3 * np.sqrt(total * off * (1 - off)))
    meets = min(recall / within(budget, off), 1 - 1e-6)
    return budget, max(1, ceil(np.log(1 - meets) / np.log(1 - (1 - off) ** depth)))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.985) -> DataFrame:
    """(id, component_id): texts whose shingle sets have a Jaccard similarity of at least ``similarity`` are linked.

    Wide signatures find candidates, the shingle sets decide. Near-copies of similarity 0.8 differ in a tenth of the
    bits and more, beyond any budget that a single trie could prune on. So the signature has 256 bits and there are several
    tries, each over its own sample of the bits: texts that agree in a sample are compared word by word until the budget
    (three standard deviations above the expected number, see :func:`plan`) is exceeded. The number of tries is what finds
    a pair at the threshold with probability ``recall``, budget included; closer pairs are found more surely, equal sets
    always. Hot nodes are split into blocks as in :func:`links`. The candidates' groups are then linked anew by the exact
    similarity alone (:func:`exact`). Null, empty and wordless texts have the empty set and link with each other. Rows
    with a null id get no component. An empty table gives an empty result.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sets = [shingles(t, shingle) for t in p["_text"]]
            s = np.stack([_signed(h) for h in sets]) if len(p) else np.zeros((0, WIDE), np.uint64)
            yield pd.DataFrame({"id": p["_id"], "digest": [_digest(h) for h in sets]} | {f"s{k}": s[:, k].view(np.int64) if len(s) else [] for k in range(WIDE)})

    words = [f"s{k}" for k in range(WIDE)]
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null")
    sigs = table(src.mapInPandas(run, "id long, digest binary, " + ", ".join(f"{w} long" for w in words)), "signatures")
    classes = table(sigs.groupBy("digest", *words).agg(F.min("id").alias("rep")), "classes")
    n, total = classes.count(), 64 * WIDE
    depth = max(1, min(DEEPEST, ceil(log2(max(n, 2) / NODE)))) if n > NODE else 1
    budget, tries = plan(similarity, recall, depth)
    rng = np.random.default_rng(11)
    orders = [rng.choice(total, depth, replace=False) for _ in range(tries)]

    def top(order: np.ndarray):
        bit = lambda p: F.shiftrightunsigned(f"s{p // 64}", int(p % 64)).bitwiseAND(F.lit(1))
        out = bit(int(order[0]))
        for p in order[1:]:
            out = out * 2 + bit(int(p))
        return out

    nodes = F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), top(o).cast("long").alias("node")) for t, o in enumerate(orders)]))
    placed = classes.select(*words, "rep", nodes.alias("at")).select("at.trie", "at.node", *words, "rep")
    hot = _hot(placed, "trie", "node")
    seen = placed.join(hot, ["trie", "node"], "left").withColumn("of", F.pmod(F.xxhash64(*words), F.coalesce("blocks", F.lit(1))).cast("int"))
    seen = seen.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of"))))
    seen = seen.select("trie", "node", "block", *words, "rep", (F.col("of") == F.col("block")).alias("owner"))

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        s = np.stack([p[w].to_numpy(np.int64, copy=True).view(np.uint64) for w in words], axis=1)
        owner = p["owner"].to_numpy(bool)
        order = np.argsort(~owner, kind="stable")
        s, rep, own = s[order], p["rep"].to_numpy()[order], int(owner.sum())
        ii, jj = [], []
        step = max(1, AT_ONCE // max(own, 1))
        for at in range(0, len(s), step):
            j, i = np.divmod(np.arange(min(step, len(s) - at) * own), max(own, 1))
            j += at
            i, j = i[i < j], j[i < j]
            dist = np.zeros(len(i), np.int64)
            for w in range(WIDE):
                dist += np.bitwise_count(s[i, w] ^ s[j, w])
                near = dist <= budget
                i, j, dist = i[near], j[near], dist[near]
            ii.append(i)
            jj.append(j)
        none = np.empty(0, np.int64)
        by = np.argsort(rep, kind="stable")
        place = np.empty(len(s), np.int64)
        place[by] = np.arange(len(s))
        root = rep[by][local_stars(len(s), place[np.concatenate([none, *ii])], place[np.concatenate([none, *jj])])][place]
        moved = root != rep
        return pd.DataFrame({"a": rep[moved], "b": root[moved]})

    stars = table(seen.groupBy("trie", "node", "block").applyInPandas(meet, "a long, b long"), "stars")
    maybe = components(stars)
    grouped = table(classes.select("digest", "rep").join(maybe.withColumnRenamed("node", "rep"), "rep"), "candidates")
    edges = exact(src, grouped, shingle, similarity)
    comp = components(edges)
    named = classes.select("digest", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    named = table(named.select("digest", F.coalesce("component", "rep").alias("component_id")), "named")
    drop(classes, stars, maybe, grouped, edges, comp)
    return look_up(sigs, "digest", named, "id").select("id", "component_id")


def exact(src: DataFrame, grouped: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) with the components of all pairs of a candidate group whose exact similarity is high enough.

    ``src``: (_id, _text). ``grouped``: (digest, rep, component), the classes that have a candidate. Each class is
    compared with its group's first class; those not similar to it are compared with every other class of the group, in
    blocks of about ``EXACT`` of them against blocks of about ``BLOCK`` others, so that a large group of near-copies costs one
    comparison for each and no task gets an unbounded group.
    """

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sets = [shingles(t, shingle) for t in p["_text"]]
            same = np.array([_digest(h) == d for h, d in zip(sets, p["digest"], strict=True)], bool)  # an id may have several texts
            yield pd.DataFrame({c: p[c] for c in ("component", "rep", "digest")} | {"hashes": [h.view(np.int64) for h in sets]})[same]

    texts = src.join(grouped, F.col("_id") == F.col("rep")).select("component", "rep", "digest", "_text")
    loaded = table(texts.mapInPandas(load, "component long, rep long, digest binary, hashes array<long>").dropDuplicates(["component", "rep", "digest"]), "shingles")
    first = loaded.where("rep = component").groupBy("component").agg(F.min(F.struct("digest", "hashes")).alias("f"))
    both = look_up(loaded, "component", first, "digest", "inner").where("digest != f.digest")
    shared = F.size(F.array_intersect("hashes", "f.hashes"))
    alike = (shared > 0) & (shared >= F.lit(similarity) * (F.size("hashes") + F.size("f.hashes") - shared))
    judged = table(both.select("component", "rep", "digest", alike.alias("alike")), "judged")
    direct = judged.where("alike").select(F.col("rep").alias("a"), F.col("component").alias("b"))

    sizes = judged.groupBy("component").agg(F.count("*").alias("n"), F.sum((~F.col("alike")).cast("int")).alias("open"))
    sizes = sizes.where("n > 1 AND open > 0").select("component", F.ceil(F.col("open") / EXACT).cast("int").alias("blocks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    left = look_up(judged, "component", sizes, "digest", "inner").join(loaded.select("component", "rep", "digest", "hashes"), ["component", "rep", "digest"])
    deal = lambda c: F.pmod(F.xxhash64("digest"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    owners = left.where("NOT alike").select("component", deal("blocks").alias("block"), every("parts").alias("part"), "rep", "hashes", F.lit(True).alias("owner"))
    others = left.select("component", every("blocks").alias("block"), deal("parts").alias("part"), "rep", "hashes", F.lit(False).alias("owner"))
    left = owners.union(others)

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(h, np.int64) for h in p["hashes"]]
        rep, size = p["rep"].to_numpy(), np.array([len(h) for h in sets])
        ids, owner = np.concatenate(sets), np.flatnonzero(p["owner"].to_numpy(bool))
        known, ids = np.unique(ids, return_inverse=True)
        start = np.concatenate(([0], np.cumsum(size)))
        total, mark = np.empty(len(ids) + 1, np.int64), np.zeros(len(known), bool)
        i, j = [], []
        for o in owner:
            mine = ids[start[o] : start[o + 1]]
            mark[mine] = True
            total[0] = 0
            np.cumsum(mark[ids], out=total[1:])
            mark[mine] = False
            common = total[start[1:]] - total[start[:-1]]
            near = np.flatnonzero((common > 0) & (common >= similarity * (size + size[o] - common)))
            near = near[rep[near] != rep[o]]
            i.append(np.full(len(near), o))
            j.append(near)
        by = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[by] = np.arange(len(rep))
        root = rep[by][local_stars(len(rep), place[np.concatenate(i)], place[np.concatenate(j)])][place] if i else rep
        moved = root != rep
        return pd.DataFrame({"a": rep[moved], "b": root[moved]})

    out = table(direct.union(left.groupBy("component", "block", "part").applyInPandas(compare, "a long, b long")), "similar")
    drop(loaded, judged)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that :func:`similar` groups with a smaller id; all columns stay. Rows with a null id stay."""
    name = fresh(docs, "gone")[0]
    gone = similar(docs, id_col, text_col, **options).where("id != component_id").select(F.col("id").alias(name))
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
