"""The nearest vectors of many queries, exactly, in blocks of products.

Products of a block of documents with some queries are one matrix product; they only choose which pairs are looked at. A pair is
looked at if its product reaches the k-th best of its query so far, less a margin above the error of both the product and the
rounding. Its score is then computed as :mod:`millrace.functions.vector` does, component by component in double
precision, and rounded half up to nine decimals; scores so rounded, then ids, decide. Equal queries are searched once, and of equal
documents of a group only the k with the smallest ids are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents of a block, products that a step holds, rows of an output batch.
BLOCK, AT_ONCE, OUT = 16_384, 1 << 21, 100_000
PLACES = 9
#: Components outside of this range (and zero) could over- or underflow in a product; such vectors are compared pair by pair.
TINY, HUGE = 1e-100, 1e100
NAN, NUMBER, NULL = 2, 1, 0


def rounded(x: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Half up on the decimal digits of a double, as Spark rounds; infinities and NaN stay."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * 10.0**places
        out = np.sign(x) * np.floor(y + 0.5) / 10.0**places
        near = np.abs(y - np.floor(y) - 0.5) <= 1e-6 + y * 1e-15
    unit = Decimal(1).scaleb(-places)
    for k in np.flatnonzero((near | (y > 1e12)) & np.isfinite(x)):
        d = Decimal(repr(float(x[k])))
        out[k] = float(d.quantize(unit, ROUND_HALF_UP)) if abs(d) < 10**15 else float(d)
    out[~np.isfinite(x)] = x[~np.isfinite(x)]
    return out + 0.0


def folded(parts: Iterator[np.ndarray], size: int) -> np.ndarray:
    total = np.zeros(size)
    for p in parts:
        total = total + p
    return total


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(folded((c * c for c in x.T), len(x)))


def pair_scores(q: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray, score: str) -> np.ndarray:
    """Scores of the pairs (q[i], d[j]), higher is nearer, not rounded."""
    qt, dt = np.ascontiguousarray(q.T), np.ascontiguousarray(d.T)
    with np.errstate(all="ignore"):
        if score == "l2":
            return -np.sqrt(folded(((e := qt[t][i] - dt[t][j]) * e for t in range(len(qt))), len(i)))
        n = norms(q)[i] * norms(d)[j]
        return np.where(n == 0, 0.0, folded((qt[t][i] * dt[t][j] for t in range(len(qt))), len(i)) / n)


def by_size(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rows and matrix of the vectors of each size, and the rows that are null or hold a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat, at = column.flatten(), np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    void = np.concatenate([[0], np.cumsum(np.asarray(pc.is_null(flat)))]) if flat.null_count else np.zeros(len(flat) + 1, np.int64)
    whole = (sizes >= 0) & (void[at[1:]] == void[at[:-1]])
    values = np.asarray(pc.fill_null(flat, 0.0).cast(pa.float64()))
    out = []
    for n in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == n))
        out.append((rows, values[at[rows][:, None] + np.arange(n)] + 0.0))
    return out, np.flatnonzero(~whole)


def classes(x: np.ndarray, *also: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows of equal bytes (and equal values of the columns ``also``)."""
    cols = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), *[np.ascontiguousarray(a.astype(np.int64)).view(np.uint8).reshape(len(x), -1) for a in also]]
    b = np.ascontiguousarray(np.concatenate(cols, axis=1))
    return np.unique(b.view(f"V{b.shape[1]}").ravel(), return_inverse=True)[1].ravel() if b.shape[1] else np.zeros(len(x), np.int64)


def first_k(keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest ids of each key."""
    order = np.lexsort((ids, keys))
    s = keys[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    place = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.sort(order[place < k])


class Queries:
    """Queries as the distinct ones of each size, and which rows each of them stands for."""

    def __init__(self, ids: pa.Array, vectors: pa.Array) -> None:
        self.ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        parts, void = by_size(vectors)
        self.parts, names, n = [], np.full(len(self.ids), -1), 0
        for rows, x in parts:
            c = classes(x)
            found, first = np.unique(c, return_index=True)
            names[rows] = n + c
            self.parts.append((n, x[first]))
            n += len(found)
        self.void = n if len(void) else None  # one class: whatever it is compared with, the score is null
        names[void] = n
        self.n = n + (self.void is not None)
        self.rows = np.argsort(names, kind="stable")
        self.starts = np.searchsorted(names[self.rows], np.arange(self.n + 1))

    def members(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For classes ``c``: rows of ``ids``, and the position in ``c`` that each comes from."""
        size = self.starts[c + 1] - self.starts[c]
        at = np.repeat(np.arange(len(c)), size)
        within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return self.rows[self.starts[c][at] + within], at


class Best:
    """The k best documents of each query class and group that one task has met."""

    def __init__(self, queries: Queries, k: int, score: str) -> None:
        self.q, self.k, self.score = queries, k, score
        self.docs: pa.Table | None = None  # ids and groups' values of the documents that are still named
        self.c, self.g, self.d, self.kind = (np.empty(0, np.int64) for _ in range(4))
        self.s = np.empty(0)
        self.groups: dict[str, int] = {}
        self.bound = np.full((queries.n, 0), -np.inf)

    def take(self, batch: pa.Table, vectors: pa.Array) -> None:
        """Meet a block of documents: their ids first, then the columns that group them, and their vectors."""
        old = 0 if self.docs is None else self.docs.num_rows
        docs = batch if self.docs is None else pa.concat_tables([self.docs, batch])
        ids = np.asarray(pc.rank(docs.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")).astype(np.int64)
        if batch.num_columns > 1:
            names = [repr(v) for v in zip(*[batch.column(n).to_pylist() for n in range(1, batch.num_columns)], strict=True)]
            g = np.array([self.groups.setdefault(v, len(self.groups)) for v in names], np.int64)
        else:
            g = np.zeros(batch.num_rows, np.int64)
            self.groups.setdefault("", 0)
        if len(self.groups) > self.bound.shape[1]:
            self.bound = np.concatenate([self.bound, np.full((self.q.n, len(self.groups) - self.bound.shape[1]), -np.inf)], axis=1)
        self.new: list[tuple[np.ndarray, ...]] = []
        parts, void = by_size(vectors)
        own = ids[old:]
        void = void[first_k(g[void], own[void], self.k)]
        self.constant(np.arange(self.q.n), void, old, g, NULL)
        for rows, x in parts:
            if self.q.void is not None:
                some = rows[first_k(g[rows], own[rows], self.k)]
                self.constant(np.array([self.q.void]), some, old, g, NULL)
            for at, q in self.q.parts:
                if q.shape[1] != x.shape[1]:
                    self.of_other_size(at, q, rows, norms(x), old, g, own)
                    continue
                some = first_k(classes(x, g[rows]), own[rows], self.k)
                some = some[np.argsort(g[rows[some]], kind="stable")]
                self.compare(at, q, rows[some], x[some], old, g)
        self.merge(ids)
        used, self.d = np.unique(self.d, return_inverse=True)
        self.docs = docs.take(pa.array(used))

    def constant(self, c: np.ndarray, rows: np.ndarray, old: int, g: np.ndarray, kind: int) -> None:
        if len(c) and len(rows):
            n = len(c) * len(rows)
            self.new.append((np.repeat(c, len(rows)), np.tile(g[rows], len(c)), np.tile(old + rows, len(c)), np.full(n, kind), np.zeros(n)))

    def of_other_size(self, at: int, q: np.ndarray, rows: np.ndarray, norm: np.ndarray, old: int, g: np.ndarray, own: np.ndarray) -> None:
        """Vectors of two sizes have no score, except that a cosine is 0 where the product of the norms is."""
        # norms that aren't 0 are above 1e-162, so those from 1e-150 on make no product 0
        sort = np.where(norm == 0, 0, np.where(~np.isfinite(norm), 1, np.where(norm >= 1e-150, 2, 3 + np.arange(len(norm)))))
        some = first_k(g[rows] * (len(rows) + 3) + sort, own[rows], self.k)
        with np.errstate(invalid="ignore"):
            none = norms(q)[:, None] * norm[some] == 0 if self.score == "cosine" else np.zeros((len(q), len(some)), bool)
        for kind, (i, j) in ((NUMBER, np.nonzero(none)), (NULL, np.nonzero(~none))):
            d = rows[some[j]]
            self.new.append((at + i, g[d], old + d, np.full(len(d), kind), np.zeros(len(d))))

    def compare(self, at: int, q: np.ndarray, rows: np.ndarray, x: np.ndarray, old: int, g: np.ndarray) -> None:
        """Look at the pairs of queries and documents (in the order of their groups) of one size that may be among the best."""
        size = lambda v: np.abs(v).max(axis=1, initial=0)

        def tame(v: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore"):
                return ((size(v) >= TINY) & (size(v) <= HUGE)) | (size(v) == 0)

        tq, tx = tame(q), tame(x)
        for cs, ds in ((~tq, np.ones(len(x), bool)), (tq, ~tx)):
            self.all_pairs(at, np.flatnonzero(cs), q, np.flatnonzero(ds), rows, x, old, g)
        qs, ds = np.flatnonzero(tq), np.flatnonzero(tx)
        if not len(qs) or not len(ds):
            return
        a, b = q[qs], x[ds]
        b_max = 0.0
        if self.score == "cosine":
            na, nb = norms(a), norms(b)
            a, b = a / np.where(na == 0, 1, na)[:, None], b / np.where(nb == 0, 1, nb)[:, None]
        else:
            half = (b * b).sum(axis=1) / 2
            b_max = 2 * half.max()
        own = g[rows[ds]]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        step = max(1, AT_ONCE // len(b))
        for lo in range(0, len(qs), step):
            part = qs[lo : lo + step]
            p = a[lo : lo + step] @ b.T
            aa = None
            if self.score == "l2":
                p -= half
                aa = (a[lo : lo + step] ** 2).sum(axis=1)
            for e, f in zip(edges[:-1], edges[1:], strict=True):
                one, bound = p[:, e:f], self.bound[at + part, own[e]]
                least = self.least(bound, aa, b_max)
                near = one >= least[:, None]
                if f - e > self.k and (np.count_nonzero(near) > 4 * self.k * len(part)):
                    top = np.partition(one, f - e - self.k, axis=1)[:, f - e - self.k]
                    top = top if aa is None else -np.sqrt(np.maximum(aa - 2 * top, 0))
                    near &= one >= self.least(top, aa, b_max)[:, None]
                i, j = np.nonzero(near)
                self.score_pairs(at, part[i], q, ds[e + j], rows, x, old, g)

    def least(self, score: np.ndarray, aa: np.ndarray | None, b_max: float) -> np.ndarray:
        """The least product with which a pair can still have this score."""
        if aa is None:
            return score - 3 * 10.0**-PLACES
        with np.errstate(invalid="ignore"):
            reach = -score + 3 * 10.0**-PLACES
            return (aa - reach * reach - 1e-11 * (aa + b_max)) / 2

    def all_pairs(self, at: int, qs: np.ndarray, q: np.ndarray, ds: np.ndarray, rows: np.ndarray, x: np.ndarray, old: int, g: np.ndarray) -> None:
        for lo in range(0, len(qs), step := max(1, (AT_ONCE >> 2) // max(1, len(ds)))):
            part = qs[lo : lo + step]
            self.score_pairs(at, np.repeat(part, len(ds)), q, np.tile(ds, len(part)), rows, x, old, g)

    def score_pairs(self, at: int, i: np.ndarray, q: np.ndarray, j: np.ndarray, rows: np.ndarray, x: np.ndarray, old: int, g: np.ndarray) -> None:
        if not len(i):
            return
        used_i, ii = np.unique(i, return_inverse=True)
        used_j, jj = np.unique(j, return_inverse=True)
        s = rounded(pair_scores(q[used_i], x[used_j], ii, jj, self.score))
        odd = np.isnan(s)
        self.new.append((at + i, g[rows[j]], old + rows[j], np.where(odd, NAN, NUMBER), np.where(odd, 0.0, s)))
        if sum(len(n[0]) for n in self.new[-50:]) > AT_ONCE:
            self.cut()

    def cut(self) -> None:
        """Of the pairs met in this block so far, keep those that may stay: scores decide, all ties of the last place stay."""
        c, g, d, kind, s = (np.concatenate(v) for v in zip(*self.new, strict=True))
        order = np.lexsort((-s, -kind, g, c))
        c, g, d, kind, s = c[order], g[order], d[order], kind[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (g[1:] != g[:-1])]))
        last = np.minimum(start + self.k - 1, np.append(start[1:], len(c)) - 1)
        last = np.repeat(last, np.diff(np.append(start, len(c))))
        keep = (kind > kind[last]) | ((kind == kind[last]) & (s >= s[last]))
        self.new = [(c[keep], g[keep], d[keep], kind[keep], s[keep])]

    def merge(self, ids: np.ndarray) -> None:
        if not self.new:
            return
        width = len(self.groups)
        new = [np.concatenate(v) for v in zip(*self.new, strict=True)]
        touched = np.zeros(self.q.n * width, bool)
        touched[new[0] * width + new[1]] = True
        again = touched[self.c * width + self.g]
        state = (self.c, self.g, self.d, self.kind, self.s)
        c, g, d, kind, s = (np.concatenate([o[again], n]) for o, n in zip(state, new, strict=True))
        order = np.lexsort((ids[d], -s, -kind, c * width + g))
        key = (c * width + g)[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        order, place = order[place < self.k], place[place < self.k]
        full = order[place == self.k - 1]
        self.bound[c[full], g[full]] = np.where(kind[full] == NUMBER, s[full], np.where(kind[full] == NAN, np.inf, -np.inf))
        self.c, self.g, self.d, self.kind, self.s = (np.concatenate([o[~again], n[order]]) for o, n in zip(state, (c, g, d, kind, s), strict=True))

    def result(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """(query id, groups' values, document id, score) of every query row."""
        for lo in range(0, len(self.c), OUT):
            member, at = self.q.members(self.c[lo : lo + OUT])
            for a in range(0, len(member), OUT):
                rows, k = member[a : a + OUT], lo + at[a : a + OUT]
                d = self.docs.take(pa.array(self.d[k]))
                score = np.where(self.kind[k] == NAN, np.nan, self.s[k])
                score = pa.array(score, mask=self.kind[k] == NULL, from_pandas=False)
                cols = [self.q.ids.take(pa.array(rows)), *[d.column(n) for n in range(1, d.num_columns)], d.column(0), score]
                yield from pa.Table.from_arrays(cols, schema=schema).combine_chunks().to_batches()


def search(parts: Iterator[pa.RecordBatch], queries: Queries, k: int, score: str) -> Iterator[pa.RecordBatch]:
    """The best documents of one task's rows (document id, groups' columns, vector) for each query and group."""
    best, held, n = Best(queries, k, score), [], 0

    def meet() -> None:
        t = pa.Table.from_batches(held)
        for at in range(0, t.num_rows, BLOCK):
            one = t.slice(at, BLOCK).combine_chunks()
            best.take(one.select(range(one.num_columns - 1)), one.column(one.num_columns - 1))

    for b in parts:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= BLOCK:
            meet()
            held, n = [], 0
    if n:
        meet()
    if best.docs is not None:
        f = best.docs.schema
        schema = pa.schema([pa.field("q", queries.ids.type), *[f.field(i) for i in range(1, len(f))], f.field(0), pa.field("score", pa.float64())])
        yield from best.result(schema)
