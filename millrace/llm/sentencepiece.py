"""SentencePiece encoding and decoding over a relational lattice.

No piece reaches across the start of a word, so a text is a sequence of units (spaces, then what follows up to
the next space) and only distinct units are segmented. A unit's substrings of at most the longest piece's
length are exploded and equi-joined to the piece table (a vocabulary, so its broadcast is of bounded size); the matches
are the edges of its lattice, grouped by unit. For unigram models they are folded by ``aggregate`` in order of their end
(Viterbi: the best score so far for each position, then the way back). The ids of a BPE model are not those of the
best path but of its merges, so for BPE models the grouped edges are merged by rank instead, in an Arrow function. Characters
without a piece fall back to bytes.

Units travel between documents and lattice by block, a stretch of rows of a file: a first pass gives each block's distinct
units, packed into one row for each of ``SLOTS`` hash slots; a slot's distinct units are segmented once and the ids go back to the
blocks' dictionaries, one file each in the shared folder, packed in the same way; a second pass looks its documents' units up.
Texts are never shuffled, no unit travels as a row of its own, and no task holds more than the units of one block or slot.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import islice
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, read, setting, shared_dir, table

if TYPE_CHECKING:
    import pyarrow as pa

SPACE = "▁"
#: Rows of a block, hash slots that units are dealt out by, and bytes of ids that are put into one batch.
BLOCK_ROWS, SLOTS, AT_ONCE = 8192, 4096, 64 << 20
ENCODED = "id long, ids array<int>, text string"
#: An edge of a lattice is one long: start, length and id.
START, SIZE = 38, 28
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The pieces of a SentencePiece model file with their scores, and how texts become units."""

    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return Pieces, (self.path,)

    @cached_property
    def rows(self) -> list[tuple[str, int, float]]:
        sp = self._model
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return [(sp.id_to_piece(i), i, sp.get_score(i)) for i in normal]

    @cached_property
    def _model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def bpe(self) -> bool:
        """True for a model of ranked merges, False for a unigram model."""
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(self.path, "rb") as f:
            m.ParseFromString(f.read())
        return m.trainer_spec.model_type == 2

    @cached_property
    def ranks(self) -> np.ndarray:
        """By id: the place of its score, the best first; equal scores share a place."""
        scores = np.array([s for _, _, s in self.rows])
        out = np.zeros(max(i for _, i, _ in self.rows) + 1, np.int64)
        out[[i for _, i, _ in self.rows]] = np.unique(-scores, return_inverse=True)[1]
        return out

    def merge(self, units: list[str], edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units under ranked merges, one unit's after another's, and their number for each unit.

        All units take their next merge at once: the best-scored edge over two neighbouring symbols, of equal ones the
        leftmost. Symbols are kept as borders in the units' characters laid end to end, so an edge spans two
        neighbours where it begins and ends at a border and has a single one between.
        """
        n = np.fromiter(map(len, units), np.int64, len(units)) + 1  # one place behind each unit is its last border
        base = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, edges), np.int64, len(edges)))
        code = np.concatenate([np.empty(0, np.int64), *edges]).astype(np.int64)
        start = (code >> START) + base[owner]
        end, ids = start + (code >> SIZE & (1 << START - SIZE) - 1), code & (1 << SIZE) - 1
        named, border = np.full(n.sum(), -1, np.int64), np.ones(n.sum(), bool)
        one = end == start + 1
        named[start[one]] = ids[one]
        start, end, ids, owner = (x[~one] for x in (start, end, ids, owner))
        key, never = self.ranks[ids] << 36 | start, np.iinfo(np.int64).max
        while len(start):
            count = np.cumsum(border)
            gap = np.where(border[start] & border[end], count[end] - count[start], 0)
            by_key = np.where(gap == 2, key, never)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.repeat(np.minimum.reduceat(by_key, first), np.diff(np.append(first, len(owner))))
            now = np.flatnonzero((by_key == best) & (best != never))
            now = now[np.concatenate(([True], owner[now][1:] != owner[now][:-1]))[: len(now)]]
            at = np.flatnonzero(border)
            border[at[count[start[now]]]] = False
            named[start[now]] = ids[now]
            open_ = (gap >= 2) & (best != never)
            open_[now] = False
            start, end, ids, owner, key = (x[open_] for x in (start, end, ids, owner, key))
        border[base + n - 1] = False
        at = np.flatnonzero(border)
        of, out = np.repeat(np.arange(len(units)), n)[at], named[at]
        lack = np.flatnonzero(out < 0)
        if len(lack):  # characters without a piece
            spelled = [self._spelled(units[k][i]) for k, i in zip(of[lack].tolist(), (at - base[of])[lack].tolist(), strict=True)]
            size = np.ones(len(out), np.int64)
            size[lack] = list(map(len, spelled))
            of, out = np.repeat(of, size), np.repeat(out, size)
            out[out < 0] = np.concatenate(spelled)
        return out, np.bincount(of, minlength=len(units))

    def _spelled(self, char: str) -> list[int]:
        if self.bytes_from < 0:
            return [self.unknown]
        return [self.bytes_from + x for x in char.encode("utf-8", "replace")]

    @cached_property
    def bytes_from(self) -> int:
        """Id of the piece of byte 0; those of the other bytes follow. -1 without byte pieces."""
        sp = self._model
        ids = [i for i in range(sp.get_piece_size()) if sp.is_byte(i)]
        return ids[0] if len(ids) == 256 and ids[-1] - ids[0] == 255 else -1

    @cached_property
    def unknown(self) -> int:
        return self._model.unk_id()

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @cached_property
    def lowest(self) -> float:
        return min(s for _, _, s in self.rows)

    @cached_property
    def _joins(self) -> tuple[np.ndarray, np.ndarray]:
        """By character: its class, 0 for those that stand only alone; and which classes stand side by side in some piece."""
        pairs = {p[k : k + 2] for p, _, _ in self.rows for k in range(len(p) - 1)}
        chars = sorted(set("".join(pairs)))
        kind = np.zeros(sys.maxunicode + 1, np.uint16)
        kind[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        inside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x, y in pairs:
            inside[kind[ord(x)], kind[ord(y)]] = True
        return kind, inside

    def words(self, text: str) -> list[str]:
        """The units of a text without the escaped space in front of each; spaces of their own are escaped."""
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNITS.findall(SPACE + text.replace(" ", SPACE))]

    def split(self, words: Iterable[str]) -> str:
        """The words' units, two spaces between them, each cut by one space wherever no piece reaches across.

        Such parts are segmented by themselves: no merge and no edge of a lattice crosses the cut.
        """
        joined = ("  " + SPACE).join(words)
        chars = np.frombuffer(f"{SPACE}{joined}".encode("utf-32-le"), "<u4")
        kind, inside = self._joins
        kinds, space = kind[chars], chars == 32
        cut = ~inside[kinds[:-1], kinds[1:]] & ~space[:-1] & ~space[1:]
        return np.insert(chars, np.flatnonzero(cut) + 1, 32).tobytes().decode("utf-32-le")

    def parts(self, words: Iterable[str]) -> set[str]:
        """The distinct parts of words, some at a time to save memory."""
        words, out = iter(words), set()
        while some := list(islice(words, 50_000)):
            out.update(self.split(some).replace("  ", " ").split(" "))
        return out

    def units(self, text: str) -> list[str]:
        """The parts of a text's units in order; joined they are the escaped text with a space put in front."""
        return self.split(self.words(text)).replace("  ", " ").split(" ") if text else []

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes put back, spaces unescaped, the space in front dropped; other ids have no text."""
        flat, begin, size = self._bytes
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
            raise ValueError("an id that the model doesn't have")
        n = size[ids]
        data = flat[np.repeat(begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where each id's begin and how many they are."""
        texts = [b""] * self._model.get_piece_size()
        for p, i, _ in self.rows:
            texts[i] = p.encode()
        texts[self.unknown] = " ⁇ ".encode()
        if self.bytes_from >= 0:
            texts[self.bytes_from : self.bytes_from + 256] = [bytes([b]) for b in range(256)]
        size = np.array(list(map(len, texts)), np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _matches(units: DataFrame, pieces: Pieces, by: list[str]) -> DataFrame:
    """by, s, e, id, score: the substrings of units that are pieces, and all single characters (id null where no piece)."""
    if pieces.longest >= 1 << START - SIZE or max(i for _, i, _ in pieces.rows) >= 1 << SIZE:
        raise ValueError(f"pieces of {1 << START - SIZE} characters and ids of {1 << SIZE} and more don't fit an edge")
    vocabulary = units.sparkSession.createDataFrame(pd.DataFrame(pieces.rows, columns=["name", "id", "score"]), "name string, id int, score double")
    vocabulary = vocabulary.withColumn("hash", F.xxhash64("name"))
    subs = units.select(*by, F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s"))
    subs = subs.select(*by, "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + pieces.longest, F.length("unit")))).alias("e"))
    subs = subs.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s")))
    # a table keyed by a number answers several times faster than one keyed by text; equal text is asked for all the same
    found = (F.xxhash64("piece") == F.col("hash")) & (F.col("piece") == F.col("name"))
    # single characters stay, with or without a piece, so that every unit has edges
    return subs.join(F.broadcast(vocabulary), found, "left").where("id IS NOT NULL OR e = s + 1").select(*by, "s", "e", "id", "score")


def lattice(units: DataFrame, pieces: Pieces, by: list[str] | None = None) -> DataFrame:
    """by, edges: for distinct units the pieces they hold, each as one long of start, length and id."""
    by = by or ["unit"]
    code = F.shiftleft(F.col("s").cast("long"), START) + F.shiftleft((F.col("e") - F.col("s")).cast("long"), SIZE) + F.col("id")
    return _matches(units, pieces, by).groupBy(*by).agg(F.collect_list(code).alias("edges"))


def segment(units: DataFrame, pieces: Pieces, bpe: bool | None = None, by: list[str] | None = None) -> DataFrame:
    """by (unit by default), ids for distinct units: the best path of a unigram model, the merges of a BPE model.

    Of equal scores the path whose last piece is longer wins. A character without a piece of its own costs 10 below the lowest
    score and becomes its UTF-8 bytes (or the unknown id without byte pieces).
    """
    by = by or ["unit"]
    n = F.length("unit")
    if pieces.bpe if bpe is None else bpe:

        @F.pandas_udf("array<int>")
        def merged(unit: pd.Series, edges: pd.Series) -> pd.Series:
            ids, n = pieces.merge(unit.tolist(), edges.tolist())
            return pd.Series(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])

        return lattice(units, pieces, by).select(*by, merged("unit", "edges").alias("ids"))
    edges = _matches(units, pieces, by)
    unknown = pieces.lowest - 10
    edge = F.struct("e", "s", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    sorted_ = edges.groupBy(*by).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.lit(-1).alias("id")))

    def forward(best, x):
        new = F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id"))
        last = F.size(best) - 1
        return (
            F.when(x["e"] > last, F.concat(best, F.array(new)))
            .when(new["score"] > F.get(best, last)["score"], F.concat(F.slice(best, 1, last), F.array(new)))
            .otherwise(best)
        )

    def spelled(s):
        if pieces.bytes_from < 0:
            return F.array(F.lit(pieces.unknown))
        code = F.hex(F.encode(F.substring(F.col("unit"), s + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int") + pieces.bytes_from)

    def back(state, _):
        at = F.get(F.col("best"), state["at"])
        own = F.when(at["id"] >= 0, F.array(at["id"])).otherwise(spelled(at["s"]))
        step = F.struct(at["s"].alias("at"), F.concat(own, state["ids"]).alias("ids"))
        return F.when(state["at"] > 0, step).otherwise(state)

    best = sorted_.withColumn("best", F.aggregate("edges", start, forward))
    way = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")), back, lambda x: x["ids"])
    return best.select(*by, way.alias("ids"))


def _blocked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, block: a block is a stretch of ``BLOCK_ROWS`` rows of a Parquet file.

    It depends on the file alone and not on how scans are split, so it is the same in every pass, whatever executors are lost
    in between. Documents that don't come straight from Parquet files are written to the shared folder first.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block")
    try:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), block)
    except AnalysisException:
        return table(src, "documents").select("id", "text", block)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """(block, first row, row after the last) of the stretches of a batch that lie in one block."""
    block = batch.column("block").to_numpy()
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield int(block[lo]), lo, hi


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", then: Callable | None = None, schema: str = ENCODED) -> DataFrame:
    """(id, ids, text) with ids the piece ids of the text. Null and empty texts have no ids (text stays as it is).

    Whole texts are encoded, whatever their length. Rows with null or repeated ids keep their rows; extra columns are ignored.
    An empty table gives an empty result. The dictionaries are read when the result is; ``drop`` of it deletes them. ``then`` may turn the batches of (id, ids, text) into others of ``schema`` in the
    same worker, so that ids and texts don't travel further.
    """
    import pyarrow as pa

    pieces = Pieces(model or model_path())
    src = _blocked(docs, id_col, text_col)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slots(block: int, words: set[str]) -> pa.RecordBatch:
            by_slot: dict[int, list[str]] = {}
            for u in pieces.parts(words):
                by_slot.setdefault(zlib.crc32(u.encode()) % SLOTS, []).append(u)
            joined = [" ".join(us) for us in by_slot.values()]
            return pa.RecordBatch.from_arrays([
                pa.array(list(by_slot), pa.int32()), pa.array([block] * len(joined), pa.int64()), pa.array(joined, pa.string()),
                pa.array(list(map(len, by_slot.values())), pa.int64())
            ], ["slot", "block", "units", "n"])

        at, words = None, set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for block, lo, hi in _runs(batch):
                if block != at:
                    if words:
                        yield slots(at, words)
                    at, words = block, set()
                for text in texts[lo:hi]:
                    if text:
                        words.update(pieces.words(text))
        if words:
            yield slots(at, words)

    used = table(src.select("block", "text").mapInArrow(gather, "slot int, block long, units string, n long"), "units")
    # grouping edges sorts them, so partitions are kept small enough for memory; slots are put together to groups of some
    # thousand units, since each group costs a call
    n = used.agg(F.sum("n")).first()[0] or 0
    n_parts, group = max(1, n // 40_000), F.pmod(F.col("slot"), F.lit(max(1, min(SLOTS, n // 10_000))))
    dealt = used.select(group.alias("group"), "block", "units").repartition(n_parts, "group")
    asking = used.select(group.alias("place"), "block", "units").repartition(n_parts, "place")  # the same exchange
    units = dealt.select("group", F.explode(F.split("units", " ")).alias("unit")).distinct()
    bpe = pieces.bpe
    solved = lattice(units, pieces, ["group", "unit"]) if bpe else segment(units, pieces, False, ["group", "unit"])

    def fill(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if bpe:
            ids, n = pieces.merge(known["unit"].tolist(), known["edges"].tolist())
        else:
            ids, n = np.concatenate(known["ids"].tolist()), np.fromiter(map(len, known["ids"]), np.int64, len(known))
        flat, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
        spans = map(slice, (ends - 4 * n).tolist(), ends.tolist())
        ids_of = dict(zip(known["unit"], map(flat.__getitem__, spans), strict=True))
        packed = []
        for us in asked["units"]:
            own = list(map(ids_of.__getitem__, us.split(" ")))
            packed.append(zlib.compress(np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own), 1))
        return pd.DataFrame({"block": asked["block"], "units": asked["units"], "ids": packed})

    filled = asking.groupBy("place").cogroup(solved.groupBy("group")).applyInPandas(fill, "block long, units string, ids binary")
    folder = f"{shared_dir(docs.sparkSession)}/millrace/dictionary-{uuid.uuid4().hex}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each block, moved to its name when it is whole: attempts of a task write the same content."""
        import pyarrow.parquet as pq

        from millrace.llm.warc import filesystem

        fs, root = filesystem(folder)
        at, rows = None, []

        def close() -> pa.RecordBatch:
            sub = f"{root}/{at & 0xFFF:03x}"
            fs.create_dir(sub, recursive=True)
            part = f"{sub}/{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                pq.write_table(pa.Table.from_batches(rows), f, compression="zstd")
            fs.move(part, f"{sub}/{at & (1 << 64) - 1:016x}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], ["block"])

        for batch in batches:
            for block, lo, hi in _runs(batch):
                if block != at:
                    if rows:
                        yield close()
                    at, rows = block, []
                rows.append(batch.slice(lo, hi - lo).select(["units", "ids"]))
        if rows:
            yield close()

    # a partition's units fit into memory, so their edges are gathered in a hash map of any number of keys instead of being sorted
    with setting(docs.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "1000000"):
        drop(table(filled.repartition("block").sortWithinPartitions("block").mapInArrow(store, "block long"), "blocks"))
    drop(used)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        from millrace.llm.warc import filesystem

        fs, root = filesystem(folder)
        at, known, parts = None, {}, {}

        def load(block: int) -> tuple[dict[str, bytes], dict[str, bytes]]:
            """Ids of the block's parts as little-endian bytes: those that begin a word by the word alone, others by themselves."""
            with fs.open_input_file(f"{root}/{block & 0xFFF:03x}/{block & (1 << 64) - 1:016x}") as f:
                got = pq.read_table(f)
            words, rests = {}, {}
            for us, packed in zip(got["units"].to_pylist(), got["ids"].to_pylist(), strict=True):
                names, data = us.split(" "), zlib.decompress(packed)
                ends = np.cumsum(np.frombuffer(data, "<u4", len(names))) + 4 * len(names)
                spans = map(slice, [4 * len(names), *ends[:-1].tolist()], ends.tolist())
                for u, ids in zip(names, map(data.__getitem__, spans), strict=True):
                    if u[0] == SPACE:
                        words[u[1:]] = ids
                    rests[u] = ids
            return words, rests

        for batch in batches:
            texts, data = batch.column("text").to_pylist(), [b""] * batch.num_rows
            for block, lo, hi in _runs(batch):
                full = [k for k in range(lo, hi) if texts[k]]
                for some in (full[k : k + 64] for k in range(0, len(full), 64)):
                    if block != at:
                        at, (known, parts) = block, load(block)
                    words = [pieces.words(texts[k]) for k in some]
                    lack = list(set().union(*words).difference(known))
                    if lack:  # words of several parts, put together when they are first met
                        get = parts.__getitem__
                        known.update(zip(lack, [b"".join(map(get, w.split(" "))) for w in pieces.split(lack).split("  ")], strict=True))
                    for k, ws in zip(some, words, strict=True):
                        data[k] = b"".join(map(known.__getitem__, ws))
            # lists of bounded size are built at once
            lo = 0
            while lo < len(data):
                hi, size = lo + 1, len(data[lo])
                while hi < len(data) and size + len(data[hi]) <= AT_ONCE:
                    hi, size = hi + 1, size + len(data[hi])
                ends = np.concatenate(([0], np.cumsum([len(d) // 4 for d in data[lo:hi]]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), size // 4, [None, pa.py_buffer(b"".join(data[lo:hi]))]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, part.column("text")], ["id", "ids", "text"])
                lo = hi

    out = src.mapInArrow((lambda batches: then(look_up(batches))) if then else look_up, schema)
    out._millrace_path = folder
    return out


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of piece ids; null stays null."""
    pieces = Pieces(model or model_path())

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else pieces.decode(x))

    return rows.withColumn(out, text(ids_col))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (ids as little-endian unsigned 32-bit) and round_trip for every document."""
    pieces = Pieces(model_path())

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            ids, ends = b.column("ids").values.to_numpy(), b.column("ids").offsets.to_numpy()
            rows = [ids[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            same = [pieces.decode(r) == (t or "") for r, t in zip(rows, b.column("text").to_pylist(), strict=True)]
            crc = [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(len, rows)), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    rows = encode(read(spark, sf_dir, "documents"), then=digests, schema="doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
    out = table(rows, "encoded")
    drop(rows)
    return out
