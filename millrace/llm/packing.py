"""Best-fit packing of token sequences by a plan over the length histogram.

The planner never sees documents. It gets the number of pieces of each length (at most ``size`` rows,
whatever the corpus) and runs best-fit decreasing over those counts: bins with the same free room are one
entry, and one step places all pieces of a length that fit into them. The plan is a list of slot runs
(length, first rank, first sequence, pieces per sequence, offset). A piece then finds its slot by its
rank among the pieces of its length. Ranks are counted within (length, salt) and shifted by the counts
of the salts before, so a length that a third of all pieces share is spread over ``SALTS`` groups.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import KEPT, drop, read, release, table

if TYPE_CHECKING:
    import pyarrow as pa

SALTS = 256
PIECE = "id long, piece int, start long, length long, ids_crc32 long"
#: The normalizer and pre-tokenizer of a tokenizer file under which words between white space are encoded alone.
BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
COMBINING = re.compile("[\u0300-\u036f]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Token ids of texts as little-endian bytes, with a memo of words that lives as long as the worker.

    A tokenizer file with the normalizer and pre-tokenizer ``BY_WORD`` drops white space, never joins across it and ignores the
    case of A-Z, so a text's ids are those of its words between spaces and line feeds, one after another. Words that end in
    one full stop or comma after a letter are looked up without it. Texts that hold an added token in any spelling (it
    is matched before lower-casing) or combining marks (they compose with lower-case letters that have no composed
    capital) go to the tokenizer as a whole, and so do all texts under any other file.
    """

    KEPT = 800_000
    #: Stands between the words that are learned together; words that hold it are learned one by one.
    MARK = b"\x01"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        added = known["added_tokens"]
        self.by_word = (known["normalizer"], known["pre_tokenizer"]) == BY_WORD and not known["post_processor"] and not any(t["normalized"] for t in added)
        self.special = [t["content"].lower().encode() for t in added]
        self.stops = {x: self.whole([x.decode()])[0] for x in (b".", b",")}
        self.mark = np.frombuffer(self.whole([self.MARK.decode()])[0], "<u4")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> None:
        memo = self.memo
        bare = {w: w[:-1] if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122 else w for w in words}
        new = list({b for b in bare.values() if b not in memo})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            memo.update(zip(part, self.together(part), strict=True))
        for w, b in bare.items():
            if w != b:
                memo[w] = memo[b] + self.stops[w[-1:]]

    def together(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; the tokenizer gets them as one text, with a mark between them whose id no word has."""
        if len(self.mark) == 1 and not any(self.MARK in w for w in words):
            ids = np.array(self.tok.encode_batch_fast([(b" " + self.MARK + b" ").join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(words) - 1:
                data = ids.tobytes()
                begin, end = np.concatenate(([0], ends + 1)) * 4, np.append(ends, len(ids)) * 4
                return list(map(data.__getitem__, map(slice, begin.tolist(), end.tolist())))
        return self.whole([w.decode() for w in words])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        out = []
        for at in range(0, len(texts), 32):
            lower = [t.encode("utf-8", "replace").lower() for t in texts[at : at + 32]]
            apart = [k for k, t in enumerate(lower) if any(s in t for s in self.special) or (not texts[at + k].isascii() and COMBINING.search(texts[at + k]))]
            split = [t.replace(b"\n", b" ").split(b" ") for t in lower]
            for k in apart:
                split[k] = []
            missing = set().union(*split).difference(self.memo)
            if missing:
                if len(self.memo) > self.KEPT:
                    # common words came first, and a dict keeps its order
                    self.memo = dict(islice(self.memo.items(), self.KEPT // 2))
                    missing = set().union(*split).difference(self.memo)
                self.learn(missing)
            get = self.memo.__getitem__
            got = [b"".join(map(get, words)) for words in split]
            for k in apart:
                got[k] = self.whole([texts[at + k]])[0]
            out += got
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file; made once, and gone when another operator's task begins (:func:`release`)."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
        KEPT["packing"] = _CODERS.clear
    return _CODERS[path]


def pieces(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``size`` ids: id, piece, start, length, ids_crc32 and, on demand, token_ids.

    A document's ids are those of its text without special tokens, then ``end_id``; a null or empty text
    has ``end_id`` alone. Only longer documents are cut. The tokenizer file is read once by each worker.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        schema = schema.append(pa.field("token_ids", pa.list_(pa.int64()))) if with_ids else schema
        release("packing")
        code = coder(path)
        for b in batches:
            rows: list[tuple] = []
            keys, texts = b.column("_id").to_pylist(), [t or "" for t in b.column("_text").to_pylist()]
            for at in range(0, len(texts), 128):
                for key, ids in zip(keys[at : at + 128], code(texts[at : at + 128]), strict=True):
                    ids += end_id.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[start : start + 4 * size]
                        rows.append((key, k, start // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, PIECE + (", token_ids array<long>" if with_ids else ""))


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, pieces per sequence, offset).

    Ranks of a length start at 0 and its runs are in rank order. Bins with the same room are kept as
    ranges of sequence numbers, so the work follows the number of lengths and not of pieces.
    """
    rooms: list[int] = []  # distinct free rooms, ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, number)
    made, out = 0, []

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((first, number))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of length {length} does not fit into {size}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = size // length
                full, rest = divmod(left, per)
                if full:
                    out.append((length, rank, full * per, made, per, 0))
                    put(size - per * length, made, full)
                    rank, made = rank + full * per, made + full
                if rest:
                    out.append((length, rank, rest, made, rest, 0))
                    put(size - rest * length, made, 1)
                    made += 1
                break
            room = rooms[at]
            first, number = bins[room].pop()
            per = room // length
            full, rest = divmod(left, per)
            take = min(number, full)
            if take:
                out.append((length, rank, take * per, first, per, size - room))
                put(room - per * length, first, take)
                rank, left = rank + take * per, left - take * per
            if take < number and left:
                # fewer are left than one more bin holds
                out.append((length, rank, left, first + take, left, size - room))
                put(room - left * length, first + take, 1)
                put(room, first + take + 1, number - take - 1)
                rank, left = rank + left, 0
            elif take < number:
                put(room, first + take, number - take)
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
    return out


def assign(parts: DataFrame, size: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, length, ...). Pieces of length 0 or null are not allowed."""
    spark = parts.sparkSession
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")
    salted = parts.withColumn("salt", salt)
    counts = table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    # at most ``size`` rows, one for each length
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = pd.DataFrame(plan(histogram, size), columns=["length", "rank", "number", "sequence", "per", "at"], dtype="int64")
    runs = spark.createDataFrame(runs, "length long, rank long, number long, sequence long, per long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    # the runs that a group's ranks [base, base + n) touch
    mine = base.join(runs, "length").where("rank < base + n AND base < rank + number")
    mine = mine.groupBy("length", "salt").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("rank", "number", "sequence", "per", "at"))).alias("runs"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1)
    placed = ranked.join(mine, ["length", "salt"]).withColumn("r", F.col("r") + F.col("base"))
    placed = placed.withColumn("run", F.element_at(F.filter("runs", lambda x: (x["rank"] <= F.col("r")) & (F.col("r") < x["rank"] + x["number"])), 1))
    inside = F.col("r") - F.col("run.rank")
    return placed.select(
        *[c for c in parts.columns],
        (F.col("run.sequence") + F.floor(inside / F.col("run.per"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod(inside, F.col("run.per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as best-fit decreasing finds.

    One row per piece: id, piece, start, length, ids_crc32 [, token_ids], sequence_id, offset; the pieces
    of a sequence lie without gaps from offset 0. Null and empty texts are one piece that holds the end
    id. Rows with a null or repeated id keep their rows. Extra columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    parts = table(pieces(docs, size, tokenizer, end_id, id_col, text_col, with_ids), "pieces")
    return assign(parts, size)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens of word_bpe_49k."""
    return pack(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
