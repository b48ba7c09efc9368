"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to one representative letter (i, l and 1 are
one class), drops zero-width characters and turns everything that is no letter into single spaces. The
lexicon holds whole words and word prefixes. A term's weight is the lower confidence bound of its log odds
between lines of toxic and of other documents; lines are counted once, so copies don't vote. Phrases of
two words whose lexicon word occurs mostly in clean text are exceptions and cancel their hits. A
document's summed weight, normalised by its length, goes through a logistic curve fitted on the same
labelled rows. The fit uses a bounded sample of the labelled rows (``max_labelled``); scores cover every
row and whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, read, release, table

#: Look-alike characters and the letters they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l", "0": "o", "1": "i", "3": "e",
    "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
_FULL = {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): str(k) for k in range(10)}
_MAP = {k: HOMOGLYPHS.get(v, v) for k, v in (_FULL | HOMOGLYPHS).items()}
PREFIXES = (4, 5, 6, 7, 8)
#: Terms that are broadcast to be counted in clean lines; more are joined by a shuffle.
BROADCAST = 500_000


def folded(text: str | Column) -> Column:
    """Folded letters of a text, words apart by single spaces, with a space at either end; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.lower(c), "".join(_MAP) + ZERO_WIDTH, "".join(_MAP.values()))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


@dataclass
class Lexicon:
    """Terms (a word, or a prefix that ends in ``*``) with weights, exception phrases, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    intercept: float = -3.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            p = f" {t[:-1]}" if t.endswith("*") else f" {t} "
            old = a.get(p, None)
            a.add_word(p, (len(p), max(w, old[1]) if old else w, 0))
        for e in self.exceptions:
            a.add_word(f" {e} ", (len(e) + 2, 0.0, e.index(" ") + 1))
        if len(a):
            a.make_automaton()
        return a


def needed(weights: dict[str, float]) -> dict[str, float]:
    """The terms that can set a place's weight: without those under a prefix that weighs as much, since the largest counts."""

    def under(t: str, w: float) -> bool:
        letters = t.removesuffix("*")
        return any(weights.get(f"{letters[:k]}*", w - 1) >= w for k in range(1, len(letters) + (letters == t)))

    return {t: w for t, w in weights.items() if not under(t, w)}


def hits(automaton, text: str) -> dict[int, float]:
    """Weights of the words of a folded text that match, by the place of the space before the word."""
    found: dict[int, float] = {}
    spared: set[int] = set()
    if len(automaton):
        for end, (size, weight, second) in automaton.iter(text):
            at = end - size + 1
            if second:
                spared.update((at, at + second))
            elif weight > found.get(at, 0.0):
                found[at] = weight
    return {k: v for k, v in found.items() if k not in spared}


def level(total: float, words: int) -> float:
    """Summed weight, normalised by length."""
    return math.log1p(10 * total / math.sqrt(words + 25))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that are kept out of the fit: crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 60_000, min_support: int = 4, min_weight: float = 2.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Fit a lexicon on the labelled rows that are not held out.

    At most about ``max_labelled`` of them are used, chosen by a hash of the id, so the join with texts is a broadcast
    of bounded size. Terms that stand in fewer than ``min_support`` toxic lines or weigh less than ``min_weight`` are left out:
    rare words that copies or chance put into toxic texts. All others are kept; they are weighed by the cluster, and
    since the labelled rows are bounded, so is the lexicon. Of several labels of an id the largest counts; null labels
    and ids are left out. Without toxic rows the lexicon is empty and the curve gives a low constant.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    y = y.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    n = y.count()
    if n > max_labelled:
        y = y.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), folded)
    got = docs.select(F.col(id_col).alias("_id"), text_col).join(F.broadcast(y), "_id")
    train = table(got.select("_y", lines.alias("lines")), "toxic-train")

    words = F.array_distinct(F.filter(F.split(F.trim("line"), " "), lambda w: w != ""))

    def prefix(w: Column, k: int) -> Column:
        return F.concat(F.substring(w, 1, k), F.lit("*"))

    def longer(k: int) -> Column:
        return F.filter("words", lambda w: F.length(w) > k)

    def prefixes(k: int) -> Column:
        return F.transform(longer(k), lambda w: prefix(w, k))

    def pairs(k: int) -> Column:
        return F.transform(longer(k), lambda w: F.struct(prefix(w, k).alias("term"), w.alias("word")))

    # a line counts once for each of its different words
    terms = F.explode(F.concat(F.col("words"), *[prefixes(k) for k in PREFIXES])).alias("term")
    whole = F.transform("words", lambda w: F.struct(w.alias("term"), w.alias("word")))
    named = F.explode(F.concat(whole, *[pairs(k) for k in PREFIXES])).alias("p")
    toxic = train.where("_y = 1").select(F.explode("lines").alias("line")).distinct()
    clean = train.where("_y = 0").select(F.explode("lines").alias("line")).distinct()
    n_toxic, n_clean = toxic.count(), clean.count()
    # a prefix stands for different words; that of a single word would only blur it
    support = toxic.select(words.alias("words")).select(named).select("p.*").groupBy("term")
    support = support.agg(F.count("*").alias("t"), (F.min("word") != F.max("word")).alias("varied")).where(F.col("t") >= min_support)
    support = support.where(~F.endswith("term", F.lit("*")) | F.col("varied")).select("term", "t")
    support = table(support, "toxic-terms")
    named_terms = F.broadcast(support) if support.count() <= BROADCAST else support
    against = clean.select(words.alias("words")).select(terms).join(named_terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    t, c = F.col("t") + 0.5, F.coalesce("n", F.lit(0)) + 0.5
    w = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1)) - 2 * F.sqrt(1 / t + 1 / c)
    weighed = support.join(against, "term", "left").select("term", w.alias("w")).where(F.col("w") >= min_weight).toPandas()
    lex = Lexicon(needed(dict(zip(weighed["term"], weighed["w"].astype(float), strict=True))))

    def around(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("toxicity")
        auto = lex.automaton()
        for p in parts:
            rows = []
            for y_, text in zip(p["_y"], p["line"], strict=True):
                for at in hits(auto, text):
                    end = text.index(" ", at + 1)
                    before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
                    rows += [(text[before + 1 : end], y_)] * (before >= 0) + [(text[at + 1 : after], y_)] * (after > 0)
            yield pd.DataFrame(rows, columns=["phrase", "y"])

    one = train.select("_y", F.explode("lines").alias("line"))
    phrases = one.mapInPandas(around, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n"))
    spared = phrases.where(F.col("n") >= 3).where("n > 4 * t + 2").orderBy("phrase").toPandas()
    lex.exceptions = spared["phrase"].tolist()

    levels = train.select("_y", level_of(F.concat_ws("", "lines"), lex).alias("x"))
    bins = levels.groupBy("_y", F.round("x", 2).alias("x")).count().toPandas()
    drop(train, support)
    if bins["_y"].nunique() == 2:
        lex.slope, lex.intercept = logistic(bins["x"].to_numpy(), bins["_y"].to_numpy(), bins["count"].to_numpy())
    return lex


def level_of(text: Column, lex: Lexicon) -> Column:
    """The normalised lexicon weight of a folded text; only that text goes through Python."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release("toxicity")
        auto = lex.automaton()
        for p in parts:
            yield pd.Series([level(sum(hits(auto, t).values()), t.count(" ")) if isinstance(t, str) else 0.0 for t in p], dtype=float)

    return run(text)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve over binned levels, with a small ridge so that separable data converge."""
    a = np.column_stack([x, np.ones_like(x)])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (n * (y - p)) - np.array([1.0, 0.01]) * b
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag([1.0, 0.01])
        step = np.linalg.solve(hess, grad)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, lex: Lexicon, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row; a column of that name is replaced, all others stay, whatever their names.

    Null and empty texts have the curve's value at no hits. Whole texts are scored.
    """
    x = level_of(folded(text_col), lex)
    return docs.withColumn(out, 1 / (1 + F.exp(-(x * F.lit(lex.slope) + F.lit(lex.intercept)))))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, score, predicted for every row of docs. Extra columns are ignored; repeated and null ids keep their rows."""
    lex = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    got = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lex)
    return got.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
