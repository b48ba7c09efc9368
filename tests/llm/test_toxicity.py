import random
import zlib

import pytest

from millrace.llm import toxicity
from tests.llm.conftest import ODD


def corpus(n=900):
    rng = random.Random(4)
    calm = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        t = rng.choices(calm, k=rng.randint(20, 200))
        if bad:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(["vexoid", "grumlor", "blasterix", "blasterone", "blasterama"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark, docs_of):
    rows, labels = corpus()
    docs, y = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, y, dict(labels), toxicity.learn(docs, y)


def test_held_out_accuracy(learned):
    docs, y, truth, _ = learned
    got = toxicity.judge(docs, y).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_disguises_are_folded(learned, docs_of):
    _, _, _, lex = learned
    calm = " ".join(["wordaa wordba wordca"] * 10)
    texts = ["vexoid grumlor vexoid", "VEX0ID GRUM1OR vex​oid", "vехоіd grumlоr νexoid", "ｖｅｘｏｉｄ grumlor vexoid", "blasterish blasterly blasterous", calm, "vexoidal convexoid", ""]
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(list(enumerate(f"{calm} {t}" for t in texts))), lex).collect()}
    assert all(got[k] > 0.5 for k in range(5)) and got[5] < 0.1 and got[6] < 0.1 and got[7] < 0.1


def test_exceptions_cancel_hits():
    lex = toxicity.Lexicon({"trash": 3.0}, ["trash can"])
    a = lex.automaton()
    assert toxicity.hits(a, " the trash can ") == {} and toxicity.hits(a, " the trash man ") == {4: 3.0}


def test_matches_brute_force():
    rng = random.Random(0)
    lex = toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "abc*": 1.5, "b*": 0.5}, ["ab abc"])
    for _ in range(200):
        ws = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)]
        want, at = {}, 0
        for k, w in enumerate(ws):
            best = max((v for t, v in lex.weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)), default=0.0)
            spared = ws[k : k + 2] == ["ab", "abc"] or k and ws[k - 1 : k + 1] == ["ab", "abc"]
            if best and not spared:
                want[at] = best
            at += len(w) + 1
        assert toxicity.hits(lex.automaton(), " " + " ".join(ws) + " ") == want


def test_odd_rows(spark, learned, odd_docs, no_docs):
    _, y, _, lex = learned
    got = toxicity.score(odd_docs.select("doc_id", "text"), lex).collect()
    assert len(got) == len(ODD) and {r.score for r in got if r.doc_id in (1, 2, 3)} == {min(r.score for r in got)}
    assert toxicity.judge(odd_docs, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(ODD)
    assert toxicity.judge(odd_docs, spark.createDataFrame([(1, None), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")).count() == len(ODD)
    assert toxicity.judge(no_docs, y).count() == 0


def test_columns_of_any_name_stay(odd_docs):
    got = toxicity.score(odd_docs, toxicity.Lexicon({"same": 3.0}))
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert got.where("x = 1 AND _text = 1").count() == odd_docs.count()
    by = {r.doc_id: r.score for r in got.collect()}
    assert 2**60 + 1 in by and by[6] > by[4] == by[2]


def test_terms_under_a_prefix_are_not_needed():
    rng = random.Random(2)
    for _ in range(100):
        terms = {"".join(rng.choices("ab", k=rng.randint(1, 5))) + rng.choice(["", "*"]): rng.choice([1.0, 2.0, 3.0]) for _ in range(12)}
        few = toxicity.needed(terms)
        a, b = toxicity.Lexicon(terms, ["ab ba"]).automaton(), toxicity.Lexicon(few, ["ab ba"]).automaton()
        for _ in range(20):
            text = f" {' '.join(''.join(rng.choices('ab', k=rng.randint(1, 6))) for _ in range(10))} "
            assert toxicity.hits(a, text) == toxicity.hits(b, text)
    assert toxicity.needed({"ab*": 2.0, "abc": 2.0, "abc*": 1.0, "abd": 3.0, "ab": 2.0}) == {"ab*": 2.0, "abd": 3.0}


def test_workers_let_go_of_the_memo_of_packing(learned, docs_of):
    """A worker that packed before keeps no words while texts are scored."""
    from pyspark.sql import functions as F

    from millrace.llm import packing

    lex = learned[3]
    packing.coder(packing.tokenizer_path())(["some words"])
    level = toxicity.level_of(F.lit(""), lex)
    assert packing._CODERS and level is not None
    toxicity.release("toxicity")
    assert not packing._CODERS
    docs = docs_of([(k, "a vexoid text") for k in range(8)])

    def left(parts):
        import pandas as pd

        for p in parts:
            yield pd.DataFrame({"n": [len(packing._CODERS)] * len(p)})

    packing.pieces(docs).collect()
    toxicity.score(docs, lex).collect()
    assert {r.n for r in docs.mapInPandas(left, "n long").collect()} == {0}
