import random

import pytest

from millrace.llm import sentencepiece as sp
from tests.llm.conftest import ODD

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces(sp.model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def units(pieces):
    rng = random.Random(2)
    words = ["".join(rng.choices("aeioutnrsl", k=rng.randint(1, 12))) for _ in range(600)]
    return sorted({*(sp.SPACE + w + rng.choice(["", ".", ",\n", "é"]) for w in words), sp.SPACE + "日本", sp.SPACE * 5 + "x", "qJ9" * 20})


def test_merges_are_the_librarys(spark, pieces, library, units):
    got = {r.unit: list(r.ids) for r in sp.segment(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    assert pieces.bpe and got == {u: library.encode(u[1:]) if u[0] == sp.SPACE else got[u] for u in units}


def best_path(unit, rows, longest, lowest):
    score = {p: (s, i) for p, i, s in rows}
    best = [(0.0, None)] + [(-float("inf"), None)] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - longest), e):
            hit = score.get(unit[s:e]) or ((lowest - 10, -1) if e == s + 1 else None)
            if hit and best[s][0] + hit[0] > best[e][0]:
                best[e] = (best[s][0] + hit[0], (s, hit[1]))
    out, e = [], len(unit)
    while e:
        s, i = best[e][1]
        out.append(i)
        e = s
    return out[::-1]


def test_viterbi_against_brute_force(spark, pieces, units):
    got = {r.unit: list(r.ids) for r in sp.segment(spark.createDataFrame([(u,) for u in units], "unit string"), pieces, bpe=False).collect()}
    for u in units:
        want = best_path(u, pieces.rows, pieces.longest, pieces.lowest)
        if -1 not in want:
            assert got[u] == want
        else:
            assert pieces.decode(got[u]) == u.replace(sp.SPACE, " ")[u[0] == sp.SPACE :]


def test_documents_as_the_library_encodes_them(odd_docs, no_docs, library, docs_of):
    more = [(20, "  a  b "), (21, "x\ny\t日本 é…"), (22, "a" * 300 + " " + "qJ9" * 100), (23, " " * 50), (24, "▁x")]
    got = sp.decode(sp.encode(odd_docs.select("doc_id", "text").unionByName(docs_of(more).select("doc_id", "text")))).collect()
    assert len(got) == len(ODD) + len(more) and sp.encode(no_docs).count() == 0
    for r in got:
        assert list(r.ids) == library.encode(r.text or "")
        assert r.decoded == library.decode(list(r.ids))
        if "▁" not in (r.text or ""):
            assert r.decoded == (r.text or "")


def test_blocks_and_cuts(spark, pieces, library, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [(k, " ".join("".join(rng.choices("abcdeéß日.,!qz", k=rng.randint(0, 14))) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(sp, "BLOCK_ROWS", 7)
    got = {r.id: list(r.ids) for r in sp.encode(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == {k: library.encode(t) for k, t in rows}
    for _, t in rows:
        assert "".join(pieces.units(t)) == (sp.SPACE + t.replace(" ", sp.SPACE) if t else "")


def test_large_ids_beside_nulls(odd_docs):
    assert {2**60 + 1, None} <= {r.id for r in sp.encode(odd_docs).collect()}
