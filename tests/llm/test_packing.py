import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing
from tests.llm.conftest import ODD


def best_fit(lengths, size):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    runs = packing.plan(counts, 64)
    slots, ranks = {}, {n: set() for n in counts}
    for length, rank, number, sequence, per, at in runs:
        for k in range(number):
            ranks[length].add(rank + k)
            slots.setdefault(sequence + k // per, []).append((at + k % per * length, length))
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    for pieces in slots.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 64
    assert len(slots) == best_fit([n for n, c in counts.items() for _ in range(c)], 64)


def test_plan_refuses_pieces_that_do_not_fit():
    with pytest.raises(ValueError, match="does not fit"):
        packing.plan({65: 1}, 64)


def test_words_and_whole_texts_have_the_same_ids():
    c = packing.coder(packing.tokenizer_path())
    texts = ["", " ", "a..b, \"c,\" d.. É. 3.", "it's I'LL\x1c x <|endoftext|> İ ΣΣ. ", "ΑΣ, foo\n\nbar.", "x́. e ́", "A,, b. C.", *[t for _, t in ODD if t]]
    assert c.by_word and c(texts) == c.whole(texts)


def test_pieces_against_brute_force(odd_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(odd_docs, size=50).collect()
    want = []
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 50)):
            part = np.array(ids[at : at + 50], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 50
    assert len(by) == best_fit([w[3] for w in want], 50)


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_added_tokens_and_marks_are_encoded_as_the_tokenizer_does():
    import random

    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    code, tok, rng = packing.Coder(path), Tokenizer.from_file(path), random.Random(8)
    assert code.by_word
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "T̈", "H̱", "á", "́", "\x01", "it's.", "IT'S", "x.", ".,", "Ä", "ß", " ", "\n", "　", "é", "7x", "İ", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(5000)]
    want = [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = code(texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_large_ids_beside_nulls(odd_docs):
    got = {r.id for r in packing.pieces(odd_docs).collect()}
    assert 2**60 + 1 in got and None in got
