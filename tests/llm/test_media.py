import os

import pytest

from millrace.llm import media
from tests.llm.conftest import ODD


@pytest.mark.parametrize("n", [0, 1, 157, 158, 159, 160, 161, 162, 163, 175, 176, 177, 300, 576, media.UNIT - 1, media.UNIT, media.UNIT + 1, media.UNIT + 162, 3 * media.UNIT + 5, 20 * media.UNIT])
def test_roundtrip(n):
    p = os.urandom(n)
    m = media.mux(p)
    s = media.demux(m)
    assert s.payload == p and s.gaps == 0 and len(m) % 188 == 0
    assert s.stamps == [media.TICKS * k for k in range(-(-n // media.UNIT))] and len(s.access) == len(s.stamps)


def test_packets_follow_the_format():
    m = media.mux(b"x" * 20_000)
    counters = []
    for at in range(0, len(m), 188):
        p = m[at : at + 188]
        assert p[0] == 0x47
        pid = (p[1] & 31) << 8 | p[2]
        if pid == media.STREAM_PID:
            counters.append(p[3] & 15)
            if p[3] & 0x20:
                assert p[4] <= 183
    assert counters == [k % 16 for k in range(len(counters))]
    assert media.crc_mpeg(media.PAT[5:21]) == 0


def test_damage_is_noticed():
    m = bytearray(media.mux(b"y" * 5000))
    with pytest.raises(ValueError):
        media.demux(bytes(m[:-1]))
    lost = bytes(m[: 188 * 5] + m[188 * 6 :])
    assert media.demux(lost).gaps == 1
    m[20] ^= 1
    with pytest.raises(ValueError, match="table"):
        media.demux(bytes(m))


def test_large_clock():
    assert media._stamp((1 << 33) - 1) == b"\x2f\xff\xff\xff\xff"


def test_documents(odd_docs, no_docs):
    import hashlib
    import zlib

    got = media.inspect(media.encode(odd_docs)).collect()
    assert len(got) == len(ODD) and media.inspect(media.encode(no_docs)).count() == 0
    want = []
    for i, t in ODD:
        data = (t or "").encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted(((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    same = [r for r in got if r.id in (6, 7)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1


def test_large_ids_beside_nulls(odd_docs):
    got = {r.id for r in media.inspect(media.encode(odd_docs)).collect()}
    assert {2**60 + 1, None} <= got


def packets(stream):
    return [stream[k : k + 188] for k in range(0, len(stream), 188)]


def test_packets_without_length_stamp_or_payload():
    payload = bytes(range(256)) * 80
    ps = packets(media.mux(payload))
    whole = media.demux(b"".join(ps))
    assert whole.payload == payload and whole.pes == len(whole.stamps) == 3 and whole.streams == ((1, media.PRIVATE, media.STREAM_PID),)
    # no length: each PES packet runs to the next one's start
    head = lambda p: p[1] == 0x41 and p[2] == media.STREAM_PID & 0xFF and p[12:15] == b"\x00\x00\x01"
    open_ = [p[:16] + b"\x00\x00" + p[18:] if head(p) else p for p in ps]
    assert open_ != ps and media.demux(b"".join(open_)).payload == payload
    # no stamp: the flag counts, not the bytes
    bare = [p[:19] + b"\x00" + p[20:] if head(p) else p for p in ps]
    got = media.demux(b"".join(bare))
    assert got.stamps == [] and got.payload == payload
    # adaptation alone doesn't count, and neither does a packet that is repeated
    only = bytes([0x47, ps[3][1] & 0xBF, ps[3][2], 0x20 | ps[3][3] & 15, 183, 0]) + b"\xff" * 182
    got = media.demux(b"".join([*ps[:4], only, ps[3], *ps[4:]]))
    assert got.gaps == 0 and got.payload == payload
    assert media.demux(b"".join(ps[:5] + ps[6:])).gaps == 1


def test_tables_over_several_packets_and_several_programs():
    streams = b"".join(bytes([media.PRIVATE]) + (0xE000 | media.STREAM_PID + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(60))
    section = media._section(0x02, 1, (0xE000 | media.STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + streams)
    first = bytes([0x47, 0x40 | media.PMT_PID >> 8, media.PMT_PID & 255, 0x10, 0]) + section[:183]
    second = (bytes([0x47, media.PMT_PID >> 8, media.PMT_PID & 255, 0x11]) + section[183:]).ljust(188, b"\xff")
    ps = packets(media.mux(b"x" * 1000))
    got = media.demux(b"".join([ps[0], first, second, *ps[2:]]))
    assert len(got.streams) == 60 and got.payload == b"x" * 1000
    assert media.demux(b"".join([ps[0], first, second, *ps[2:]]), media.STREAM_PID + 1).payload == b""


def test_the_query_stores_and_reads_its_media(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op10_media(spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString()
    assert "media-features" in plan and got.count() == odd_docs.count()
