"""WARC archives written and read through an index.

Payloads that repeat are found first: of equal payloads of at least ``REVISIT`` bytes the largest id is the response
and the others become revisit records without payload. Archives are gzip members, one per record, written by
the tasks into the shared folder through ``pyarrow.fs``; each attempt of a task writes files of its own name, and the index
(file, offset, length, URL, digest per record) names only those of the attempts that succeeded, so a lost executor
leaves at most unused files. Reading starts from the index: the selected records are dealt out by file and
stretch, their byte ranges are sorted, neighbours are coalesced into one read, and members are parsed out of it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from math import ceil
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, look_up, read, remove, shared_dir, table

if TYPE_CHECKING:
    import pyarrow as pa

REVISIT = 1000
#: Bytes of an archive file, of the stretch of a file that one group reads, of a gap read over, and of one read.
FILE, STRETCH, GAP, READ = 256 << 20, 8 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"  # the tables have no crawl time
INDEX = "id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def filesystem(uri: str):
    """A pyarrow file system and path; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def record(key: int | None, url: str, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit carries headers alone; a page without an id gets a random record id."""
    name = "sha1:" + b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{f'uuid:{uuid.uuid4()}' if key is None else f'millrace:page:{key}'}>", f"WARC-Date: {DATE}"]
    # a line break inside a URL would end its header
    head += [f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}"] if url else []
    head += [f"WARC-Payload-Digest: {name}"]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head += ["Content-Type: application/http;msgtype=response"]
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:millrace:page:{refers_to}>"]
        head += ["Content-Type: application/http;msgtype=response"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, html, digest, refers_to: what each record will be. Null html counts as empty.

    Of equal payloads the rows with the largest id are responses, each of them if it repeats; rows without an id revisit
    them, and are responses where no row of their payload has one.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    big = table(p.where(F.octet_length("html") >= REVISIT).select("id", "digest"), "payloads")
    groups = big.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    again = look_up(big, "digest", groups, "id", "inner").where("id IS NULL OR id != response")
    again = table(again.select(F.col("id").alias("of"), F.col("digest").alias("same"), F.col("response").alias("refers_to")).distinct(), "revisits")
    drop(big)
    match = p["id"].eqNullSafe(again["of"]) & (p["digest"] == again["same"]) & (F.octet_length("html") >= REVISIT)
    return p.join(again, match, "left").select("id", "url", "html", "digest", "refers_to")


def write(pages: DataFrame, folder: str | None = None, level: int = 3, **columns) -> DataFrame:
    """Write archives for all pages and return their index (written as a table in the shared folder)."""
    spark = pages.sparkSession
    root = (folder or f"{shared_dir(spark)}/millrace/warc").rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        fs, path = filesystem(root)
        fs.create_dir(path, recursive=True)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for key, url, html, digest, to in zip(*[b.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers_to")], strict=True):
                    if out is None:
                        name, at = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(name, compression=None)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record(key, url or "", html.encode("utf-8", "replace"), digest, to)) + z.flush()
                    out.write(member)
                    rows.append((key, name, at, len(member), url, digest, "response" if to is None else "revisit", to))
                    at += len(member)
                    if at >= FILE:
                        out.close()
                        out = None
                if rows:
                    columns = zip(zip(*rows, strict=True), types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return table(plan(pages, **columns).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Read the records of the given index rows: id, record_type, url, payload_bytes, payload_digest, refers_to [, payload].

    Sizes and digests are measured on the bytes read; a response whose bytes don't have the digest of its header
    raises an error. A revisit has its header's digest and no size of its own.
    """
    root = (folder or f"{shared_dir(index.sparkSession)}/millrace/warc").rstrip("/")

    def run(t: pa.Table) -> pa.Table:
        import pyarrow as pa

        fs, _ = filesystem(root)
        t = t.sort_by("offset")
        rows = []
        with fs.open_input_file(t["file"][0].as_py()) as f:
            offsets, lengths, keys = t["offset"].to_pylist(), t["length"].to_pylist(), t["id"].to_pylist()
            k = 0
            while k < len(keys):
                end, last = offsets[k] + lengths[k], k + 1
                while last < len(keys) and offsets[last] <= end + GAP and offsets[last] + lengths[last] - offsets[k] <= READ:
                    end, last = max(end, offsets[last] + lengths[last]), last + 1
                data = f.read_at(end - offsets[k], offsets[k])
                for j in range(k, last):
                    at = offsets[j] - offsets[k]
                    head, payload = parse(zlib.decompress(data[at : at + lengths[j]], 31))
                    kind = head["WARC-Type"]
                    sha = hashlib.sha1(payload).hexdigest()
                    named = b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and sha != named:
                        raise ValueError(f"record {keys[j]} has bytes of another digest")
                    to = head.get("WARC-Refers-To")
                    to = int(to.strip("<>").rsplit(":", 1)[1]) if to else None
                    rows.append((keys[j], kind, head.get("WARC-Target-URI"), len(payload) if kind == "response" else None, named, to, *([payload] if with_payload else [])))
                k = last
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
        names = ["id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else [])]
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if with_payload else "")
    chosen = index.select("id", "file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # an index row is small beside its record, so tasks are dealt out by the bytes of archive that they read
    tasks = max(1, ceil((chosen.agg(F.sum("length")).first()[0] or 0) / STRETCH))
    return chosen.repartition(tasks, "file", "stretch").groupBy("file", "stretch").applyInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write all pages, read all records back: id, payload_bytes, payload_digest, record_type, refers_to per page.

    A revisit's size and digest are those of the response it refers to, as read back. Rows with null or repeated ids keep
    their rows (see :func:`plan`). Null html is an empty payload, a null URL has no target header. Extra columns are
    ignored. An empty table gives an empty result. Archives stay in ``folder``; without one they go when they are read.
    """
    spark = pages.sparkSession
    root = folder or f"{shared_dir(spark)}/millrace/warc-{uuid.uuid4().hex}"
    index = write(pages, root, **columns)
    got = table(read_records(index, root), "warc-read")
    if folder is None:
        drop(index)
        remove(spark, root)
    response = F.col("record_type") == "response"
    own = F.concat_ws(" ", F.when(response, F.col("id")).otherwise(F.col("refers_to")), "payload_digest")
    got = got.withColumn("key", F.when(~response, own))
    full = got.where(response & F.col("id").isNotNull()).groupBy(own.alias("key")).agg(F.max("payload_bytes").alias("n"))
    first = got.where(response).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    back = look_up(got.where(~response), "key", full, "id", "inner").select("id", "n", "payload_digest", "record_type", "refers_to")
    return first.union(back)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every page, read back from its archive."""
    return archive(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP7_SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN g.response IS NULL OR g.response = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.response <> p.page_id THEN g.response END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
