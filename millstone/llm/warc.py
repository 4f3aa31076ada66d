"""WARC archives written index first, and read back by coalesced byte ranges.

``write_archives`` puts one record per page into gzipped WARC files (a member a record) and
returns the index: file, offset, length, URL and digest of every record. Each task writes
files of its own, under names that no other attempt uses, and only the rows of attempts
that Spark commits reach the index; what a lost executor left behind is never referred to.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page
id is a ``response``; the others ``revisit`` it and hold no block. Smaller ones are all
``response``. The group's largest id comes from a grouped aggregate over (digest, id), so
copies are never gathered. A bitmap of the digests that occur twice (``BITMAP_BITS`` at most) keeps
all other rows where they are: payloads are shuffled only for rows that it lets through, to
be joined with their group's largest id; Spark splits a hot digest's rows in that join.

``read_records`` takes any selection of index rows, deals them by file and range of offsets to as
many tasks as the selected bytes ask for, sorts them, merges neighbouring ranges with gaps up to ``gap`` bytes into
reads of ``most``
bytes, and parses and verifies the records.

A null payload is empty; a null URL leaves out the target; null page ids are kept, and
never chosen over an id. Rows with equal id and payload have the same type. Columns other than
the three named ones are not read, whatever their names; an empty table gives an empty index. A
long payload is one record; its task holds it some four times over (payload, block, member, batch).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millstone.llm.shared import bitmap_of, filesystem, in_bitmap, scratch, stored

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed, so that the same pages give the same bytes.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3
#: Bytes after which a task begins another file; of a deal of index rows to a reading task.
FILE_BYTES = 1 << 30
DEAL_BYTES = 32 << 20
#: Bits of the bitmap of repeated digests, at most (16 MiB).
BITMAP_BITS = 1 << 27


def _uri(url: str) -> str:
    """The URL with control characters and blanks percent-encoded, so that it stays in its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    size: int,
    refers_to: int | None,
    date: str = DATE,
) -> bytes:
    """One WARC/1.1 record, not compressed."""
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32}")
    head.append(f"Payload-Length: {size}")
    block = b""
    if refers_to is None:
        block = HTTP + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; its payload is verified against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    at = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    length = int(at["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    digest = base64.b32decode(at["warc-payload-digest"].removeprefix("sha1:")).hex()
    page = at["warc-record-id"][len("<urn:page:") : -1]
    refers = at.get("warc-refers-to")
    payload = None
    if at["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(at["payload-length"]):
            raise ValueError(f"record {page}: its payload is not what was written")
    return {
        "page_id": int(page) if page else None,
        "url": at.get("warc-target-uri"),
        "record_type": at["warc-type"],
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload_bytes": int(at["payload-length"]),
        "payload_digest": digest,
        "payload": payload,
    }


def labelled(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000
) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, refers_to (null: a response)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    )
    rows = rows.select(
        "page_id",
        "url",
        F.sha1("payload").alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
    )
    copies = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("digest", "kept")
    copies = stored(copies, "warc-copies")
    bits = pages.sparkSession.sparkContext.broadcast(
        bitmap_of(copies.select(F.xxhash64("digest").alias("item")), BITMAP_BITS)
    )

    @arrow_udf("boolean")
    def repeated(names: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, np.asarray(names)))

    rows = rows.withColumn("maybe", repeated(F.xxhash64("digest")))
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    names = ["page_id", "url", "digest", "payload_bytes"]
    single = rows.where(~F.col("maybe")).select(*names, F.lit(None).cast("long").alias("refers_to"), "payload")
    joined = rows.where("maybe").join(copies, "digest", "left").select(
        *names, refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload")
    )
    return single.unionByName(joined)


def write_archives(rows: DataFrame, folder: str | None = None, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``labelled`` rows as archives in ``folder`` (a new shared one by default); returns the stored index."""
    spark = rows.sparkSession
    folder = folder or scratch(spark, "warc")
    given = rows.select("page_id", "url", "digest", "payload_bytes", "refers_to", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                types, files, offsets, lengths = [], [], [], []
                for page, url, digest, size, refers, payload in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True
                ):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        fs.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = z.compress(record(page, url, payload or b"", digest, size, refers)) + z.flush()
                    out.write(member)
                    types.append("response" if refers is None else "revisit")
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(member))
                    at += len(member)
                c = batch.columns
                yield pa.RecordBatch.from_arrays(
                    [
                        c[0],
                        c[1],
                        c[2],
                        c[3],
                        pa.array(types, pa.string()),
                        c[4],
                        pa.array([f"{folder}/{f}" for f in files], pa.string()),
                        pa.array(offsets, pa.int64()),
                        pa.array(lengths, pa.int64()),
                    ],
                    [
                        "page_id",
                        "url",
                        "digest",
                        "payload_bytes",
                        "record_type",
                        "refers_to",
                        "file",
                        "offset",
                        "length",
                    ],
                )
        finally:
            if out is not None:
                out.close()

    return stored(given.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 4 << 20, deal: int = DEAL_BYTES) -> DataFrame:
    """The records of the selected index rows (``RECORD``); a revisit's payload is null."""
    given = index.select("file", "offset", "length")
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // deal + 1
    given = given.repartition(int(tasks), "file", F.floor(F.col("offset") / deal)).sortWithinPartitions(
        "file", "offset"
    )
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        """File, start, end and records of each read."""
        now: tuple[str, int, int, list[tuple[int, int]]] | None = None
        for batch in batches:
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] == file and at - now[2] <= gap and at + n - now[1] <= most:
                    now[3].append((at, n))
                    now = (file, now[1], max(now[2], at + n), now[3])
                else:
                    if now:
                        yield now
                    now = (file, at, at + n, [(at, n)])
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        try:
            for file, start, end, records in ranges(batches):
                if file != opened:
                    if stream is not None:
                        stream.close()
                    fs, path = filesystem(file)
                    opened, stream = file, fs.open_input_file(path)
                raw = stream.read_at(end - start, start)
                yield pa.RecordBatch.from_pylist(
                    [parse(zlib.decompress(raw[at - start : at - start + n], 31)) for at, n in records], schema=schema
                )
        finally:
            if stream is not None:
                stream.close()

    return given.mapInArrow(run, RECORD)
