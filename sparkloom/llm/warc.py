"""WARC archives: a gzip member per record, revisit records for payloads seen before, and a sequential reader.

The reader walks an archive from its beginning: it decompresses one member after another in small steps, takes the
header block, then exactly Content-Length bytes, and holds the block's and the payload's digest against the header.
Archives are rows of a table in the shared folder, each the bytes of a `.warc.gz` file of about `ARCHIVE_BYTES`, so that
any store that Spark writes to will do; `save_archives` puts them out as files.

Defined results: null html is the empty payload, null urls are left out of the header; of rows with the same payload the
one with the smallest page_id is the response (of rows with the same page_id too, one: the least by url); rows without a
page_id come last, so one of them is the response only if no row with the payload has one, and then the others revisit it
with refers_to null; a payload below `least` bytes is always a response; an empty table gives no archives; damaged records
raise ValueError. Header names are read in any case,
digests are verified where a record has them; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, settle

ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


_KINDS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}


def _verify(what: str, given: str | None, data: bytes) -> None:
    """Hold data against a digest in base32 or hex, if there is one of a known kind."""
    kind, _, value = (given or "").partition(":")
    make = _KINDS.get(kind.strip().lower().replace("-", ""))
    if make is None:
        return
    own, value = make(data).digest(), value.strip()
    if value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("="):
        raise ValueError(f"a {what}'s digest differs")


def _headers(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank continues the one before; of repeated fields the first counts."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line[:40]!r}")
        name = name.strip().lower()
        if name in out:
            name = f"{name} again"
        out[name] = value.strip()
    return out


def _url(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def _record_id(page_id: int | None, sha: str) -> str:
    """Of the page, or where it has no number of the payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'payload:{sha}' if page_id is None else f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, size: int | None = None, sha: str | None = None, revisit: bool | None = None) -> bytes:
    """One record as a gzip member. A revisit has the payload's digest and size, not the payload; it may be one of a page
    without a number."""
    revisit = refers_to is not None if revisit is None else revisit
    block = b"" if revisit else HTTP % len(payload) + payload
    sha = sha or digest(payload)
    told = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, sha)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_url(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Bytes: {len(payload) if size is None else size}",
        *([told, f"WARC-Refers-To: {_record_id(refers_to, sha)}"] if revisit else []),
        *([f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive that comes in chunks; at most one record and one step are held."""
    chunks = iter(chunks)
    left = b""
    while True:
        while not left:
            left = next(chunks, None)
            if left is None:
                return
        member, plain, headers, need = zlib.decompressobj(31), bytearray(), None, 0
        while not member.eof:
            if not left:
                left = next(chunks, None)
                if left is None:
                    raise ValueError("the archive ends inside a record")
            try:
                plain += member.decompress(left[:STEP])
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from e
            left = member.unused_data + left[STEP:] if member.eof else left[STEP:]
            if headers is None and (at := plain.find(b"\r\n\r\n")) >= 0:
                first, *lines = plain[:at].decode(errors="replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {first[:20]!r}")
                headers = _headers(lines)
                need, plain = int(headers.get("content-length", -1)), plain[at + 4 :]
        if headers is None or need < 0 or bytes(plain[need:]) != b"\r\n\r\n":
            raise ValueError("a record's content isn't as long as its header says")
        block = bytes(plain[:need])
        _verify("block", headers.get("warc-block-digest"), block)
        http = headers.get("content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if headers.get("warc-type") != "revisit":  # a revisit's digest is that of the payload it leaves out
            _verify("payload", headers.get("warc-payload-digest"), payload)
        yield Record(headers, payload)


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html -> archives (archive binary, n_records), in the shared folder.

    Digests alone are shuffled to find the first of equal payloads; a payload that many pages have is pre-aggregated.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = base.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload").cast("long")})
    #: one row is the response: the least by page_id (null last) and url, and one of its copies where it is repeated
    alike = keyed.where(F.col("size") >= least).groupBy("sha", "size", "page_id", "url").agg(F.count("*").alias("copies"))
    least_row = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "copies"))
    firsts = alike.groupBy("sha", "size").agg(least_row.alias("f"), F.sum("copies").alias("n")).where("n > 1")
    firsts = settle(firsts.select("sha", "size", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.col("f.copies").alias("copies"), F.col("n").alias("__n")))
    own = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    columns = ["page_id", "url", "payload", "sha", "size", "first", "again"]
    #: a payload that a great part of the pages have is dealt to many tasks
    joined = join_hot(keyed, firsts, ["sha", "size"], F.struct("page_id", "url"), "left")
    marked = joined.where(F.col("copies").isNull() | ~own | (F.col("copies") == 1))
    marked = marked.withColumn("again", F.col("copies").isNotNull() & ~own).select(*columns)
    if not firsts.where("copies > 1").isEmpty():
        #: of copies of the response's row, each task keeps one; they are numbered, the first is the response
        one = joined.where(own & (F.col("copies") > 1)).groupBy("sha", "size").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload", "first", "copies")))
        numbered = one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("again", F.col("i") > 1)
        marked = marked.unionByName(numbered.withColumn("payload", F.when(~F.col("again"), F.col("payload")).otherwise(F.lit(b""))).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for page, url, body, sha, long, first, again in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                records.append(record(page, url, body, first if again else None, long, base64.b32encode(sha).decode(), again))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary()), pa.array([len(records)], pa.int64())], names=["archive", "n_records"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(records)], pa.binary()), pa.array([len(records)], pa.int64())], names=["archive", "n_records"])

    return settle(marked.mapInArrow(run, "archive binary, n_records long"))


def save_archives(archives: DataFrame, folder: str) -> list[str]:
    """Put archives out as .warc.gz files in a folder that all executors mount; gives their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = []
            for data in batch.column("archive").to_pylist():
                #: a repeated task writes the same name
                names.append(f"{folder}/{hashlib.sha256(data).hexdigest()[:24]}.warc.gz")
                with open(f"{names[-1]}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(f.name, names[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return sorted(r["name"] for r in archives.select("archive").mapInArrow(run, "name string").collect())


def read_archives(archives: DataFrame) -> DataFrame:
    """archive -> a row for each record, of our own archives and of others.

    Others have records of more kinds, which come with their block or HTTP body as payload, and no page numbers: page_id
    and refers_to are null there, payload_digest is taken from the payload, and a revisit has no size and the digest
    given, null if that isn't SHA-1.
    """

    def number(headers: dict[str, str], name: str) -> int | None:
        return int(headers[name]) if name in headers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("archive").to_pylist():
                rows = []
                for r in read_records(data[i : i + STEP] for i in range(0, len(data), STEP)):
                    h, kind = r.headers, r.headers.get("warc-type")
                    again = kind == "revisit"
                    size = number(h, "x-payload-bytes") if again else len(r.payload)
                    given = h.get("warc-payload-digest", "")
                    sha = given.partition(":")[2].strip() if given.lower().startswith("sha1:") else None
                    rows.append((number(h, "x-page-id"), h.get("warc-target-uri"), None if again else r.payload, size, sha if again else digest(r.payload), kind, number(h, "x-refers-to-page")))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("archive").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
