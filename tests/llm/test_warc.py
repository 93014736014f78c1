from __future__ import annotations

import gzip
import hashlib

import pytest

from sparkloom.llm.warc import digest, read_archives, read_records, record, save_archives, write_archives


def test_chunks_of_any_size():
    data = record(1, "http://a/ ü\r\nX: y", "é".encode() * 90_000) + record(2, None, b"", 1, 7, "ABC")
    for step in (1, 7, 1000, 1 << 20):
        got = list(read_records(data[i : i + step] for i in range(0, len(data), step)))
        assert [r.headers["warc-type"] for r in got] == ["response", "revisit"]
        assert got[0].payload == "é".encode() * 90_000
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_damage_is_noticed():
    data = record(1, "http://a/", b"body of a page")
    for bad in (data[:-9], data[:40] + bytes([data[40] ^ 255]) + data[41:], b"plain"):
        with pytest.raises(ValueError):
            list(read_records([bad]))


def test_round_trip(spark, tmp_path):
    html = ["<p>x</p>", None, "<p>x</p>", "é", "", "<p>x</p>"]
    pages = spark.createDataFrame([(9 - i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    archives = write_archives(pages)
    got = {r["page_id"]: r for r in read_archives(archives).collect()}
    for i, h in enumerate(html):
        body, same = (h or "").encode(), [9 - j for j, g in enumerate(html) if (g or "") == (h or "")]
        r = got[9 - i]
        first = min(same)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), digest(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
    names = save_archives(archives, str(tmp_path / "out"))
    assert sum(gzip.open(n).read().count(b"WARC/1.1\r\n") for n in names) == 6
    assert write_archives(pages.where("false")).count() == 0


def test_least_size(spark):
    pages = spark.createDataFrame([(i, "u", "short") for i in range(3)], "page_id long, url string, html string")
    assert {r["record_type"] for r in read_archives(write_archives(pages, least=6)).collect()} == {"response"}


def test_one_response_for_repeated_pages(spark):
    """Copies of a page in different tasks, and one page under two urls."""
    rows = [(1, "u", "x")] * 3 + [(2, "u", "x")] + [(5, "b", "y"), (5, "a", "y"), (5, None, "z"), (5, None, "z"), (6, "c", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["url"] or "") for r in read_archives(write_archives(pages)).collect())
    assert sorted((r[0], r[3]) for r in got) == sorted((i, u or "") for i, u, _ in rows)
    want = {digest(b"x"): ("u", 3), digest(b"y"): ("a", 1), digest(b"z"): ("", 1), digest(b"w"): ("c", 0)}
    for sha, (url, revisits) in want.items():
        same = [r for r in got if r[1] == sha]
        assert [r[3] for r in same if r[2] == "response"] == [url] and len(same) == revisits + 1


def member(lines, block):
    return gzip.compress("\r\n".join(["WARC/1.0", *lines, f"content-length:{len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark):
    """Records without digests or page numbers, with folded lines, other cases, other kinds and other digests."""
    body, http = b"<p>\r\n\r\nx</p>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\nx</p>"
    sha256 = hashlib.sha256(http).hexdigest()
    data = member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"software: x\r\n")
    data += member(["warc-type:response", "CONTENT-TYPE: application/http;", " msgtype=response", "WARC-Target-URI:http://a/", f"WARC-Block-Digest: sha256:{sha256}"], http)
    data += member(["WARC-Type: revisit", f"WARC-Payload-Digest: SHA1:{digest(body)}", "WARC-Target-URI: http://b/"], b"")
    data += member(["WARC-Type: resource", f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'').hexdigest()}"], b"")
    got = read_archives(spark.createDataFrame([(bytearray(data),), (bytearray(),)], "archive binary")).collect()
    assert [(r["record_type"], r["url"], r["page_id"], r["refers_to"], r["payload_bytes"]) for r in got] == [("warcinfo", None, None, None, 13), ("response", "http://a/", None, None, len(body)), ("revisit", "http://b/", None, None, None), ("resource", None, None, None, 0)]
    assert bytes(got[1]["payload"]) == body and got[1]["payload_digest"] == got[2]["payload_digest"] == digest(body)
    for bad in (member(["WARC-Type: resource", "WARC-Block-Digest: md5:00"], b"x"), member(["no colon"], b""), gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n\r\n\r\n")):
        with pytest.raises(ValueError):
            list(read_records([bad]))


def test_long_payloads_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    html = ["é" * 1_500_000, "x", "é" * 1_500_000]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in ("payload", "sha", "size", "first", "again", "copies", "n", "archive")})
    got = {r["page_id"]: r for r in read_archives(write_archives(pages)).collect()}
    assert [(got[i]["payload_bytes"], got[i]["record_type"]) for i in range(3)] == [(3_000_000, "response"), (1, "response"), (3_000_000, "revisit")]


def test_pages_without_a_number(spark):
    """Null ids come last among equal payloads; of null ids alone, one is the response, whatever the urls."""
    rows = [(None, "u", "x"), (5, "u", "x"), (7, None, "x"), (None, None, "y"), (None, None, "y"), (None, "v", "y"), (None, "w", "only"), (3, "a", None), (3, "a", None), (None, "a", ""), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (pages, pages.repartition(4)):
        got = read_archives(write_archives(df)).collect()
        assert len(got) == len(rows) and {r["payload_bytes"] for r in got} == {0, 1, 4}
        by = {}
        for r in got:
            by.setdefault(r["payload_digest"], []).append((r["record_type"], r["page_id"], r["refers_to"], r["url"]))
        assert sorted(by[digest(b"x")], key=repr) == sorted([("response", 5, None, "u"), ("revisit", 7, 5, None), ("revisit", None, 5, "u")], key=repr)
        assert sorted(t for t, *_ in by[digest(b"y")]) == ["response", "revisit", "revisit"] and all(x[1:3] == (None, None) for x in by[digest(b"y")])
        assert by[digest(b"only")] == [("response", None, None, "w")]
        assert sorted(by[digest(b"")], key=repr) == sorted([("response", 3, None, "a"), ("revisit", 3, 3, "a"), ("revisit", None, 3, "a"), ("revisit", None, 3, None)], key=repr)
    alone = write_archives(pages, least=2)
    assert sorted(r["record_type"] for r in read_archives(alone).collect()) == ["response"] * len(rows)
