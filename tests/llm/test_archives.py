from __future__ import annotations

import base64
import hashlib
import io

import pytest

from tidegauge.llm import archives

PAGES = [
    (1, "http://a/1", "<p>same</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2", "<p>same</p>\r\n\r\nWARC/1.1\r\n"),
    (3, "http://a/3 ", None), (4, None, ""), (5, "http://ä/%20", "é日本\r\n\r\n"), (6, "line\nbreak", "x" * 3_000_000),
    (7, "http://a/7", "only"), (7, "http://a/7", "only"), (None, "http://a/none", "only"), (None, None, None),
    (0, "http://a/0", "<p>same</p>\r\n\r\nWARC/1.1\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, record_type string")


def literal(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if same else None
        revisit = page is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def found(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_messy_pages(spark):
    assert found(archives.archive_pages(pages(spark))) == literal(PAGES)
    assert archives.archive_pages(pages(spark, [])).count() == 0


def test_small_payloads_stay_responses(spark):
    got = archives.archive_pages(pages(spark), min_bytes=1)
    assert {r["record_type"] for r in got.filter("payload_bytes = 0").collect()} == {"response"}


def test_files_are_archives_and_keep_every_payload(spark, tmp_path):
    archives.archive_pages(pages(spark), folder=str(tmp_path / "warc"))
    rows = {r["page_id"]: r for r in archives.read_archives(spark, str(tmp_path / "warc/raw")).collect()}
    assert rows[5]["payload"] == "é日本\r\n\r\n" and rows[5]["url"] == "http://ä/%20"
    assert rows[6]["url"] == "line%0Abreak" and rows[4]["url"] is None
    fresh = archives.read_archives(spark, str(tmp_path / "warc/deduplicated")).collect()
    payloads = {r["payload_digest"]: r["payload"] for r in fresh if r["record_type"] == "response"}
    for _, _, html in PAGES:
        assert payloads[archives.payload_digest((html or "").encode())] == (html or "")


def test_archives_that_hold_revisits_are_resolved_again(spark, tmp_path):
    folder = str(tmp_path / "warc")
    archives.archive_pages(pages(spark), folder=folder)
    archives.deduplicate(spark, f"{folder}/deduplicated", f"{folder}/again")
    assert found(archives.read_archives(spark, f"{folder}/again")) == literal(PAGES)


def test_broken_archives_are_errors():
    row = {"page_id": 1, "url": "u", "payload": "abc", "record_type": "response", "payload_bytes": 3,
           "payload_digest": archives.payload_digest(b"abc"), "refers_to": None, "refers_url": None}
    whole = (archives.record(row) + archives.END).encode()
    assert [r["payload"] for r in archives.parse(io.BytesIO(whole * 2))] == ["abc", "abc"]
    for broken in (whole[:-5], whole[:20], b"junk\r\n\r\n", whole + b"x"):
        with pytest.raises(ValueError):
            list(archives.parse(io.BytesIO(broken)))


def test_query_equals_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/pages.parquet")
    assert found(archives.archive_pages(table)) == literal([(r["page_id"], r["url"], r["html"]) for r in table.collect()])
