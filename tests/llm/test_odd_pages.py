"""Pages with nulls, repeated rows, breaks in urls, long values and clashing columns, and tables without rows."""

from __future__ import annotations

import hashlib

import pytest

from wavetally.llm import urls, warc

SCHEMA = "page_id bigint, url string, html string, digest string, first bigint, n bigint, payload string, host string, rule string"
LONG, TWICE = "é" * 3_000_000, "<p>" + "x" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.org/1", TWICE),
        (1, "http://a.org/1", TWICE),  # a repeated row
        (2, None, TWICE),
        (None, "http://a.org/2", TWICE),
        (3, "http://a.org/3", None),
        (4, "http://a.org/4", ""),
        (5, "http://a.org/\r\nWARC-Type: revisit\r\n\r\nx", "short"),
        (6, "http://a.org/" + "p" * 200_000, LONG),
        (7, "", "short"),
        (8, "http://a.org/ é\n\x00end", "\r\n\r\nWARC/1.1\r\n"),
    ]
    return spark.createDataFrame([(*r, "d", 9, 9, "p", "h", "r") for r in rows], SCHEMA)


def test_archives(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"))
    archived = warc.read_archives(spark, str(tmp_path / "a"))
    got = sorted((tuple(r) for r in warc.page_records(archived).collect()), key=str)
    want = []
    for r in pages.collect():
        payload = (r.html or "").encode()
        again = payload == TWICE.encode() and r.page_id != 1
        want.append((r.page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


def test_no_archives(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), str(tmp_path / "a"))
    assert warc.page_records(warc.read_archives(spark, str(tmp_path / "a"))).count() == 0


def test_urls(pages):
    judged = urls.judge_urls(pages).collect()
    assert len(judged) == pages.count()
    assert judged[0] == judged[1]
    by_id = {r.page_id: r for r in judged}
    assert (by_id[2].host, by_id[2].path, by_id[7].host) == ("", "", "")
    assert by_id[None].host == "a.org" and by_id[6].path == "/" + "p" * 200_000
    assert by_id[5].path.startswith("/\r\nWARC") and {r.verdict for r in judged} <= {"allow", "block"}
    assert urls.judge_urls(pages.limit(0)).count() == 0
