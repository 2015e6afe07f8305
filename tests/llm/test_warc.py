"""Archives written and read back, against hashlib and base64."""

import base64
import hashlib

import pytest

from lexitally.llm import warc as Z

PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>two é\r\n\r\nWARC/1.1\r\n</p>"), (3, None, "<p>one</p>"),
         (4, "http://c/\r\nx", None), (5, "u", ""), (6, "u", "<p>one</p>"), (None, "n", "<p>one</p>"),
         (7, "u", "x" * 200000), (8, "u", "x" * 200000), (9, "u", "\n\r\n\r\n")]
DDL = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_digest_expression(spark):
    rows = [(t,) for _, _, t in PAGES if t is not None] + [("é" * n,) for n in range(20)]
    got = spark.createDataFrame(rows, "t string").select("t", Z.base32_sha1("t")).collect()
    assert all(d == digest(t) for t, d in got)


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], DDL + ", payload_digest_ string").repartition(3)
    got = Z.round_trip(df, least).collect()
    assert len(got) == len(PAGES)
    by_id = {r["page_id"]: r for r in got}
    first = {}
    for page, _, text in sorted((p for p in PAGES if p[0]), key=lambda p: p[0]):
        first.setdefault(digest(text), page)
    for page, url, text in PAGES:
        r, size = by_id[page], len((text or "").encode())
        assert r["payload_bytes"] == size and r["payload_digest"] == digest(text) and r["resolved"] and r["digest_ok"]
        original = first[digest(text)] if page and size >= least else page
        assert r["record_type"] == ("response" if original == page else "revisit")
        assert r["refers_to"] == (None if original == page else original)
        assert r["url"] == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))


def test_payloads_come_back_and_revisits_carry_none(spark, tmp_path):
    df = spark.createDataFrame(PAGES, DDL)
    path = str(tmp_path / "w")
    Z.write_archives(df, path, date="2024-01-01T00:00:00Z")
    found = Z.read_archives(spark, path)
    raw = {r["page_id"]: r for r in found.collect()}
    assert raw[3]["payload"] is None and raw[3]["warc_date"] == "2024-01-01T00:00:00Z"
    full = {r["page_id"]: bytes(r["payload"]) for r in Z.resolve_revisits(found).collect()}
    assert full == {p: (t or "").encode() for p, _, t in PAGES}


def test_missing_response_is_marked(spark, tmp_path):
    path = str(tmp_path / "w")
    Z.write_archives(spark.createDataFrame(PAGES, DDL), path)
    found = Z.read_archives(spark, path).where("record_type = 'revisit'")
    assert {(r["resolved"], r["payload_bytes"]) for r in Z.resolve_revisits(found).collect()} == {(False, 10), (False, 200000), (False, 0)}


def test_empty_table(spark):
    assert Z.round_trip(spark.createDataFrame([], DDL)).count() == 0
