import hashlib

import pytest

from histshift.llm import warc as R
from histshift.llm.queries import ORACLE, QUERIES
from histshift.session import fresh_path
from histshift.testing.compare import compare
from tests.conftest import SF001

SCHEMA = "page_id long, url string, html string, record_type string"


def pages(spark):
    big = "<p>\u00e9\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, None, "x" * 999), (4, "u\r\nX: y \u00e9", "x" * 999),
            (5, "", None), (6, "http://a/6", ""), (7, "http://a/7", big), (8, "http://a/8", big + "!"), (9, "http://a/9", big),
            (10, "http://a/10", "a"), (10, "http://a/10", "a"), (11, "b", "0\r\n\r\n"), (None, "n", "x" * 5000), (12, "p", "x" * 1000)]
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    by_payload = {}
    for page, url, html, *_ in rows:
        by_payload.setdefault((html or "").encode(), []).append((page is not None, page, url is not None, url))
    out = []
    for body, group in by_payload.items():
        group.sort(key=lambda g: (g[0], g[1] or 0, g[2], g[3] or ""), reverse=True)
        for k, (_, page, _, _) in enumerate(group):
            again = len(body) >= 1000 and k > 0
            out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", group[0][1] if again else None, True))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip_of_edge_rows(spark):
    df = pages(spark)
    assert rows_of(R.archive_digest(spark, df)) == brute([tuple(r) for r in df.collect()])


def test_repeated_and_null_ids_have_records_of_their_own(spark, monkeypatch):
    big = "y" * 1500
    rows = [(1, "u", big), (1, "v", big), (1, None, "z" * 2000), (1, "u", "small"), (None, "u", big), (None, None, "z" * 2000),
            (None, None, "q" * 1000), (None, "n", "q" * 1000), (2, "u", "p" * 1000)] + [(7, "c", "w" * 1200)] * 23 \
        + [(8, "c", "few")] * 17 + [(None, None, None)] * 12
    monkeypatch.setattr(R, "COPIES", 5)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert rows_of(R.archive_digest(spark, df)) == brute(rows)
    path = fresh_path(spark, "warc-test")
    R.write_archives(df, path, segment=900)
    ids = [r.record_id for r in R.read_records(spark, path).collect()]
    assert len(ids) == len(set(ids)) == len(rows)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_and_segments_read_back(spark, compression):
    df, path = pages(spark), fresh_path(spark, "warc-test")
    R.write_archives(df, path, segment=5000, records=7, compression=compression)
    got = R.read_records(spark, path).collect()
    html = [(r.html or "").encode() for r in df.collect()]
    assert len(got) == len(html) and all(r.ok for r in got)
    assert sorted(hashlib.sha1(b).hexdigest() for b in html) == sorted(r.declared for r in got)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == set(html)
    at = {int(r.record_id.split(":")[2].split("/")[0]): r for r in got if "null" not in r.record_id}
    assert at[4].target_uri == "u%0D%0AX:%20y%20%C3%A9" and at[3].target_uri is None


def test_missing_or_short_segments_are_marked(spark):
    whole = list(R.page_records(R.page_uri(1), "u", b"z" * 100_000, None, 32 * 1024))
    assert len(whole) == 4
    for k in range(4):
        path = fresh_path(spark, "warc-broken")
        rows = [(r.decode(),) for i, r in enumerate(whole) if i != k]
        spark.createDataFrame(rows, "value string").write.option("lineSep", R.END.decode()).text(path)
        got, = R.read_records(spark, path).collect()
        assert not got.ok and got.record_id == R.page_uri(1)


@pytest.mark.parametrize("size", [0, 1, 8191, 8192, 8193, 100_000])
def test_chunked_framing(size):
    body = bytes(range(256)) * (size // 256 + 1)
    assert R.dechunk(R.chunked(body[:size])) == (body[:size], True)
    assert not R.dechunk(R.chunked(body[:size])[:-6] or b"")[1]
    assert R.dechunk(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == (b"abc", True)


def test_empty_table_and_oracle(spark):
    assert R.archive_digest(spark, pages(spark).limit(0)).count() == 0
    r = compare(QUERIES["op6_warc"](spark, SF001), ORACLE["op6_warc"], SF001)
    assert r["columns_match"] and r["values_match"], r
