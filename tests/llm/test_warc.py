import base64
import hashlib
import random

import pytest

from wayfowl.llm import warc


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    tied = [[(1, "a"), (2, "a")], [(1, "b"), (1, "c")], [(1, "d")]]
    assert list(warc.LoserTree(tied, lambda x: x[0])) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a")]


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/A/b/?z=1&a=2#x") == "com,example)/a/b?a=2&z=1"
    assert warc.url_key("http://example.com") == warc.url_key("example.com/") == "com,example)/"
    assert warc.url_key("") == ")/"


def test_records_are_put_together_again():
    payloads = [b"", b"plain", b"WARC/1.1\r\n" * 3, b"a\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n", "é\r\n".encode()]
    records = [warc._record(i, "http://a/\r\nx", p, warc.payload_digest(p), None) + b"\r\n" for i, p in enumerate(payloads)]
    data = b"".join(records)
    found = list(warc.parse_archive(data.split(warc.VERSION.encode())))
    assert [b.partition(b"\r\n\r\n")[2] for _, _, b in found] == payloads
    assert [at for at, _, _ in found] == [sum(map(len, records[:i])) for i in range(len(records))]
    assert all(data[at:].startswith(warc.VERSION.encode()) for at, _, _ in found)
    for broken in (data[:-1], data[:-9], b"x" + data, data[: len(records[0]) + 30]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(broken.split(warc.VERSION.encode())))


def test_one_url_without_ids_spreads_over_ranges(spark):
    pages = spark.createDataFrame([(None, "http://a.org/", f"page {i}") for i in range(200)], "page_id long, url string, html string").repartition(4)
    path = warc.shared_folder(spark)
    warc.write_archives(pages, path)
    found = warc.capture_index(warc.written(warc.read_captures(spark, path)), 20).groupBy("range_no").count().collect()
    assert len(found) > 5 and max(r["count"] for r in found) <= 60


def test_query_and_sql_agree(spark, sf):
    import duckdb

    got = warc.op10_warc(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(warc.ORACLE_SQL).fetchall()
    mine = {tuple(None if x != x else x for x in r) for r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)}
    assert mine == set(want) and len(got) == len(want)


def test_odd_rows_and_global_order(spark):
    rows = [(i, f"http://h{i % 7}.org/x y\r\n{i % 3}", "WARC/1.1\r\n\r\né" * (i % 5), "c") for i in range(60)]
    rows += [(None, None, None, None), (70, "u", "z" * 300_000, "c"), (59, "again", "WARC/1.1\r\n\r\né" * 4, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(5)
    found = warc.archive_and_index(pages, min_payload=0).collect()
    assert len(found) == 63
    for r in found:
        same = [x for x in rows if x[0] == r.page_id]
        html = (same[0][2] or "").encode()
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in found}
    assert kinds[0] == ("response", None) and kinds[5] == ("revisit", 0) and kinds[None] == ("revisit", 0) and kinds[70] == ("response", None)
    split = sorted(warc.capture_index(warc.written(spark.createDataFrame([(*[r[c] for c in warc._COLUMNS], 0, i) for i, r in enumerate(sorted(found, key=lambda r: (r.archive, warc._order(r))))], f"{warc._CAPTURE}, run long, seq long")), 10).collect(), key=lambda r: (r.range_no, r.place))
    keys = [warc._order(tuple(r[c] for c in warc._COLUMNS)) for r in split]
    assert keys == sorted(keys) and len(keys) == 63 and len({r.range_no for r in split}) > 3
    small = warc.archive_and_index(pages, min_payload=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.archive_and_index(pages.limit(0)).count() == 0
