"""Round trips, the law of revisits and the order of the index."""

import base64
import hashlib
import random

from crawlframe.llm import warc


def want(rows):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    out = []
    for i, u, h in rows:
        body, top = (h or "").encode(), largest.get(h or "")
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, u, len(body), digest, "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def test_archives(spark):
    odd = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "é" * 10), (4, "http://b.example/%41 \n\té?q=1#f", odd), (5, "x y", odd),
            (5, "x y", odd), (None, "http://a.example/", "only null"), (6, "", "z" * 3_000_000), (7, "http://a.example/x", "\x00\x85 ")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS value", "2 AS _sum")
    out = warc.archive(pages).collect()
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
    assert got == want(rows)
    assert warc.archive(pages.where("false")).count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_query_and_order(spark, sf_dir):
    from crawlframe.llm.queries import QUERIES

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    out = QUERIES["op7_warc"](spark, sf_dir).collect()
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
    assert got == want(rows)
    keys = [(r.url_key, r.captured, r.page_id) for r in out]
    assert keys == sorted(keys)


def test_payloads_are_shuffled_once(spark):
    rows = spark.createDataFrame([(i, f"https://h/{i}", "x" * (i % 3)) for i in range(30)], "page_id bigint, url string, html string")
    made = warc.archive_records(rows)
    assert made.count() == 30
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE" not in plan and "BroadcastHashJoin" not in plan
