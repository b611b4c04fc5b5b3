"""What a round may schedule."""

from pyspark.sql import functions as F

from crawlframe.config import CrawlConfig
from crawlframe.plans import crawl


def test_nothing_forbidden_is_scheduled(spark):
    link = "".join(f'<a href="http://{s}.example/{p}">' for s in ("open", "free", "shut", "moving", "lost", "unknown") for p in ("new", "seen", "no/x"))
    pages = spark.createDataFrame([(1, "http://open.example/", link)], "page_id bigint, url string, html string")
    log = spark.createDataFrame(
        [("http://open.example/", 200, "User-agent: *\nDisallow: /no\n", None, 0), ("http://free.example/", 404, None, None, 0), ("http://shut.example/", 200, "User-agent: *\nDisallow: /\n", None, 0),
         ("http://moving.example/", 301, None, "http://m.example/robots.txt", 1), ("http://lost.example/", 301, None, "http://m.example/robots.txt", 99)],
        "site string, status int, body string, location string, hops int",
    ).withColumns({"uri": F.concat("site", F.lit("robots.txt")), "looped": F.lit(False)})
    seen = spark.createDataFrame([(f"http://{s}.example/", f"http://{s}.example/seen") for s in ("open", "free")], "site string, uri string")
    # Waiting since earlier rounds, before rules and pages were known.
    waiting = spark.createDataFrame(
        [(f"http://{s}.example/", f"http://{s}.example/{p}") for s in ("open", "free", "shut", "moving", "lost", "unknown") for p in ("seen", "no/old", "old", "pic.jpg")],
        "site string, uri string",
    )
    active = spark.createDataFrame([], "site string")
    state = spark.createDataFrame([], "site string, weight bigint")
    result = crawl.crawl_round(pages, F.lit("en"), log, seen, waiting, active, state, CrawlConfig(target_lang="en", concurrency=25))
    planned = {r.uri for r in result.schedule.collect()}
    assert planned == {"http://open.example/new", "http://open.example/old"} | {f"http://free.example/{p}" for p in ("new", "no/x", "old", "no/old")}
    assert {(r.site, r.kind) for r in result.skipped.collect()} == {("http://shut.example/", "skipped"), ("http://lost.example/", "skipped")}
    assert {r.site for r in result.frontier.collect()} == {"http://moving.example/", "http://unknown.example/"}
