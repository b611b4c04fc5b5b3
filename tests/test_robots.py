import pytest
from pyspark.sql import functions as F

from crawlframe.operators import robots

AGENT = "crawlframe-bot"


def decide(spark, body, path):
    docs = spark.createDataFrame([("http://h.example.org/", body)], "site string, body string")
    link = spark.createDataFrame([("http://h.example.org/", "http://h.example.org" + path)], "site string, uri string")
    return robots.robots_decisions(link, robots.rule_sets(docs, AGENT)).first().allowed


@pytest.mark.parametrize(
    "body, path, allowed",
    [
        ("", "/x", True),
        ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: *\nDisallow: /", "/x", False),
        ("User-agent: other\nDisallow: /", "/x", True),
        ("User-agent: other\nUser-agent: Crawlframe-Bot\nDisallow: /p", "/p/1", False),
        ("User-agent: crawlframe\nAllow: /\nUser-agent: *\nDisallow: /", "/p", True),
        ("User-agent: *\nDisallow: /\nUser-agent: crawlframe-bot\nDisallow: /q", "/p", True),
        ("User-agent: *\nDisallow: /a\n\nSitemap: /s.xml\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /*.php$", "/x/y.php", False),
        ("User-agent: *\nDisallow: /*.php$", "/x/y.php?q", True),
        ("User-agent: *\nDisallow: /x?y", "/x?y=1", False),
        ("user-AGENT : * # all\r\n  DISALLOW : /c # secret\r\n", "/c", False),
        ("User-agent: *\nDisallow: /日", "/%E6%97%A5/x", False),
        ("﻿User-agent: *\nDisallow: /b", "/b", False),
        ("Disallow: /\nUser-agent: *\nDisallow: /b", "/a", True),
        ("User-agent: *\nDisallow: /a\nUser-agent: x\nDisallow: /b\nUser-agent: *\nDisallow: /c", "/c", False),
    ],
)
def test_rules(spark, body, path, allowed):
    assert decide(spark, body, path) is allowed


def test_site_without_rules_is_open(spark):
    sets = robots.rule_sets(spark.createDataFrame([], "site string, body string"), AGENT)
    links = spark.createDataFrame([("http://a/", "http://a/x"), (None, "x")], "site string, uri string")
    assert robots.robots_allow(links, sets).count() == 2


@pytest.mark.parametrize(
    "body, delay, closed",
    [
        ("User-agent: *\nCrawl-delay: 2.5\nDisallow: /", 2.5, True),
        ("User-agent: *\nCrawl-delay: soon\nCrawl-delay: 7\nDisallow: /x", 7.0, False),
        ("User-agent: o\nCrawl-delay: 9", None, False),
        ("User-agent: *\nDisallow: /\nAllow: /a", None, False),
    ],
)
def test_meta(spark, body, delay, closed):
    docs = spark.createDataFrame([("s", body)], "site string, body string")
    row = robots.robots_meta(docs, AGENT).first()
    assert (row.delay_s, row.allow_none) == (delay, closed)


def test_outcomes(spark):
    rule = "User-agent: *\nDisallow: /x\n"
    cases = [
        ("rules", 200, None, 0, False, rule, ("rules", 5.0, False)),
        ("slow", 200, None, 0, False, rule + "Crawl-delay: 21", ("rules", 21.0, True)),
        ("limit", 200, None, 0, False, rule + "Crawl-delay: 120", ("rules", 120.0, True)),
        ("too slow", 200, None, 0, False, rule + "Crawl-delay: 121", ("skip", None, False)),
        ("closed", 200, None, 0, False, "User-agent: *\nDisallow: /", ("skip", None, False)),
        ("unread", 200, None, 0, False, None, ("skip", None, False)),
        ("missing", 404, None, 0, False, rule, ("allow_all", 5.0, False)),
        ("error", 500, None, 0, False, None, ("allow_all", 5.0, False)),
        ("gone", 410, None, 0, False, None, ("skip", None, False)),
        ("moved", 301, "/r", 10, False, None, ("follow", None, False)),
        ("far", 301, "/r", 11, False, None, ("redirect_overflow", None, False)),
        ("loop", 302, "/r", 11, True, None, ("allow_all", 5.0, False)),
        ("nowhere", 301, None, 1, False, None, ("skip", None, False)),
    ]
    log = spark.createDataFrame(
        [c[:6] for c in cases], "site string, status int, location string, hops int, looped boolean, body string"
    )
    got = {r.site: (r.outcome, r.wait_s, r.reconnect) for r in robots.robots_outcome(log, AGENT).collect()}
    assert got == {c[0]: c[6] for c in cases}


def test_cross_domain(spark):
    log = spark.createDataFrame(
        [
            ("http://a.example.org/", "http://a.example.org/robots.txt", 301, "http://b.example.org/robots.txt", None),
            ("http://c.example.org/", "http://c.example.org/robots.txt", 301, "/r.txt", None),
            ("http://b.example.org/", "http://b.example.org/robots.txt", 200, None, "B"),
        ],
        "site string, uri string, status int, location string, body string",
    )
    assert [tuple(r) for r in robots.robots_cross_domain(log).collect()] == [
        ("http://a.example.org/", "http://b.example.org/robots.txt", "B")
    ]


def test_long_robots_file(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /p{i}/\n" for i in range(20_000))
    assert decide(spark, body, "/p19999/x") is False
    assert decide(spark, body, "/q") is True
