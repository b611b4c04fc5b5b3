from pyspark.sql import functions as F

from crawlframe.functions import urls
from crawlframe.operators import fetchlog, frontier, pages

BASE = "http://Site.example.org/a/b/page.html?x=1#top"

# href -> (url, reason)
LINK_CASES = {
    "": ("http://site.example.org/a/b/page.html?x=1", None),
    "?q=2": ("http://site.example.org/a/b/page.html?q=2", None),
    "#f": ("http://site.example.org/a/b/page.html?x=1", None),
    "//h.example.com/p": ("http://h.example.com/p", None),
    "/k": ("http://site.example.org/k", None),
    "../c": ("http://site.example.org/a/c", None),
    "../../../c": ("http://site.example.org/c", None),
    "x": ("http://site.example.org/a/b/x", None),
    "./x/../y/.": ("http://site.example.org/a/b/y/", None),
    "  /lead": ("http://site.example.org/lead", None),
    "/a\nb": ("http://site.example.org/ab", None),
    "JavaScript:void(0)": (None, "scheme"),
    "mailto:a@example.org": (None, "scheme"),
    " javascript:x": (None, "no_host"),
    "tel:123": (None, "no_host"),
    "http://": (None, "no_host"),
    "ftp://f.example.org/d.zip/": ("ftp://f.example.org/d.zip/", None),
    "http://p.example.org:80/k": ("http://p.example.org/k", None),
    "https://p.example.org:443": ("https://p.example.org/", None),
    "http://p.example.org:443/k": ("http://p.example.org:443/k", None),
    "http://p.example.org:8080/k": ("http://p.example.org:8080/k", None),
    "http://p.example.org:99999/": (None, "bad_port"),
    "http://p.example.org:x/": (None, "bad_port"),
    "http://a b/": (None, "bad_host"),
    "http://u:pw@p.example.org/k": ("http://u:pw@p.example.org/k", None),
    "http://p$1.example.org/k": ("http://p$1.example.org/k", None),
    "/pic.JPG": ("http://site.example.org/pic.JPG", None),
    "/pic.jpg": (None, "suffix"),
    "/pic.jpg?x": (None, "suffix"),
    "/pic.jpg/": ("http://site.example.org/pic.jpg/", None),
    "/日本?q=あ b": ("http://site.example.org/%E6%97%A5%E6%9C%AC?q=%E3%81%82%20b", None),
    "\\back\\slash?a\\b": ("http://site.example.org/back/slash?a\\b", None),
    "HTTP://UP.example.org/Path": ("http://up.example.org/Path", None),
}


def test_link_cases(spark):
    rows = spark.createDataFrame([(BASE, href) for href in LINK_CASES], "base string, href string")
    got = {r.raw_href: (r.dst_url, r.reject_reason) for r in pages.resolve_links(rows).collect()}
    assert got == LINK_CASES


def test_empty_suffix_list_keeps_all(spark):
    rows = spark.createDataFrame([(BASE, "/pic.jpg")], "base string, href string")
    assert pages.resolve_links(rows, suffixes=()).first().reject_reason is None


def test_site_key(spark):
    cases = {
        "http://u@Host.example.org:80/x?y#z": "http://host.example.org/",
        "https://host.example.org:8443?q": "https://host.example.org:8443/",
        "https://host.example.org": "https://host.example.org/",
        "mailto:a@b": None,
        "nothing": None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.k for r in rows.select("u", urls.site_key("u").alias("k")).collect()} == cases


def test_human_url_and_hosts(spark):
    cases = {
        "http://h.example.org/%E6%97%A5+x?q=%2B%C3%A9": "http://h.example.org/日+x?q=+é",
        "http://h.example.org/bad%zz": "http://h.example.org/bad%zz",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.h for r in rows.select("u", urls.human_url("u").alias("h")).collect()} == cases
    hosts = spark.createDataFrame([("http://xn--wgv71a.example.org/xn--x",), (None,)], "u string")
    assert [r[0] for r in hosts.select(urls.unicode_host("u")).collect()] == ["http://日本.example.org/xn--x", None]
    names = spark.createDataFrame([("日本.example.org",), ("a" * 70,)], "h string")
    assert [r[0] for r in names.select(urls.ascii_host("h")).collect()] == ["xn--wgv71a.example.org", None]


def test_redirect_cases(spark):
    rows = spark.createDataFrame(
        [
            ("http://a.example.org/x/y", "z"),
            ("http://a.example.org/x", "https://a.example.org/q#f"),
            ("http://a.example.org/x", "http://b.example.org/"),
            ("http://a.example.org/x", "http://u@a.example.org/"),
            ("http://a.example.org/x", "data:x"),
            ("http://A.example.org:80/x", "/y"),
            ("http://a.example.org/x", "http://a.example.org:443/"),
        ],
        "base string, location string",
    )
    got = [(r.target, r.queue) for r in fetchlog.redirect_target(rows).collect()]
    assert got == [
        ("http://a.example.org/x/z", "site"),
        ("https://a.example.org/q", "site"),
        ("http://b.example.org/", "frontier"),
        ("http://u@a.example.org/", "frontier"),
        (None, None),
        ("http://a.example.org/y", "site"),
        ("http://a.example.org:443/", "frontier"),
    ]


def test_status_route(spark):
    rows = spark.createDataFrame([(200, None), (301, "/x"), (302, None), (404, "/x")], "status int, location string")
    got = [r[0] for r in rows.select(fetchlog.status_route(F.col("status"), F.col("location"))).collect()]
    assert got == ["document", "redirect", "drop", "drop"]


def test_seeds_to_frontier(spark):
    seeds = spark.createDataFrame([("http://A.example.org:80",), (" http://a.example.org/ ",), ("no url",)], "value string")
    assert [tuple(r) for r in frontier.seeds_to_frontier(seeds).collect()] == [
        ("http://a.example.org/", "http://a.example.org/")
    ]
