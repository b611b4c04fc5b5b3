"""Pages, addresses and robots bodies made to do harm."""

import html
import random
import re
import time

from pyspark.sql import functions as F

from crawlframe.functions import markup, urls
from crawlframe.operators import language, robots
from crawlframe.sinks.writers import write_uri_log
from crawlframe.sources.readers import read_uri_log


def test_anchors_of_any_size(spark):
    pages = ["<a " + "x " * 100_000 + 'href="/late">y</a><a href="/b">', "<a " * 300_000 + '<a href="/end">', '<article href="/no"><a class=x href=/c>',
             "<a title='>' href = '/d'><a name=e>f</a>"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    began = time.time()
    found = {r.i: list(r.h) for r in df.select("i", markup.href_values(F.col("html")).alias("h")).collect()}
    assert time.time() - began < 30
    assert found == {0: ["/late", "/b"], 1: ["/end"], 2: ["/c"], 3: ["/d"]}


def test_addresses_keep_to_their_line(spark, tmp_path):
    cases = {
        "http://h.example/a%0Ab%09c%0d%7F": "http://h.example/a%0Ab%09c%0d%7F",
        "http://h.example/%FFx": "http://h.example/%FFx",
        "http://h.example/%EF%BF%BD%C3%A9": "http://h.example/�é",
        "http://h.example/%E6%97%A5%0A": "http://h.example/日%0A",
    }
    df = spark.createDataFrame([(u, 200) for u in cases], "uri string, status int")
    assert {r.uri: r.h for r in df.select("uri", urls.human_url("uri").alias("h")).collect()} == cases


def test_robots_patterns_of_many_stars(spark):
    def plain(pattern, path):
        closed = pattern.endswith("$")
        body = ".*".join(re.escape(p) for p in re.split(r"\*+", pattern.removesuffix("$")))
        return re.match(body + (r"\Z" if closed else ""), path) is not None

    patterns = ["/*a*b", "/a*", "/*$", "/a$", "/*.pdf$", "/a*b*c$", "/ab*ba$", "*", "*b", "/x**y", "/*a*a$"]
    paths = ["/", "/a", "/ab", "/aba", "/abba", "/xaby", "/a.pdf", "/a.pdf?x", "/abc", "/acbc", "/aa", "/xy", "/b", "/abcabc"]
    for pattern in patterns:
        docs = spark.createDataFrame([("s/", 200, f"User-agent: *\nDisallow: {pattern}\n")], "site string, status int, body string")
        sets = robots.rule_sets(docs, "bot")
        links = spark.createDataFrame([("s/", "http://s" + p) for p in paths], "site string, uri string")
        got = {r.uri: r.allowed for r in robots.robots_decisions(links, sets).collect()}
        assert got == {"http://s" + p: not plain(pattern, p) for p in paths}, pattern
    hostile = spark.createDataFrame([("s/", 200, "User-agent: *\nDisallow: /" + "*a" * 30 + "b\n")], "site string, status int, body string")
    link = spark.createDataFrame([("s/", "http://s/" + "a" * 5000)], "site string, uri string")
    began = time.time()
    assert robots.robots_decisions(link, robots.rule_sets(hostile, "bot")).first().allowed
    assert time.time() - began < 10


def test_both_ways_of_scoring_agree(spark):
    train = spark.createDataFrame([("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chat et le chien", "fr")], "text string, lang string")
    profiles = language.train_lang_profiles(train)
    docs = spark.createDataFrame([(1, "der Hund"), (1, "the dog"), (None, "le chat"), (2, None), (2, "")], "doc_id bigint, text string")
    one, two = (
        sorted(map(repr, language.detect_language(docs, profiles, ("de", "en", "fr"), broadcast_rows=n).collect())) for n in (10**6, 0)
    )
    assert one == two


def test_references_are_undone_once(spark):
    texts = ["&#47;a&#38;b=1", "/q?a=1&#x26;b=2", "&eacute;&nbsp;&amp;lt;", "&#38;lt;", "&#0;&#xD800;&#x110000;&#99999999999;",
             "&#150;&#x1F600;&#1;", "a & b &", "&nosuch; &#; &#x;", "&amp;#39;", "plain", "&" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(markup.unescape_basic(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_dot_segments_of_any_number(spark):
    def plain(path):
        kept = []
        path = path + "/" if re.search(r"/\.\.?$", path) else path
        for s in path.split("/")[1:]:
            if s == "..":
                kept[-1:] = []
            elif s != ".":
                kept.append(s)
        return "/" + "/".join(kept)

    rnd = random.Random(4)
    paths = ["/" + "/".join(rnd.choice(["a", "b", "..", ".", "", "...", ".x", "é"]) for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    paths += ["/a" * 20_000 + "/.." * 20_000, "/a/.." * 20_000 + "/end", "/." * 20_000]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    began = time.time()
    got = {r.p: r.d for r in df.select("p", urls.remove_dot_segments(F.col("p")).alias("d")).collect()}
    assert time.time() - began < 20
    assert got == {p: plain(p) for p in paths}
