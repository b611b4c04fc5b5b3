"""Measures and verdicts against plain Python."""

import random
import re

import duckdb
import pytest

from crawlframe.llm import quality

SPLIT = re.compile("[\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = [w for w in SPLIT.split(text) if w]
    lines = [x for x in text.split("\n") if SPLIT.sub("", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat)


def verdict(n, chars, symbols, dup, repeat):
    base = n < 50 or 100 * repeat > 50 * n
    return base, not (base or 10 * symbols > n or chars < 2 * n or chars > 15 * n or (dup > 3 and 10 * dup > n))


def cases():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "\x0b\x0cé\x85\xa0日 𝒳\x1c\x00", "w " * 60000,
             " ".join(str(i) for i in range(70)), "#" * 30 + " y" * 80, "l\n" * 100]
    return texts + ["".join(rnd.choice(["a ", "b ", "ab", "é", "\n", "$", "c c ", "word "]) for _ in range(rnd.randrange(400))) for _ in range(120)]


def test_measures_and_verdicts(spark):
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "one"), (None, None)], "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS base_failed")
    out = quality.report(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = None if r.doc_id is None else texts[r.doc_id]
        want = plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (text or "")[:80]
        assert (r.base_failed, r.kept) == verdict(*want)
    assert quality.report(docs.where("false")).count() == 0
    kept = {r.doc_id for r in quality.cascade(docs).collect()}
    assert kept == {r.doc_id for r in out if r.kept}


def test_order_by_rejections_per_cost(spark):
    rule = lambda name: quality.Rule(name, lambda m: m("n_words") < 0)
    worth = [quality.Estimate(rule(n), s, r).worth for n, s, r in (("a", 1.0, 0.1), ("b", 0.1, 0.05), ("c", 2.0, 0.9))]
    assert worth[2] < worth[1] and worth[0] < worth[2]
    docs = spark.createDataFrame([("a " * n,) for n in range(100)], "text string")
    found = quality.estimates(docs, quality.BASE + quality.FURTHER)
    assert [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    assert {e.rule.name: e.rejected for e in found}["few_words"] == 0.5


def test_plan_is_native(spark, sf_dir):
    from crawlframe.llm.queries import QUERIES

    for name in ("op4_quality_rules", "op10_sharding"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_query_equals_sql(spark):
    from crawlframe.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(ORACLES["op4_quality_rules"])
    names, want = [d[0] for d in found.description], found.fetchall()
    got = QUERIES["op4_quality_rules"](spark, sf).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    long = [r for r in got if not r.base_failed and labels.get(r.doc_id) == 1]
    assert sum(not r.kept for r in long) <= 0.01 * len(long)
