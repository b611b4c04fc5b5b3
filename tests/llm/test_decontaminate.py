"""Retrieved items against scores of all pairs; leaks against plain search."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlframe.llm import decontaminate as d


def plain_weights(texts):
    words = [d.words_of(t) for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        raw = {}
        for w, tf in Counter(ws).items():
            idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
            raw[w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        out.append({w: x / sum(raw.values()) for w, x in raw.items()})
    return out


def random_text(rnd, n):
    words = ["the", "of", "in", "die", "und"] + ["w%d" % i for i in range(40)]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", "?"]) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.25, 0.5])
def test_retrieves_all_items_above_threshold(spark, threshold):
    rnd = random.Random(2)
    texts = [random_text(rnd, rnd.randrange(3, 25)) for _ in range(70)]
    rows, span = d.index(spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string"))
    shard = d.Shard.of(rows.orderBy("id").collect(), span)
    weights = plain_weights(texts)
    assert span == max(len(d.words_of(t)) for t in texts)
    for _ in range(30):
        words = d.words_of(random_text(rnd, rnd.randrange(1, 200)))
        want = set()
        for k in range(0, len(words), span):
            have = set(words[k : k + 2 * span])
            for i, w in enumerate(weights):
                score = sum(x for t, x in w.items() if t in have)
                if score >= threshold:
                    want.add((k, i, round(score, 3)))
        terms = np.array([shard.numbers.get(w, -1) for w in words], np.int64)
        got = {(k, i, round(s, 3)) for k, i, s in shard.candidates(terms, threshold)}
        assert {x[:2] for x in got} == {x[:2] for x in want}
        assert max((abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want), strict=True)), default=0) < 0.002


def test_many_shards_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_WORDS", 20)
    items = [(1, "What is the name of this river? It is the Danube of course."), (2, None), (3, ""), (4, "Which one? Seven wise masters sat there."),
             (5, "one word sentence without an end mark here"), (6, "What is the name of this river? It is the Danube of course.")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("shard", F.lit("clash"))
    long = "filler words go on " * 40000
    docs = [(1, None), (2, ""), (3, "He asked: what is THE name of this river? it is the danube, of course! And so on."), (4, "What is the name of this river? It is another."),
            (5, long + items[3][1] + long), (5, long + items[3][1] + long), (6, items[4][1]), (7, "seven wise masters"), (None, "x " + items[4][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(0))
    got = sorted(((r.doc_id or -1, r.item_id) for r in d.leaks(table, bench).collect()))
    assert got == sorted([(3, 1), (3, 6), (5, 4), (5, 4), (6, 5), (-1, 5)])
    kept = d.clean(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7]
    assert d.leaks(table, bench.where("false")).count() == 0 and d.leaks(table.where("false"), bench).count() == 0


def test_query_equals_search(spark):
    from crawlframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    items = {r.item_id: d.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        body = " " + " ".join(d.words_of(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in body}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_decontamination"](spark, sf).collect()}
    assert got == want and want


def test_clean_without_ids(spark):
    item = "which river flows through the old town of the seven bridges? the long green river"
    rows = [(None, f"so {item} it was"), (None, "a clean text"), (None, None), (4, f"and {item}"), (4, "another clean text"), (5, "a third")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = sorted(d.clean(docs, items).collect(), key=str)
    assert {tuple(r) for r in kept} == {rows[1], rows[2], rows[4], rows[5]} and len(kept) == 4
