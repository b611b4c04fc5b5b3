"""Fingerprints and components against plain Python."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from crawlframe.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    votes = [0] * 64
    for h in hashes:
        for i, bit in enumerate(reversed(f"{h:064b}")):
            votes[i] += bit == "1"
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(hashes))


def plain_components(fps):
    ids, group = list(fps), {i: i for i in fps}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("short", [64, 4])
def test_components_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    values = set(centres) | {0, (1 << 64) - 1, 1 << 63}
    for c in centres[:12]:  # chains and clouds about a centre
        for _ in range(30):
            c ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            values.add(c)
    for _ in range(150):
        values.add(centres[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = {signed(v): v for v in values}
    got = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in fps], "fp bigint")))
    found = {r.node: r.root for r in got.collect()}
    assert {v: found.get(v, v) for v in fps} == plain_components(dict(sorted(fps.items())))


def test_documents(spark):
    text = "The quick  brown\tfox jumps OVER the lazy dog É É again and again"
    rows = [(3, text), (1, text.lower()), (7, None), (5, ""), (9, " \n"), (2, "one"), (4, "one two"), (None, "one"),
            (6, "\x1c a\x85b  c"), (8, "x y z " * 30000), (8, "x y z " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for doc_id, t in rows:
        by.setdefault(doc_id, set()).add(signed(plain_fingerprint(t)))
    for r in out:
        assert {r.fp} == by[r.doc_id]
    comp = {r.doc_id: r.component_id for r in out}
    assert comp[7] == comp[5] == comp[9] == 5 and comp[2] == comp[None] == 2
    kept = sorted(r.doc_id for r in simhash.representatives(docs).collect())
    assert kept == sorted({c for c in comp.values()})
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    from crawlframe.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in sorted(texts.items())}
    groups = plain_components(fps)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {(i, f"{fps[i]:016x}", groups[i]) for i in fps}


def test_representatives_without_ids(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 9) for _ in range(60)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:9]] + [(1, texts[9]), (None, texts[9]), (2, texts[10]), (2, texts[11]), (0, texts[11])]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string")
    kept = sorted((r.text, r.doc_id) for r in simhash.representatives(docs).collect() if r)
    want = [(t, None) for t in texts[:6]] + [(t, 7) for t in texts[6:9]] + [(texts[9], 1), (texts[10], 2), (texts[11], 0)]
    assert kept == sorted(want)


def test_representatives_keep_clashing_columns(spark):
    from crawlframe.llm import simhash as sh

    text = "the same words again and again in every copy of this text"
    docs = spark.createDataFrame(
        [(1, text, 10, 100, "a"), (2, text, 20, 200, "b"), (3, "something else entirely here", 30, 300, "c")],
        "doc_id bigint, text string, _kept bigint, _text_hash bigint, _row string",
    )
    got = sorted(tuple(r) for r in sh.representatives(docs).collect())
    assert got == [(1, text, 10, 100, "a"), (3, "something else entirely here", 30, 300, "c")]
