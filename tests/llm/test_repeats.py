"""Removed bytes against a set of all windows."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import repeats


def plain(texts, length=400):
    """For each text the spans of bytes covered by a window that occurs twice."""
    seen, twice = set(), set()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            (twice if w in seen else seen).add(w)
    out = []
    for b in bodies:
        spans = []
        for i in range(len(b) - length + 1):
            if b[i : i + length] in twice:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("removed_", F.lit(1)).withColumn("_k", F.lit(2))
    got = repeats.remove_repeats(docs)
    assert got.columns == [*docs.columns, "removed", "kept"]
    found = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "", [tuple(s) for s in r.removed]) for r in got.collect()), key=repr)
    spans = plain([t for _, t in rows])
    want = sorted(((i if i is not None else -1, t or "", s) for (i, t), s in zip(rows, spans, strict=True)), key=repr)
    assert found == want
    for r in got.collect():
        ends = [0, *[s.end for s in r.removed]]
        body = (r.text or "").encode()
        assert bytes(r.kept) == b"".join(body[a:b] for a, b in zip(ends, [*[s.start for s in r.removed], len(body)], strict=True))


def words(rnd, n):
    return " ".join(rnd.choice(["über", "the", "of", "naïve", "ra", "tion", "an", "x" * rnd.randrange(1, 9)]) for _ in range(n))


@pytest.mark.parametrize("wide", [20_000, 2])
def test_against_all_windows(spark, monkeypatch, wide):
    monkeypatch.setattr(repeats, "WIDE_GROUP", wide)
    rnd = random.Random(3)
    shared = [words(rnd, n) for n in (60, 120, 400)]
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "b" * 400), (5, "b" * 400), (6, "ab" * 700), (7, "c" * 401), (8, "c" * 3000)]
    for i in range(60):
        parts = [words(rnd, rnd.randrange(0, 200)) for _ in range(3)]
        for s in rnd.sample(shared, 2):
            cut = rnd.randrange(0, 40)
            parts.insert(1, s[cut:])
        rows.append((10 + i, "\n".join(parts)))
    base = words(rnd, 900).split()
    for i in range(20):
        edited = list(base)
        for _ in range(4):
            edited[rnd.randrange(len(edited))] = "edit%d" % rnd.randrange(9999)
        rows.append((100 + i, " ".join(edited)))
    rows += [(200, " ".join(base)), (200, " ".join(base)), (201, " ".join(base)), (None, words(rnd, 300)), (200, words(rnd, 500))]
    check(spark, rows)


def test_very_long_text_and_empty_table(spark):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(500))
    long = "".join(rnd.choice("abcdefgh") for _ in range(repeats.STRETCH - 300))
    docs = spark.createDataFrame([(1, long + passage + long[:100]), (2, "x" + passage)], "doc_id bigint, text string")
    spans = {r.doc_id: [tuple(s) for s in r.removed] for r in repeats.remove_repeats(docs).collect()}
    assert spans == {1: [(len(long), len(long) + 500)], 2: [(1, 501)]}
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def plain_passages(texts, words):
    """For each text the places of bytes in passages of so many words that occur twice."""
    bodies = [(t or "").encode() for t in texts]
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in bodies]
    found = [[(w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)] for w in places]
    times = Counter(b[x:y] for b, f in zip(bodies, found, strict=True) for x, y in f)
    return [{i for x, y in f if times[b[x:y]] > 1 for i in range(x, y)} for b, f in zip(bodies, found, strict=True)]


@pytest.mark.parametrize("wide", [20_000, 2])
def test_passages_against_all_windows(spark, monkeypatch, wide):
    """F2 (op5): passages of over 50 words that stand in two texts go, though shorter than 400 bytes; 50 words stay."""
    monkeypatch.setattr(repeats, "WIDE_GROUP", wide)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6)))
    text = lambda n: "".join(word() + rnd.choice([" ", " ", "\n", "\t "]) for _ in range(n))
    shared = [text(n) for n in (51, 55, 60, 100, 300)]
    fifty = text(50)
    rows = [(1, None), (2, ""), (3, "a b " * 100), (4, text(50)), (5, "x " * 50), (6, "x " * 51), (7, "  " + "y " * 51), (8, "y " * 51 + "z" * 900)]
    rows += [(10 + i, text(rnd.randrange(90)) + rnd.choice(shared) + text(rnd.randrange(90)) + rnd.choice(shared)[rnd.randrange(9) :]) for i in range(40)]
    rows += [(60, "p " + fifty + "q"), (61, "r " + fifty + "s"), (62, shared[0]), (62, shared[0]), (None, rows[12][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted, spans = plain_passages([t for _, t in rows], 51), plain([t for _, t in rows])
    want = []
    for (i, t), gone, some in zip(rows, wanted, spans, strict=True):
        gone = gone.union(*[range(a, b) for a, b in some])
        left = bytes(c for k, c in enumerate((t or "").encode()) if k not in gone)
        want.append((i or -1, t or "", some, len(gone), left))
    got = repeats.remove_repeats(docs, passage_words=51)
    assert got.columns == ["doc_id", "text", "removed", "kept", "passages", "passage_free"]
    found = [(r.doc_id or -1, r.text or "", [tuple(s) for s in r.removed], sum(s.end - s.start for s in r.passages), bytes(r.passage_free)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    short = {i: left for i, _, some, n, left in want if n and not some}
    assert short and 60 not in short


def test_query_names_passages(spark, sf_dir):
    from crawlframe.llm.queries import QUERIES

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    spans = plain(rows.values())
    want = {}
    for (i, t), gone, some in zip(rows.items(), plain_passages(rows.values(), 51), spans, strict=True):
        gone = gone.union(*[range(a, b) for a, b in some])
        want[i] = bytes(c for k, c in enumerate(t.encode()) if k not in gone).decode("utf-8", "replace")
    got = {r.doc_id: r.passage_free_text for r in QUERIES["op5_suffix_array_dedup"](spark, sf_dir).collect()}
    assert {i: t.replace("\ufffd", "") for i, t in got.items()} == {i: t.replace("\ufffd", "") for i, t in want.items()}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f.rsplit("/", 1)[-1] for f in files.split("\n") if "/shuffle_" in f}


def test_shuffles_do_not_pile_up(spark, tmp_path, monkeypatch):
    """F2 (op5, disk 4.16 x input): texts and anchors are not shuffled by one query, and a work table's shuffles go once it is written."""
    read, left = {}, {}

    def stored(df, name, *args, **kwargs):
        read[name] = {f.split("/")[-2].split("-")[0] for f in df.inputFiles()}
        before = shuffle_files(spark)
        out = write(df, name, *args, **kwargs)
        end = time.time() + 10
        while (left_now := shuffle_files(spark) - before) and time.time() < end:  # they are deleted in the background
            time.sleep(0.1)
        left[name] = left_now
        return out

    write = repeats.stored
    monkeypatch.setattr(repeats, "stored", stored)
    rnd = random.Random(5)
    shared = words(rnd, 200)
    rows = [(i, f"{words(rnd, 150)} {shared[i:]} {words(rnd, 150)}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents"))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    got = repeats.remove_repeats(spark.read.parquet(str(tmp_path / "documents")), passage_words=51)
    assert spark.conf.get(setting) == before
    for _ in range(2):
        assert {r.doc_id: [tuple(s) for s in r.removed] for r in got.collect()} == dict(zip(range(20), plain([t for _, t in rows]), strict=True))
    assert [name for name, tables in read.items() if "documents" in tables] == ["anchors", "runs"]
    assert not [name for name, tables in read.items() if {"documents", "anchors"} <= tables]
    assert not any(left.values())


def test_query_equals_brute_force(spark, sf_dir):
    from crawlframe.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = set()
    for (i, text), spans in zip(rows, plain([t for _, t in rows]), strict=True):
        body = (text or "").encode()
        ends = [0, *[b for _, b in spans]]
        kept = b"".join(body[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(body)], strict=True))
        want.add((i, len(body), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = {tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, sf_dir).select(columns).collect()}
    assert got == want
