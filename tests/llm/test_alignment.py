"""Interval coalescing and corpus counts against direct definitions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tools(ranks=None):
    return alignment.loaded(open(A, encoding="utf-8").read(), open(B, "rb").read(), ranks and open(ranks, "rb").read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.data())
def test_groups_and_links_by_definition(a_sizes, data):
    total = sum(a_sizes)
    cuts = sorted(data.draw(st.sets(st.integers(1, total - 1), max_size=total - 1)) if total > 1 else set())
    b_sizes = np.diff([0, *cuts, total])
    a_sizes = np.array(a_sizes)
    a_group, b_group = alignment.coalesce(a_sizes, b_sizes)
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    common = sorted(set(a_end.tolist()) & set(b_end.tolist()))
    assert a_group.tolist() == [common.index(min(c for c in common if c >= e)) for e in a_end]
    assert b_group.tolist() == [common.index(min(c for c in common if c >= e)) for e in b_end]
    spans = lambda ends: list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()))
    overlap = sorted((i, j) for i, (s, e) in enumerate(spans(a_end)) for j, (t, f) in enumerate(spans(b_end)) if s < f and t < e)
    i, j = alignment.links(a_sizes, b_sizes)
    assert list(zip(i.tolist(), j.tolist())) == overlap


def brute(texts):
    t = tools()
    a, b, a_bytes, b_bytes = t.a, t.b, t.a_bytes, t.b_bytes
    per = []
    for t in texts:
        if not t:
            per.append(None)
            continue
        ai = a.encode(" " + t, add_special_tokens=False).ids
        bi = b.encode(t)
        body = (" " + t).encode()
        if b"".join(a_bytes[x] for x in ai) != body or b"".join(b_bytes[x] for x in bi) != body:
            per.append(None)
            continue
        ra, rb, at = [], [], 0
        for x in ai:
            ra.append((at, at + len(a_bytes[x]), x))
            at += len(a_bytes[x])
        at = 0
        for x in bi:
            rb.append((at, at + len(b_bytes[x]), x))
            at += len(b_bytes[x])
        links = [(p[2], q[2]) for p in ra for q in rb if p[0] < q[1] and q[0] < p[1]]
        ends = {p[1] for p in ra} & {q[1] for q in rb}
        groups, ga, gb = [], [], []
        for pos in range(len(body) + 1):
            ga += [str(p[2]) for p in ra if p[1] == pos]
            gb += [str(q[2]) for q in rb if q[1] == pos]
            if pos in ends:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        per.append((len(ai), len(bi), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    docs = {}
    for k, p in enumerate(per):
        for pair in set(p[3]) if p else ():
            docs[pair] = docs.get(pair, 0) + 1
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((p[0], p[1], p[2], len(p[3]), sum(docs[q] == best[q[0]] for q in p[3]), sum(docs[q] for q in p[3]), p[4]))
    return out


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "cat", "Straße", "東京", "<|endoftext|>", "  ", "\n", "é", "🙂", "don't", "x" * 40, "\t"]
    texts = [None, "", " ", "a", "<unk>"] + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[5:15]  # repeated rows
    rows = [(i if i % 17 else None, t, "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string")
    got = alignment.align(docs, A, B).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, alignment.align(docs, A, B, a_ranks_path=RANKS).collect()))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
    want = {}
    for (i, _, _), w in zip(rows, brute(texts), strict=True):
        want.setdefault(i, []).append(w)
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(w[0] for w in brute(texts))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B).collect() == []


@pytest.mark.parametrize("n", [1, 20000])
def test_long_text(spark, n):
    text = "word " * n + "end"
    got = alignment.align(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), A, B).first()
    assert got.n_a > n and got.n_groups > 0 and got.n_links == got.n_a + got.n_b - got.n_groups


def test_ranks_give_the_json_ids():
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t]
    texts += ["<|endoftext|> x", "a\n\n b", "   ", "don't", "🙂é東京", "\t\x0b\r\n", "x" * 5000]
    slow, fast = tools(), tools(RANKS)
    wanted = [e.ids for e in slow.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert fast.a_ids([" " + t for t in texts]) == wanted
