"""The conversation trie against a direct count of all prefixes."""

import hashlib
import random
import zlib

import pytest

from crawlframe.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, base=100, shifts=6):
    """The contract, prefix by prefix."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in by.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % shifts
        b = c - (abs(c) % base) * (1 if c >= 0 else -1)
        convs[c] = own.get(b, [])[:h] + v[h:]
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    name = {key: min(v) for key, v in nodes.items()}
    out = {}
    for key, members in nodes.items():
        sub = [k for k in nodes if k[: len(key)] == key]
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out[(name[key], len(key))] = (
            name[key[:-1]] if key else None, len(members), len(kids.get(key, [])),
            sum(1 for k in sub if not kids.get(k)),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in sub if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def result(spark, rows, **kw):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


def test_small_forest(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "bye"),
            (1, 0, "user", "hi"), (1, 1, "assistant", "yo"),
            (3, 5, "user", "x"), (3, None, "system", None), (None, 0, "user", "lost"),
            (7, 0, "user", "hi"), (7, 0, "user", "hi"), (250, 1, None, "b"), (201, 0, "user", "c")]
    assert result(spark, rows) == brute(rows)


def test_random_conversations_with_copies(spark):
    rng = random.Random(7)
    words = ["a", "b", "é", "", "long " * 50]
    rows = []
    for c in list(range(0, 140)) + [1000, 1001, 1099, 1100]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words + [None])))
    for c in range(300, 340):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("shifts", [1, 3])
def test_long_chains_and_other_shifts(spark, shifts):
    rows = [(c, t, "user", str(t % (c + 1))) for c in range(5) for t in range(40 + c)]
    assert result(spark, rows, shifts=shifts) == brute(rows, shifts=shifts)


def test_empty_table_and_clashing_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(0, 0, "u", "t", 1, 2)], SCHEMA + ", c bigint, name bigint")
    assert [(r.conv_id, r.depth, r.n_convs) for r in prefix_trie.trie(rows).orderBy("depth").collect()] == [(0, 0, 1), (0, 1, 1)]
