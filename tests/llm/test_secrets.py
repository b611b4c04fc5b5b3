"""Base spans against plain matching, and the learned automaton."""

import hashlib
import random
import re

from crawlframe.llm import secrets


def plain(text):
    """The contract read literally: every match of each pattern, failing ones dropped afterwards."""
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def key(rng, n=24):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def make(rng):
    parts = ["token=" + key(rng), key(rng), "/var/lib/" + "".join(rng.choice("abcdefghij") for _ in range(20)),
             "http://example.org/docs/" + "".join(rng.choice("abcdefghij") for _ in range(12)) + ".html",
             "configuration-management-handbook", "unbelievably_long_identifier_name", "PassWord = 'hunter2hunter2'", "token:abc", "api_key=" + "Zx9" * 5, "AKIA" + "Q7" * 8, "AKIA1234",
             "deadbeef" * 3, "deadbeef" * 3 + "0", "plain words here", "é", "\n", "secret=\"s3cr3t_value\"",
             "https://example.com/some/long/path.html", "aB3dE6gH9jK2mN5pQ8sT", "ghp" + "x9Y" * 8]
    return " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))


def test_base_spans_equal_plain_matching():
    rng = random.Random(5)
    for _ in range(500):
        text = make(rng)
        assert secrets.base_spans(text)[0] == plain(text)


def test_automaton_accepts_its_shapes():
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    creds = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(300)]
    automaton = secrets.fit_automaton([secrets.shape(c) for c in creds])
    assert len(automaton) < 40
    words = ["https://example.com/" + "".join(rng.choice("abcdefghij") for _ in range(20)) for _ in range(300)]
    background = secrets.background_counts([secrets.shape(x) for x in creds[:30] + words])
    good = [secrets.score(secrets.shape("".join(rng.choice(alphabet) for _ in range(32))), automaton, background) for _ in range(50)]
    bad = [secrets.score(secrets.shape(w), automaton, background) for w in words[:50]]
    assert min(good) > max(bad)
    assert secrets.score("ULD", secrets.fit_automaton([]), background) == float("-inf")


def test_documents(spark):
    rng = random.Random(9)
    texts = [None, "", "x" * 100000 + " token=abcdefgh"] + [make(rng) for _ in range(200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[5], "clash")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = secrets.find(docs).collect()
    assert len(got) == len(rows)
    names = secrets.KINDS
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else texts[5]
        spans = plain(text or "")
        base = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(1 for x in spans if x[1] == k) for k in range(3))
        listed = [x for x in r.spans.split(",") if x]
        assert [x for x in listed if not x.startswith("learned")] == [x for x in base.split(",") if x]
        assert len(listed) - len(spans) == r.n_learned
        keys = [(int(x.split(":")[1]), names.index(x.split(":")[0])) for x in listed]
        assert keys == sorted(keys)
    assert sum(r.n_learned for r in got) > 0


def test_empty_table(spark):
    assert secrets.find(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
