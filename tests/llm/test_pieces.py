"""Ids, spans and texts against the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from crawlframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return pieces.loaded(pieces.model_bytes(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "   ", "a", " a  b ", "▁", "a▁b ▁ c", "<s> </s> <unk> <0x41>", "\x00\x01\n\t\r\n", "日本語のテキスト", "🙂🙂 🙂",
       "é é ﬁ Ⅳ ½", " " * 50 + "x" + " " * 33, "   x", "aaaa" * 300, "�​", "ＡＢＣ　ＤＥ", "the" * 5000]


def test_equals_library(pair):
    own, library = pair
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab ct the éß日🙂▁\n  in") for _ in range(rnd.randrange(90))) for _ in range(1500)]
    for t in texts:
        ids, offsets = own.encode(t)
        assert ids.tolist() == library.encode(t, num_threads=1), t
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        assert len(offsets) == len(ids) + 1 and offsets[0] == 0 and offsets[-1] == (len(t.encode()) if len(ids) else 0)
        assert (offsets[1:] >= offsets[:-1]).all()


def test_units_merge_side_by_side(pair, monkeypatch):
    """F3 (op9): what 4000 new units cost in rounds is what the longest of them costs, not one merge after another."""
    _, library = pair
    own = pieces.Model(pieces.model_bytes(PATH))
    rnd = random.Random(5)
    syllables = ["tion", "the", "ver", "ß", "é", "日", "🙂", "\n", "in", "a", "."]
    texts = [" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 9))) + str(rnd.randrange(10**6)) for _ in range(200)) for _ in range(20)]
    calls, joined = [], own.pairs.joined
    monkeypatch.setattr(own.pairs, "joined", lambda a, b: calls.append(a.size) or joined(a, b))
    assert [ids.tolist() for ids, _ in own.encode_all(texts)] == [library.encode(t) for t in texts]
    assert len(calls) < 100


def test_units_in_small_groups(pair, monkeypatch):
    """Results do not depend on how texts and units are grouped, which units are kept, or which are long."""
    _, library = pair
    for name, value in (("KEPT", 7), ("TOGETHER", 3), ("AT_ONCE", 40), ("HEAP_FROM", 12)):
        monkeypatch.setattr(pieces, name, value)
    own = pieces.Model(pieces.model_bytes(PATH))
    rnd = random.Random(6)
    texts = ODD + [" ".join("".join(rnd.choice("abetinr日🙂\n") for _ in range(rnd.randrange(20))) for _ in range(rnd.randrange(30))) for _ in range(60)]
    for t, (ids, at) in zip(texts, own.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(t), t
        assert len(at) == len(ids) + 1 and at[-1] == (len(t.encode()) if len(ids) else 0) and (at[1:] >= at[:-1]).all()
    assert list(own.encode_all([])) == []


def test_spans_name_the_source(pair):
    own, _ = pair
    text = "Ein Maß für 日本 🙂 und▁mehr"
    body = text.encode()
    ids, at = own.encode(text)
    for i, piece in enumerate(ids.tolist()):
        if own.kinds[piece] == 1:
            assert own.pieces[piece].replace(pieces.META, " ").strip() == body[at[i] : at[i + 1]].decode().replace(pieces.META, " ").strip()
    assert b"".join(body[a:b] for a, b in zip(at, at[1:])) == body


def test_arbitrary_ids_decode_as_in_library(pair):
    own, library = pair
    rnd = random.Random(2)
    for _ in range(800):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(3, 32000), 259, 260, 1, 2]) for _ in range(rnd.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_character_map(pair):
    """A hand-made trie: "a" to "X", "ab" to "" and "é" to "e!"."""
    units = [0] * 1024
    entries, texts = {b"a": b"X", b"ab": b"", "é".encode(): b"e!"}, b""
    values = {}
    for k, v in entries.items():
        values[k] = len(texts)
        texts += v + b"\0"
    prefixes = {b""} | {k[:i] for k in entries for i in range(1, len(k) + 1)}
    base = {p: 256 * n for n, p in enumerate(sorted(prefixes), 1)}
    units += [0] * (256 * (len(prefixes) + 2))
    place = {b"": 0}
    for p in sorted(prefixes, key=len):
        node = place[p]
        offset = base[p] ^ node
        units[node] |= (offset << 10) | (256 if p in values else 0) | (p[-1] if p else 0)
        if p in values:
            units[base[p]] = 0x80000000 | values[p]
        for q in prefixes:
            if len(q) == len(p) + 1 and q.startswith(p):
                place[q] = base[p] ^ q[-1]
    import struct

    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts
    own = pieces.Model(pieces.model_bytes(PATH))
    own.map = pieces.CharMap(blob)
    normal, places = own.normalise("caabé")
    assert normal == "▁cXe!" and places.tolist() == [0, 0, 1, 4, 4, 6]
    own.squeeze = True
    normal, places = own.normalise("  c  é ")
    assert normal == "▁c▁e!" and places.tolist() == [2, 2, 3, 5, 5, 7]


def test_rows(spark, pair):
    _, library = pair
    rows = [(1, None), (2, ""), (3, "Ein Satz."), (3, "Ein Satz."), (None, "x y " * 100000), (4, "z" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS piece", "2 AS kinds")
    out = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    for (i, t), r in zip(rows, out, strict=True):
        assert r.doc_id == i and r.ids == library.encode(t or "") and r.decoded == (t or "")
    assert pieces.decode(pieces.encode(docs.where("false"), PATH), PATH).count() == 0


def test_query_equals_library(spark, sf_dir, pair):
    from crawlframe.llm.queries import QUERIES

    _, library = pair
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", num_threads=1)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {tuple(r) for r in QUERIES["op9_sentencepiece"](spark, sf_dir).select(columns).collect()}
    assert got == want
