"""The pipeline against its stages done plainly."""

import random

import sentencepiece
from test_repeats import plain, plain_passages
from test_simhash import plain_components, plain_fingerprint

import __spark_entry__
import corpus_pipeline
from crawlframe.llm import decontaminate as d
from crawlframe.llm import langid
from crawlframe.llm.queries import PIECES


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs.where(~langid.held_out()))
    kept = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    rows = {i: t for i, t in sorted(rows.items()) if i in kept}
    groups = plain_components({i: plain_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    for (i, text), spans in zip(list(rows.items()), plain(rows.values()), strict=True):
        body = text.encode()
        ends = [0, *[b for _, b in spans]]
        left = b"".join(body[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(body)], strict=True))
        rows[i] = left.decode("utf-8", "ignore")
        if not rows[i].strip(" "):
            del rows[i]
    items = [" ".join(d.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(f" {w} " in f" {' '.join(d.words_of(t))} " for w in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {i: library.encode(t) for i, t in rows.items()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.ids for r in out} == want
    assert {r.doc_id: r.decoded for r in out} == {i: library.decode(x) for i, x in want.items()}
    assert len(out) < docs.count()


def test_odd_documents(spark, tmp_path):
    text = "the cat and the dog are here and there with the rest of them "
    rows = [(i, text + str(i) * 40 + " " + text, "en", "s", 5) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (None, text * 3, "en", "s", 3), (None, text * 3, "en", "s", 3), (3, rows[3][1], "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS kept", "2 AS fp")
    spark.createDataFrame([(1, "some test item is here. And an answer.")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.where("false")):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            before, out = out, stage(spark, out, str(tmp_path))
            if stage is not corpus_pipeline.tokens:
                assert out.columns == before.columns
        ids = [r.doc_id for r in out.collect()]
        assert len(ids) == len(set(ids))


def test_passages_of_words_can_go(spark):
    """F1 (pipeline): the suffix-array stage can remove passages of over 50 words that are shorter than 400 bytes."""
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(n))
    short, long = text(51), text(300)
    assert len(short.encode()) < 400 < len(long.encode())
    texts = [f"{text(30)} {short} {text(30)}", f"{text(40)}\n{short}", f"{text(9)} {long} {text(9)}", f"{long}\n{text(80)}", text(200), short, None]
    rows = [(i, t, "en", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    got = corpus_pipeline.repeated_passages(spark, docs, "", passage_words=51)
    assert got.columns == docs.columns
    want = {}
    for i, (t, gone, spans) in enumerate(zip(texts, plain_passages(texts, 51), plain(texts), strict=True)):
        gone = gone.union(*[range(a, b) for a, b in spans])
        left = bytes(c for k, c in enumerate((t or "").encode()) if k not in gone).decode("utf-8", "ignore")
        if t is None or left.strip(" "):
            want[i] = (None if t is None else left, len(left))
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == want
    assert 5 not in want and len(want[0][0]) < len(texts[0]) - len(short) + 2


def test_registered_pipeline_removes_passages_of_words(spark, tmp_path):
    """F1 (pipeline): passages of over 50 words go in the registered pipeline, shorter than 400 bytes or not; 50 words stay."""
    rnd = random.Random(12)
    vocabulary = ["the", "and", "of", "to", "in", "that", "with", "for", "naïve", *("".join(rnd.choice("aeionrstl") for _ in range(rnd.randrange(1, 7))) for _ in range(400))]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [text(n) for n in (51, 51, 55, 60, 200)]
    fifty, alone = text(50), text(53)
    assert all(len(t.encode()) < 400 for t in (*shared[:4], fifty, alone)) and len(shared[4].encode()) > 400
    texts = [text(rnd.randrange(60, 200)) for _ in range(40)]
    for i, t in enumerate(texts[:30]):
        texts[i] = f"{t}{rnd.choice([' ', chr(10)])}{shared[i % 5]} {text(rnd.randrange(60, 120))}"
    texts[30], texts[31] = f"{texts[30]} {fifty} x", f"{texts[31]} {fifty} y"
    texts += [f"{alone}\n", f"{text(150)} {alone} {text(150)}", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some test item is here. And an answer.")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = langid.fit(docs.where(~langid.held_out()))
    kept = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    rows = {i: t for i, t in enumerate(texts) if i in kept}
    groups = plain_components({i: plain_fingerprint(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    assert len(rows) > 35 and {30, 31, 40, 41} <= set(rows)
    found, want = zip(plain_passages(rows.values(), 51), plain(rows.values()), strict=True), {}
    for (i, t), (gone, spans) in zip(rows.items(), found, strict=True):
        gone = gone.union(*[range(a, b) for a, b in spans])
        left = bytes(c for k, c in enumerate((t or "").encode()) if k not in gone).decode("utf-8", "ignore")
        if not gone or left.strip():
            want[i] = left
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = {r.doc_id: r.decoded for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()}
    assert out == {i: library.decode(library.encode(t)) for i, t in want.items()}
    assert not [i for i, t in out.items() for s in (*shared, alone) if s in t]
    assert 40 not in out and fifty in out[30] and fifty in out[31]
    by_laws = {r.doc_id: r.decoded for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [sum(s in t for t in by_laws.values()) for s in shared] == [6, 6, 6, 6, 0]


def test_benchmark_items_that_repeat_are_found(spark, tmp_path):
    """F1 (pipeline, r04): texts that hold a benchmark item go, though the stage before decontamination cuts the item or a part of it."""
    rnd = random.Random(13)
    text = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(n))
    item, long, brief, passage, other = text(54), text(100), text(30), text(60), text(150)
    part = " ".join(long.split()[:55])
    wanted = {i: f"{text(40)} {passage} {text(40 + i)}" for i in (20, 21)} | {22: f"{text(70)} {other}", 24: text(90), 25: f"{text(40)} {part} {text(50)}"}
    gone = {i: f"{text(60)}\n{item} {text(30 + i)}" for i in (0, 1)} | {2: item, 3: f"{text(70)} {long} {text(60)}", 4: f"{text(50)} {long}\n{text(80)}"}
    gone |= {5: f"{text(50)} {brief} {text(50)}", 6: f"{text(50)} {brief} {text(20)} {passage}", 7: f"{item} {text(20)}\n{other} {text(20)}"}
    rows = [*gone.items(), *wanted.items(), (None, f"{text(33)} {item}"), (None, f"{passage} {text(80)}"), (30, None)]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, n_chars bigint")
    docs = docs.selectExpr("*", "doc_id AS _left", "'r' AS _row")
    spark.createDataFrame(list(enumerate([item, long, brief, None])), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, out, str(tmp_path))
    got = {r.doc_id if r.doc_id is not None else -1: r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == len(got)
    want = wanted | {-1: rows[-2][1], 30: None}
    for i, t in want.items():
        for s in (passage, other, part):
            want[i] = t = t and t.replace(s, "")
    assert {i: r.text for i, r in got.items()} == want
    assert all((r.n_chars, r._left, r._row) == (len(r.text or ""), r.doc_id, "r") for r in got.values())
