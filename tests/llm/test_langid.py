"""Held-out accuracy, rejection and odd rows."""

import zlib

from pyspark.sql import functions as F

from crawlframe.llm import langid


def test_held_out_accuracy(spark):
    from crawlframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["op6_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) > 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in out)


def test_training_never_sees_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    models = [langid.fit(d.where(~langid.held_out())) for d in (docs, spoilt)]
    assert models[0].languages == models[1].languages and (models[0].centroids == models[1].centroids).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog are here " * 3, "en")] * 30 + [("der Hund und die Katze sind hier " * 3, "de")] * 30)],
        "doc_id bigint, text string, lang string",
    )
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 !? \n"), (4, "THE CAT"), (5, "die Katze"), (5, "die Katze"), (None, "the dog " * 400000), (7, "жщъ ыэю " * 60)],
        "doc_id bigint, text string",
    ).withColumn("lang", F.lit(None).cast("string")).withColumn("counts", F.lit(1))
    out = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(odd, model).collect()]
    assert out[:7] == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (5, "de", False), (5, "de", False), (None, "en", False)]
    assert out[7][2]
    none = langid.fit(odd)
    assert none.languages == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_stretches_count_as_one_text(monkeypatch):
    text = "Ein  Satz, und noch ein Satz; 12 Ende. " * 20
    whole = langid.gram_counts(text)
    for stretch in (7, 64, 100):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert (langid.gram_counts(text) == whole).all()
