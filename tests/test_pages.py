import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import headers, markup
from crawlframe.operators import language, pages

PAGE = """<?xml version="1.0" encoding="utf-8"?>
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="ja">
<head><title>研究 &amp; 室</title><script>var a = '<a href="/no">';</script></head>
<body><!-- <a href="/hidden"> --><p>こん<b>にち</b>は<br/>世界
<a class="k" href ="http://other.example.org/?検索 語">検索</a>
<a href="#part">部分</a><a href='./index.php?a=1&amp;b=2'>頁</a>
<a href="papers/one.pdf">論文</a><a data-href="/no2" title="href='/no3'" HREF=plain>素</a>
<a name="x">名</a><area href="/no4"><a href="">空</a>
"""


def docs(spark):
    return spark.createDataFrame([(1, "http://lab.example.ac.jp/index.php", PAGE)], "page_id bigint, url string, html string")


WANTED = {
    "http://other.example.org/?%E6%A4%9C%E7%B4%A2%20%E8%AA%9E",
    "http://lab.example.ac.jp/index.php",
    "http://lab.example.ac.jp/index.php?a=1&b=2",
    "http://lab.example.ac.jp/plain",
}


def test_links_of_one_page(spark):
    links = pages.dedup_links(pages.extract_links(docs(spark))).collect()
    assert {r.dst_url for r in links} == WANTED and len(links) == len(WANTED)


def test_native_and_parsed_links_agree(spark):
    parsed = pages.parsed_links(pages.parse_pages(docs(spark)))
    native = pages.all_links(docs(spark))
    key = lambda rows: sorted((r.raw_href, r.dst_url or "", r.reject_reason or "") for r in rows.collect())
    assert key(parsed) == key(native)


def test_parse_pages(spark):
    row = pages.parse_pages(docs(spark)).first()
    assert row.ok and row.error is None and row.declared_lang == "ja"
    assert row.title == "研究 & 室"
    assert row.text.startswith("研究 & 室 こんにちは 世界 検索 部分") and "var a" not in row.text


def test_failed_page_is_a_record(spark):
    rows = spark.createDataFrame(
        [(1, b"<p>x", "text/html; charset=no-such"), (2, None, None), (3, b"<p>y</p>", None)],
        "page_id bigint, html binary, ct string",
    )
    got = {r.page_id: (r.ok, r.text) for r in pages.parse_pages(rows, content_type="ct").collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, "y")}


def test_size_cap(spark):
    rows = spark.createDataFrame([(1, "é"), (2, "ab"), (3, "abc")], "id int, html string")
    assert [r.id for r in pages.body_size_cap(rows, cap=2).collect()] == [1, 2]
    assert [r.id for r in pages.body_size_rejects(rows, cap=2).collect()] == [3]


@pytest.mark.parametrize(
    "text, kind, charset",
    [
        ("text/html; charset=UTF-8", "html", "UTF-8"),
        ("text/plain", "html", None),
        ("Application/XHTML+xml;charset=\"Shift_JIS\"", "xml", "Shift_JIS"),
        ("text/xml ; x=1; charset=euc-jp", "xml", "euc-jp"),
        ("application/pdf", "html", None),
        (None, "html", None),
    ],
)
def test_content_types(spark, text, kind, charset):
    row = spark.createDataFrame([(text,)], "ct string").select(
        headers.parser_kind("ct").alias("k"), headers.charset_of("ct").alias("c")
    ).first()
    assert (row.k, row.c) == (kind, charset)


def test_header_lookup(spark):
    rows = spark.createDataFrame([({"location": "/x"},)], "h map<string,string>")
    assert rows.select(headers.header("h", "Location")).first()[0] == "/x"


def test_charsets(spark):
    text = "日本語 カナ"
    cases = [
        (text.encode("utf-8"), "UTF-8", text),
        (text.encode("shift_jis"), "Shift_JIS", text),
        (text.encode("euc-jp"), "EUC-JP", text),
        (b"\xef\xbb\xbf" + text.encode(), None, text),
        (text.encode("utf-16"), None, text),
        (b'<meta charset="shift_jis">' + text.encode("shift_jis"), None, '<meta charset="shift_jis">' + text),
        (b'<?xml version="1.0" encoding="euc-jp"?>' + text.encode("euc-jp"), None,
         '<?xml version="1.0" encoding="euc-jp"?>' + text),
        (b'<meta charset="no-such">a', None, '<meta charset="no-such">a'),
        (b"\xff", "utf-8", "�"),
        (b"x", "no-such", None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(cases)], "i int, b binary, c string")
    got = {r.i: r.t for r in rows.select("i", markup.decode_body("b", "c").alias("t")).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(cases)}


def test_language_gate(spark):
    rows = spark.createDataFrame([("ja", "/x"), ("en", "/"), ("en", "/x"), (None, "/"), (None, "/x")], "l string, p string")
    got = rows.select(pages.language_gate(F.col("l"), F.col("p"), "ja"), pages.archive_gate(F.col("l"), "ja")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False), (True, False), (False, False)]


def test_script_filter(spark):
    rows = spark.createDataFrame(
        [(1, "a" * 99 + " я"), (2, "a" * 40 + "я" * 2), (3, "日本 only かな"), (4, ""), (5, "12 .")], "id int, text string"
    )
    got = {r.id: (r.text, r.scripts_removed) for r in language.script_filter(rows).collect()}
    assert got == {
        1: ("a" * 99 + " ", 1), 2: ("a" * 40 + "я" * 2, 0), 3: ("日本 only かな", 0), 4: ("", 0), 5: ("12 .", 0),
    }
    cut = language.script_filter(rows, max_chars=10).filter("id = 1").first()
    assert cut.text == "a" * 10


TEXTS = [
    (1, "ja", "これは日本語の文章です。私たちは毎日ことばを使います。東京は大きい街です。"),
    (2, "en", "This is an English sentence. We use words every day. London is a large city."),
    (3, "de", "Dies ist ein deutscher Satz. Wir benutzen jeden Tag Wörter. Berlin ist eine große Stadt."),
]


def test_language_detection(spark):
    train = spark.createDataFrame(TEXTS, "doc_id int, lang string, text string")
    profiles = language.train_lang_profiles(train)
    asked = spark.createDataFrame(
        [(1, "東京の街で日本語を使います"), (2, "the city uses words"), (3, "Wörter und Sätze jeden Tag"), (4, ""), (5, "東")],
        "doc_id int, text string",
    )
    for limit in (10_000, 1):  # broadcast, then joined by shuffle
        got = {r.doc_id: r.lang for r in language.detect_language(asked, profiles, ["de", "en", "ja"], broadcast_rows=limit).collect()}
        assert got == {1: "ja", 2: "en", 3: "de", 4: None, 5: "ja"}


def test_grams_match_brute_force(spark, sf_dir):
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("n_chars < 2000")
    docs_ = docs_.unionByName(spark.createDataFrame([(-1, "a"), (-2, "é😀"), (-3, "")], "doc_id bigint, text string"))
    want = Counter(
        (r.doc_id, r.text[i : i + n]) for r in docs_.collect() for n in (1, 2, 3) for i in range(len(r.text) - n + 1)
    )
    got = {(r.doc_id, r.gram): r.n for r in language.gram_counts(docs_, ["doc_id"]).collect()}
    assert got == want


def test_profiles_and_scores_by_numbers(spark, monkeypatch):
    """Training lists no row per character; its counts are those of ``gram_counts``, scores those of a plain sum."""
    rng = random.Random(3)
    letters = "ab cé\u0000\U0001f600z日￿"
    made = [(i, rng.choice(["en", "de", None]), rng.choice([None, "", "".join(rng.choices(letters, k=rng.randrange(1, 400)))])) for i in range(300)]
    docs_ = spark.createDataFrame(made, "doc_id bigint, lang string, text string")
    labelled = docs_.where("lang IS NOT NULL")
    bytes_ = labelled.select("lang", F.col("text").cast("binary").alias("text"))
    plain = sorted(tuple(r) for r in language.gram_counts(labelled, ["lang"]).select("lang", "gram", "n").collect())
    monkeypatch.setattr(language, "CHUNK", 50)
    monkeypatch.setattr(language, "HELD", 60)
    assert sorted(tuple(r) for r in language.lang_grams(bytes_).collect()) == plain and len(plain) > 500
    profiles = language.train_lang_profiles(docs_)
    assert "Generate" not in profiles._jdf.queryExecution().optimizedPlan().toString()
    wide = language.wide_profiles(profiles, ["de", "en"]).toPandas().sample(frac=0.5, random_state=1)
    known = {r.gram: (r.w_de, r.w_en) for r in wide.itertuples(index=False)}
    texts = [t or "" for _, _, t in made[:60]] + ["qqq", "q", "aq", "qa", "é"]
    want = []
    for t in texts:
        found = [known[g] for k in (1, 2, 3) for i in range(len(t) - k + 1) if (g := t[i : i + k]) in known]
        want.append([sum(w) for w in zip(*found)] if found else None)
    for size in (1 << 22, 0):  # tables of all steps, steps in order
        monkeypatch.setattr(language, "DENSE", size)
        assert language.score_texts(texts, language.score_table(wide)) == want
