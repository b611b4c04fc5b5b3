"""The curve, the law and the order."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from crawlframe.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    grid = spark.createDataFrame(cells, ", ".join(f"d{i} int" for i in range(n)))
    index = sharding.hilbert_index([F.col(f"d{i}") for i in range(n)], bits)
    rows = sorted((r.at, r[:n]) for r in grid.withColumn("at", index).collect())
    assert [at for at, _ in rows] == list(range(len(cells)))
    for (_, a), (_, b) in itertools.pairwise(rows):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def check(rows, texts, shards):
    counts = {}
    for r in rows:
        counts.setdefault(r.shard, []).append(r.slot)
    sizes = [len(counts.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows) and set(counts) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    cells = [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert cells == sorted(cells)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))


@pytest.mark.parametrize("count", [0, 1, 23, 24, 25, 3000])
def test_rows_law(spark, count):
    texts = {i: [None, "", "copy " * 30, f"text {i} " * (i % 50)][0 if i % 97 == 0 else 1 if i % 89 == 0 else 2 if i % 3 == 0 else 3] for i in range(count)}
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else "s%d" % (i % 5), None if i % 11 == 0 else "en") for i, t in texts.items()],
                                 "doc_id bigint, text string, source string, lang string").withColumn("cell", F.lit(1)).withColumn("shard", F.lit(1))
    rows = sharding.assign(docs).collect()
    assert len(rows) == count
    check(rows, texts, 24)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a", "s", "en")] * 40 + [(5, "a", "s", "en")] * 40 + [(-1, "x" * 10**6, None, None)],
                                 "doc_id bigint, text string, source string, lang string")
    rows = sharding.assign(docs).collect()
    check(rows, {None: "a", 5: "a", -1: "x" * 10**6}, 24)


def test_query_and_files(spark, sf_dir, tmp_path):
    from crawlframe.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op10_sharding"](spark, sf_dir).collect()
    check(rows, texts, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot, r.text) for r in back.collect()} == {(r.doc_id, r.shard, r.slot, texts[r.doc_id]) for r in rows}
