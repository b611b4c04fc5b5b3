import glob
import gzip
import random

import numpy as np
from pyspark.sql import functions as F

from crawlframe.config import ARCHIVE_SEPARATOR, CrawlConfig
from crawlframe.operators.archive import byte_batches, digits_for, file_starts
from crawlframe.sinks.writers import write_html_archive, write_uri_log
from crawlframe.sources import readers


def roll(sizes, limit):
    """A file opens once enough is counted; its first record is not counted itself."""
    batch, counted, files = 0, 0, []
    for size in sizes:
        if counted >= limit:
            batch, counted = batch + 1, 0
        else:
            counted += size
        files.append(batch)
    return files


def test_roll_cases():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randrange(0, 30) for _ in range(rng.randrange(1, 40))]
        cut = rng.randrange(0, len(sizes))
        starts, counted = file_starts(np.array(sizes[:cut], dtype=np.int64), 0, 25)
        more, _ = file_starts(np.array(sizes[cut:], dtype=np.int64), counted, 25)
        want = roll(sizes, 25)
        opened = [i for i in range(1, len(sizes)) if want[i] != want[i - 1]]
        assert starts + [cut + i for i in more] == opened


def test_byte_batches(spark):
    rng = random.Random(8)
    data = [(i, rng.randrange(1, 100)) for i in range(500)]
    df = spark.createDataFrame(data, "page_id bigint, read_bytes bigint")
    got = byte_batches(df, 300).collect()
    assert len(got) == 500 and len({r.shard for r in got}) == 16
    for shard in {r.shard for r in got}:
        mine = sorted((r for r in got if r.shard == shard), key=lambda r: r.page_id)
        assert [r.batch for r in mine] == roll([r.read_bytes for r in mine], 300)


def test_shards_follow_the_size():
    assert [digits_for(n, 10) for n in (0, 100, 101, 1600, 1601)] == [0, 0, 1, 1, 2]


def test_archive_round_trip(spark, tmp_path):
    docs = [(i, f"http://h.example.org/{i}%20x", f"<p>\n{i} é\n</p>\n" * i, i % 3 > 0, "ja" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame(docs, "page_id bigint, url string, html string, ok boolean, lang string")
    folder = str(tmp_path / "html")
    write_html_archive(df, folder, max_bytes=500, target_lang="ja", digits=0)
    kept = {d[1].replace("%20", " "): d[2] for d in docs if d[3] and d[4] == "ja"}
    back = readers.read_html_archive(spark, folder)
    assert {r.url: r.html for r in back.collect()} == kept
    files = glob.glob(folder + "/*/*.gz")
    sizes = [len(d[2].encode()) for d in docs if d[3] and d[4] == "ja"]
    assert len(files) == roll(sizes, 500)[-1] + 1 > 2
    text = gzip.open(files[0], "rt", encoding="utf-8", newline="").read()
    assert text.endswith(ARCHIVE_SEPARATOR) and text.startswith("http://h.example.org/")


def test_uri_log(spark, tmp_path):
    rows = spark.range(25).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 50).alias("ts"),
        F.concat(F.lit("http://h.example.org/%C3%A9"), "id").alias("uri"), F.lit(200).alias("status"))
    exact = str(tmp_path / "exact")
    write_uri_log(rows, exact, lines=10, exact=True)
    parts = {p.split("batch=")[1][:4]: gzip.open(p, "rt", encoding="utf-8").read().splitlines() for p in glob.glob(exact + "/*/*.gz")}
    assert [len(parts[k]) for k in sorted(parts)] == [10, 10, 5]
    assert parts["0001"] == [f"http://h.example.org/é{i}\t200" for i in range(10, 20)]
    loose = str(tmp_path / "loose")
    write_uri_log(rows.coalesce(1), loose, lines=10)
    assert len(glob.glob(loose + "/*.gz")) == 3
    assert readers.read_uri_log(spark, loose).count() == 25


def test_seed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("http://a.example.org/\n\n http://b.example.org/ \n")
    (tmp_path / "b.txt").write_text("http://a.example.org/\n")
    import pytest

    with pytest.warns(UserWarning):
        seeds = readers.load_seeds(spark, [f"{tmp_path}/*.txt", f"{tmp_path}/none-*.txt"], ["http://s.example.org/"])
    assert sorted(r.value for r in seeds.collect()) == [
        "http://a.example.org/", "http://a.example.org/", "http://b.example.org/", "http://s.example.org/"]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"concurrency": 3, "ignored_suffixes": [".x"]}')
    config = CrawlConfig.load(str(path))
    assert config.concurrency == 3 and config.ignored_suffixes == (".x",) and config.target_lang == "ja"
