"""Streams over several micro-batches give what the tables give."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from checks.queries import QUERIES
from crawlframe.operators import fetchlog
from crawlframe.session import work_path
from crawlframe.sources import readers
from crawlframe.streaming import jobs

SCHEMA = "event_id bigint, ts timestamp, site string, uri string, status int, bytes bigint"


def feed(spark, rows, files=4):
    """Rows in several files, read one file per micro-batch."""
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    data = [(i, start + timedelta(seconds=s), site, uri, status, 10) for i, (s, site, uri, status) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    folder = work_path(spark, "feed")
    df.repartition(files).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return df, stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


ROWS = [(i * 7, f"s{i % 3}/", f"s{i % 3}/{i % 11}", 200) for i in range(200)]


def test_throughput(spark):
    table, stream = feed(spark, ROWS)
    got = jobs.run_to_table(jobs.stream_throughput(stream), "t", "complete")
    assert rows(got) == rows(fetchlog.throughput_report(table))


def test_closed_intervals_are_appended_once(spark):
    table, stream = feed(spark, ROWS, files=1)
    got = rows(jobs.run_to_table(jobs.stream_throughput(stream, late="10 seconds"), "t"))
    want = rows(fetchlog.throughput_report(table))
    assert got == want[: len(got)] and len(want) - len(got) <= 3


def test_frontier_admits_once(spark):
    table, stream = feed(spark, ROWS)
    got = rows(jobs.run_to_table(jobs.stream_frontier(stream), "f"))
    assert got == rows(table.select("site", "uri").distinct())
    bounded = rows(jobs.run_to_table(jobs.stream_frontier(stream, within="1 day"), "f"))
    assert bounded == got


def test_site_states(spark):
    seen = [
        (0, "a/", "a/robots.txt", 200), (10, "a/", "a/x", 200), (5000, "a/", "a/y", 404),
        (0, "b/", "b/robots.txt", 503), (0, "c/", "c/robots.txt", 404),
    ]
    _, stream = feed(spark, seen)
    got = rows(jobs.run_to_table(jobs.stream_site_state(stream, "10 minutes", late="2 hours"), "s", "complete").select("site", "requests", "state"))
    assert got == [("a/", 1, "completed"), ("a/", 2, "completed"), ("b/", 1, "skipped"), ("c/", 1, "robots")]


def test_idle_sites_are_reported_when_the_watermark_passes(spark):
    seen = [(0, "a/", "a/x", 200), (100_000, "b/", "b/x", 200)]
    _, stream = feed(spark, seen, files=1)
    got = rows(jobs.run_to_table(jobs.stream_site_state(stream, "10 minutes"), "s").select("site", "state"))
    assert got == [("a/", "completed")]


def test_route_repeats_nothing(spark):
    _, stream = feed(spark, [(i, "s/", f"http://s/{i}", 200 if i % 2 else 404) for i in range(20)])
    docs = stream.withColumn("lang", F.when(F.col("event_id") < 10, F.lit("ja"))).withColumn(
        "html", F.concat(F.lit("<p>\n"), "uri"))
    uris, html, state = (work_path(spark, n) for n in ("u", "h", "c"))
    for _ in range(2):  # the second run finds nothing new
        jobs.start_route(docs, uris, html, state, "ja").awaitTermination()
    assert readers.read_uri_log(spark, uris).count() == 20
    kept = readers.read_html_archive(spark, html)
    assert rows(kept) == sorted((f"http://s/{i}", f"<p>\nhttp://s/{i}") for i in range(1, 10, 2))


def test_pages_in_one_file_and_in_a_folder_of_parts(spark, tmp_path):
    """Larger tables are folders of part files: streams read them as they read a single file."""
    link = '<html lang="{}"><a href="/l{}">x</a></html>'
    made = [(i, f"https://h{i % 3}.example/p{i}", link.format("en" if i % 2 else "de", i)) for i in range(12)]
    pages = spark.createDataFrame(made, readers.PAGES_SCHEMA)
    pages.repartition(3).write.parquet(str(tmp_path / "parts" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "pages.parquet").write_bytes(part.read_bytes())
    # Other tables and part files beside it are not read.
    pages.write.parquet(str(tmp_path / "parts" / "pages.parquet.old"))
    for name, count in (("stream_route", 18), ("stream_frontier", 12)):
        found = [rows(QUERIES[name](spark, str(tmp_path / kind))) for kind in ("file", "parts")]
        assert found[0] == found[1] and len(found[0]) == count
