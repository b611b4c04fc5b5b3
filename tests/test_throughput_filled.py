"""Intervals without documents are reported as zeros."""

from datetime import datetime, timedelta

from crawlframe.operators import fetchlog


def test_gaps_are_zero_rows(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=s), b) for s, b in [(0, 1), (3, 2), (26, 5), (27, None)]]
    got = fetchlog.throughput_filled(spark.createDataFrame(rows, "ts timestamp, bytes bigint"), every_s=5).orderBy("start_us").collect()
    base = got[0].start_us
    assert [(r.start_us - base, r.docs, r.bytes) for r in got] == [
        (0, 2, 3), (5_000_000, 0, 0), (10_000_000, 0, 0), (15_000_000, 0, 0), (20_000_000, 0, 0), (25_000_000, 2, 5)]


def test_empty_log(spark):
    assert fetchlog.throughput_filled(spark.createDataFrame([], "ts timestamp, bytes bigint")).collect() == []
