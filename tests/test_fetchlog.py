import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from crawlframe.operators import fetchlog

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
US = 1_000_000


def at(seconds):
    return START + timedelta(seconds=seconds)


def us(seconds):
    return int(START.timestamp() * US) + int(seconds * US)


def attempts(spark, rows):
    return spark.createDataFrame(
        [(i, at(s), uri, kind) for i, (uri, s, kind) in enumerate(rows)],
        "event_id bigint, ts timestamp, uri string, kind string",
    )


def decisions(df):
    return [r.decision for r in df.orderBy("event_id").collect()]


def test_retry_cases(spark):
    rows = [("u", i * 4000, k) for i, k in enumerate(
        ["timeout", "error", "timeout", "timeout", "ok", "timeout", "too_large", "timeout", "timeout", "timeout"])]
    assert decisions(fetchlog.retry_decision(attempts(spark, rows))) == [
        "retry", "retry", "give_up", "retry", "done", "retry", "give_up", "retry", "retry", "give_up"]
    robots = [("r", i, "error") for i in range(4)]
    assert decisions(fetchlog.retry_decision(attempts(spark, robots), max_failures=4)) == ["retry"] * 3 + ["give_up"]


def test_retry_matches_a_fold(spark):
    rng = random.Random(3)
    rows = sorted(
        ((rng.choice(["hot"] * 4 + ["a", "b"]), rng.randrange(200_000), rng.choice(["ok", "too_large"] + ["error"] * 6))
         for _ in range(800)), key=lambda r: r[1])
    want, failed = [], {}
    for uri, _, kind in rows:
        n = failed.get(uri, 0)
        if kind in ("ok", "too_large"):
            failed[uri] = 0
            want.append("done" if kind == "ok" else "give_up")
        else:
            failed[uri] = (n + 1) % 3
            want.append("give_up" if n + 1 == 3 else "retry")
    for piece in ("minute", "hour", "year"):
        assert decisions(fetchlog.retry_decision(attempts(spark, rows), piece=piece)) == want


def log(spark, rows):
    return spark.createDataFrame(
        [(i, at(s), site, site + "p", 200, 10) for i, (site, s) in enumerate(rows)],
        "event_id bigint, ts timestamp, site string, uri string, status int, bytes bigint",
    )


def test_stale_sites(spark):
    # Checks at 900, 1200, 1500 ... after the site's first request.
    rows = [("A/", 0), ("A/", 650), ("A/", 1300), ("A/", 90_000), ("B/", 89_900)]
    got = sorted(tuple(r) for r in fetchlog.stale_sites(log(spark, rows)).collect())
    assert got == [
        ("A/", us(0), us(650), None),
        ("A/", us(650), us(1300), None),
        ("A/", us(1300), us(90_000), us(2100)),
    ]
    later = fetchlog.stale_sites(log(spark, rows), now=F.lit(at(91_000))).filter("to_us IS NULL")
    assert sorted(tuple(r) for r in later.collect()) == [
        ("A/", us(90_000), None, us(90_900)),
        ("B/", us(89_900), None, us(90_800)),
    ]


def test_sessions_match_session_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot/"] * 4 + ["a/", "b/"]), rng.randrange(400_000)) for _ in range(700)]
    df = log(spark, rows)
    native = (
        df.groupBy("site", F.session_window("ts", "20 minutes").alias("w"))
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
        .select("site", F.unix_micros("a"), F.unix_micros("b"), "n")
    )
    want = sorted(tuple(r) for r in native.collect())
    got = fetchlog.site_sessions(df, "20 minutes")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_throughput_and_paths(spark):
    df = log(spark, [("A/", 0), ("A/", 4), ("A/", 5)])
    assert sorted(tuple(r) for r in fetchlog.throughput_report(df).collect()) == [(us(0), 2, 20), (us(5), 1, 10)]
    assert fetchlog.viewed_paths(df).count() == 1


def test_uri_batches_are_contiguous(spark):
    rng = random.Random(5)
    df = log(spark, [("A/", rng.randrange(200_000)) for _ in range(250)])
    got = fetchlog.uri_batches(df, 100).orderBy("ts", "event_id").collect()
    assert [r.line_no for r in got] == list(range(1, 251))
    assert [r.batch for r in got] == [0] * 100 + [1] * 100 + [2] * 50
