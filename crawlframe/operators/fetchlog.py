"""What a fetch log tells: routes, redirects, throughput, retries, idle sites, batches.

A fetch log has (event_id, ts timestamp, site, uri, status, bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls
from crawlframe.operators.ordered import by_key, split_rank
from crawlframe.session import stored


def status_route(status, location) -> Column:
    """``document`` for 200, ``redirect`` for 3xx with a target, else ``drop``."""
    return (
        F.when(status == 200, F.lit("document"))
        .when(status.between(300, 399) & location.isNotNull(), F.lit("redirect"))
        .otherwise(F.lit("drop"))
    )


def redirect_target(redirects: DataFrame, base: str = "base", location: str = "location") -> DataFrame:
    """Add ``target`` and ``queue``: ``frontier`` for another authority, else ``site``."""
    listed = redirects.withColumn("_hrefs", F.array(location))
    named = listed.withColumn("_to", F.explode(urls.resolved(base, "_hrefs"))).withColumn("target", F.col("_to.url"))
    elsewhere = urls.address(base) != urls.address("target")
    queue = F.when(elsewhere, F.lit("frontier")).when(~elsewhere, F.lit("site"))
    return named.withColumn("queue", queue).drop("_to", "_hrefs")


def viewed_paths(fetch_log: DataFrame) -> DataFrame:
    """Handled paths of each site, one row per (site, path), whatever a site's size."""
    return fetch_log.select("site", urls.path("uri").alias("path")).distinct()


def throughput_report(docs: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Documents and bytes per interval of (ts, bytes)."""
    return (
        docs.groupBy(F.window("ts", every).alias("_w"))
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))
        .select(F.unix_micros("_w.start").alias("start_us"), "docs", "bytes")
    )


def throughput_filled(docs: DataFrame, every_s: int = 5) -> DataFrame:
    """Documents and bytes per interval of (ts, bytes), intervals without documents as zeros.

    Every interval from the first to the last with a document has a row. The intervals come from
    ``spark.range`` over that span, dealt over partitions like any table, and meet the counts in one
    aggregation, so neither side is joined and no task holds more than its part of the span.
    """
    step = every_s * 1_000_000
    counted = docs.groupBy(F.floor(F.unix_micros("ts") / step).alias("_i")).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")
    )
    counted = stored(counted, "throughput")
    span = counted.agg(F.min("_i").alias("lo"), F.max("_i").alias("hi")).first()
    if span["lo"] is None:
        return counted.select((F.col("_i") * step).alias("start_us"), "docs", "bytes")
    spark = docs.sparkSession
    every = spark.range(span["lo"], span["hi"] + 1).select(
        F.col("id").alias("_i"), F.lit(0).cast("bigint").alias("docs"), F.lit(0).cast("bigint").alias("bytes")
    )
    filled = counted.unionByName(every).groupBy("_i").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
    return filled.select((F.col("_i") * step).cast("bigint").alias("start_us"), "docs", "bytes")


def retry_decision(attempts: DataFrame, max_failures: int = 3, piece: str = "hour") -> DataFrame:
    """Add ``failures`` and ``decision`` to attempts (event_id, ts, uri, kind).

    ``ok`` ends a URL's run as ``done``, ``too_large`` as ``give_up``; any other kind is a
    failure: ``retry`` until the ``max_failures``-th in a row, which is ``give_up`` and
    starts afresh. Robots requests use ``max_failures=4``. Each URL's attempts are cut by
    ``piece`` of time, and the running count is carried from piece to piece.
    """
    order = ["ts", "event_id"]
    ends = F.col("kind").isin("ok", "too_large").cast("bigint")
    cut = attempts.withColumns({**by_key(["uri"]), "_piece": F.date_trunc(piece, "ts"), "_ends": F.coalesce(ends, F.lit(0))})
    # Failures so far never decrease, so their greatest value at an end is that at the last end.
    here = Window.partitionBy("_k0", "_piece").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    ahead = here.rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.when(F.col("_ends") == 1, F.col("_so_far"))
    counted = cut.withColumn("_so_far", F.sum(1 - F.col("_ends")).over(upto)).withColumn(
        "_at_end", F.max(at_end).over(ahead)
    )

    # What each piece hands on: failures since its last end, or all of them if it has none.
    pieces = counted.groupBy("_k0", "_piece").agg(
        (F.max("_so_far") - F.coalesce(F.max(at_end), F.lit(0))).alias("_tail"),
        F.max("_ends").alias("_ended"),
    )
    along = Window.partitionBy("_k0").orderBy("_piece")
    chained = pieces.withColumn("_chain", F.sum("_ended").over(along))
    open_ = F.sum("_tail").over(Window.partitionBy("_k0", "_chain").orderBy("_piece"))
    carry = chained.withColumn("_open", open_).select(
        "_k0", "_piece", F.coalesce(F.lag("_open").over(along), F.lit(0)).alias("_carry")
    )
    whole = counted.join(carry, ["_k0", "_piece"], "left").withColumn(
        "failures",
        F.col("_so_far") - F.coalesce("_at_end", -F.col("_carry"), F.lit(0)),
    )
    decision = (
        F.when(F.col("kind") == "ok", F.lit("done"))
        .when(F.col("kind") == "too_large", F.lit("give_up"))
        .when(F.col("failures") % max_failures == 0, F.lit("give_up"))
        .otherwise(F.lit("retry"))
    )
    return whole.select(*attempts.columns, "failures", decision.alias("decision"))


def buckets(fetch_log: DataFrame, width_us: Column) -> DataFrame:
    """(site, first_us, last_us, requests) of each stretch of time of that width with requests.

    No pause longer than the width fits into a stretch, and stretches combine ahead of the shuffle.
    """
    log = fetch_log.select("site", F.unix_micros("ts").alias("_at"))
    width = F.greatest(width_us.cast("bigint"), F.lit(1))
    return log.groupBy("site", (F.col("_at") - F.pmod("_at", width)).alias("_bucket")).agg(
        F.min("_at").alias("first_us"), F.max("_at").alias("last_us"), F.count(F.lit(1)).alias("requests")
    ).drop("_bucket")


def stale_sites(
    fetch_log: DataFrame,
    now: Column | None = None,
    idle_s: int = 600,
    first_check_s: int = 900,
    check_every_s: int = 300,
) -> DataFrame:
    """Pauses of a site longer than ``idle_s``: (site, from_us, to_us, redriven_us).

    Sites are looked at ``first_check_s`` after their first request and then every
    ``check_every_s``; ``redriven_us`` is the first look that finds the pause, null if the
    next request came before it. ``to_us`` is null for the pause up to ``now`` (default:
    the last request of the log).
    """
    second = 1_000_000
    if now is None:
        now = fetch_log.agg(F.max(F.unix_micros("ts")).alias("now")).scalar()
    else:
        now = F.unix_micros(now)
    site = Window.partitionBy("site")
    steps = buckets(fetch_log, F.lit(idle_s * second)).select(
        "site",
        F.min("first_us").over(site).alias("_start"),
        F.col("last_us").alias("from_us"),
        F.lead("first_us").over(site.orderBy("first_us")).alias("to_us"),
    )
    until = F.coalesce("to_us", now)
    pauses = steps.filter(until - F.col("from_us") > idle_s * second)
    base = F.col("_start") + first_check_s * second
    every = check_every_s * second
    looks = F.greatest(
        F.floor((F.col("from_us") + idle_s * second - base) / every) + 1, F.lit(0)
    )
    look = base + looks * every
    return pauses.select(
        "site", "from_us", "to_us", F.when(look < until, look).cast("bigint").alias("redriven_us")
    )


def site_sessions(fetch_log: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Runs of activity per site, apart by more than ``gap``: (site, first_us, last_us, requests).

    Requests are folded into stretches as wide as the gap first; only those are ordered, so a
    busy site is spread over tasks.
    """
    limit = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))
    parts = buckets(fetch_log, limit)
    along = Window.partitionBy("site").orderBy("first_us")
    apart = F.col("first_us") - F.lag("last_us").over(along) > limit
    return (
        parts.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("_session", F.sum("_apart").over(along))
        .groupBy("site", "_session")
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("requests").alias("requests"),
        )
        .drop("_session")
    )


def uri_batches(log: DataFrame, lines: int = 100_000) -> DataFrame:
    """Add ``line_no`` (from 1) and ``batch`` (from 0): ``lines`` rows per batch in log order.

    Minutes are numbered apart; what is carried is one count per minute and per day.
    """
    numbered = split_rank(
        log, [], ["ts", "event_id"], [F.date_trunc("day", "ts"), F.date_trunc("minute", "ts")], "line_no"
    )
    return numbered.withColumn("batch", F.floor((F.col("line_no") - 1) / lines).cast("bigint"))
