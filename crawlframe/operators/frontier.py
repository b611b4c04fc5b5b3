"""The frontier: which URLs wait, which sites come next, what is fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import urls
from crawlframe.operators.ordered import split_rank
from crawlframe.session import stored


def to_frontier(links: DataFrame) -> DataFrame:
    """Links as frontier rows (site, uri), each once."""
    return links.select(F.col("dst_site").alias("site"), F.col("dst_url").alias("uri")).distinct()


def seeds_to_frontier(seeds: DataFrame) -> DataFrame:
    """Seed lines (value) as frontier rows, each once; lines that are no address are left out."""
    lines = seeds.select(F.lit("").alias("_base"), F.array("value").alias("_hrefs"))
    return lines.select(F.explode(urls.resolved("_base", "_hrefs")).alias("_seed")).filter("_seed.url IS NOT NULL").select(
        F.col("_seed.site").alias("site"), F.col("_seed.url").alias("uri")
    ).distinct()


def merge_seeds(bundled: DataFrame, other: DataFrame) -> DataFrame:
    """Seed lists one after the other; duplicates stay until they are admitted."""
    return bundled.unionByName(other)


def merge_frontiers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Site-wise union of waiting URLs."""
    return old.select("site", "uri").unionByName(new.select("site", "uri")).distinct()


def drop_viewed(candidates: DataFrame, fetched: DataFrame, key: str = "path") -> DataFrame:
    """Candidates (site, uri) not handled yet.

    ``key="path"`` compares site and path and so ignores queries; ``"uri"`` compares whole
    URLs. The handled side is folded before it is shuffled.
    """
    if key == "uri":
        seen = fetched.select("uri").distinct()
        return candidates.join(seen, "uri", "left_anti").select(*candidates.columns)
    seen = fetched.select("site", urls.path("uri").alias("_path")).distinct()
    rows = candidates.withColumn("_path", urls.path("uri"))
    return rows.join(seen, ["site", "_path"], "left_anti").select(*candidates.columns)


def site_weight(
    site_events: DataFrame, skip_weight: int = 100, completion_weight: int = 20, piece: int = 65536
) -> DataFrame:
    """Penalty of each site from its events (site, seq, kind) in ``seq`` order.

    A skip sets the weight, each completion adds to it. Events are folded in pieces of
    ``piece`` sequence numbers, so a site with very many events is not one task's work.
    """
    cut = site_events.select(
        "site", "kind", F.col("seq"), F.floor(F.col("seq") / piece).alias("_piece"),
        F.when(F.col("kind") == "skipped", F.col("seq")).alias("_skip"),
    )
    in_piece = Window.partitionBy("site", "_piece")
    after_skip = (F.col("kind") == "completed") & (
        F.col("_last_skip").isNull() | (F.col("seq") > F.col("_last_skip"))
    )
    pieces = (
        cut.withColumn("_last_skip", F.max("_skip").over(in_piece))
        .groupBy("site", "_piece")
        .agg(F.max("_skip").alias("_skip"), F.count_if(after_skip).alias("_done"))
    )
    skip_piece = F.max(F.when(F.col("_skip").isNotNull(), F.col("_piece")))
    return (
        pieces.withColumn("_from", skip_piece.over(Window.partitionBy("site")))
        .filter("_from IS NULL OR _piece >= _from")
        .groupBy("site")
        .agg(
            (
                F.when(F.max("_from").isNotNull(), F.lit(skip_weight)).otherwise(F.lit(0))
                + completion_weight * F.sum("_done")
            ).cast("bigint").alias("weight")
        )
    )


def frontier_admit(
    links: DataFrame,
    frontier: DataFrame,
    active: DataFrame,
    site_state: DataFrame,
    block_weight: int = 100,
    block_site: bool = False,
) -> DataFrame:
    """New URLs (site, uri, dest) of ``links`` (site, uri).

    A URL is refused when it carries ``block_weight`` itself: weights are kept under site
    keys, so by default only a site's root URL can be refused; ``block_site`` refuses all
    URLs of the site. URLs of an active site go to it (``active``), others wait
    (``pending``) unless they wait already. Links are folded first: a URL that a third of
    all pages link to reaches the joins once. Folding and joins share the key (site, uri),
    so links are shuffled once.
    """
    fresh = links.select("site", "uri").distinct()
    heavy = site_state.filter(F.col("weight") >= block_weight).select("site")
    if block_site:
        allowed = fresh.join(heavy, "site", "left_anti")
    else:
        allowed = fresh.join(heavy.withColumn("uri", F.col("site")), ["site", "uri"], "left_anti")
    running = active.select("site").distinct().withColumn("_running", F.lit(True))
    placed = allowed.join(running, "site", "left").select(
        "site", "uri", F.when(F.col("_running"), F.lit("active")).otherwise(F.lit("pending")).alias("dest")
    )
    waiting = frontier.select("site", "uri")
    known = (
        (placed["site"] == waiting["site"]) & (placed["uri"] == waiting["uri"]) & (placed["dest"] == "pending")
    )
    return placed.join(waiting, known, "left_anti")


def pending_by_site(frontier: DataFrame) -> DataFrame:
    """Distinct waiting URLs of each site.

    URLs are made distinct on (site, uri) first, so the shuffle is spread over URLs; the
    second step adds up partial counts.
    """
    return frontier.select("site", "uri").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pending"))


def crawl_gauge(active: DataFrame, frontier: DataFrame) -> DataFrame:
    """One row: active sites, pending links, pending sites."""
    waiting = pending_by_site(frontier).agg(
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_links"), F.count(F.lit(1)).alias("pending_sites")
    )
    running = active.select("site").distinct().agg(F.count(F.lit(1)))
    return waiting.select(running.scalar().alias("active_sites"), "pending_links", "pending_sites")


def select_sites(
    frontier: DataFrame, site_state: DataFrame, active: DataFrame, concurrency: int = 10
) -> DataFrame:
    """The sites to start now: (site, pending, weight, score, rank), best first.

    Score is pending URLs minus weight. As many are taken as there are free slots, at most
    the greater of 100 and two percent of the waiting sites plus one; ties go by name.
    No more than ``concurrency`` rows can be asked for, so Spark keeps a bounded heap per
    task and only those few rows are numbered.
    """
    pending = pending_by_site(frontier)
    take = F.lit(concurrency) - active.select("site").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    if concurrency > 100:  # only then can the share of waiting sites be the lower bound
        pending = stored(pending, "pending")
        waiting = pending.agg(F.count(F.lit(1)).alias("n")).scalar()
        take = F.least(take, F.greatest(F.lit(100), F.floor(waiting * 2 / 100) + 1))
    weight = F.coalesce("weight", F.lit(0)).cast("bigint")
    scored = pending.join(site_state.select("site", "weight"), "site", "left").select(
        "site", "pending", weight.alias("weight"), (F.col("pending") - weight).alias("score")
    )
    best = scored.orderBy(F.desc("score"), "site").limit(concurrency)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "site")).cast("bigint")
    return best.withColumn("rank", place).filter(F.col("rank") <= take)


def fetch_list(selected: DataFrame, frontier: DataFrame) -> DataFrame:
    """URLs of the selected sites; Spark broadcasts the selection if its size allows."""
    chosen = selected.select("site")
    return frontier.select("site", "uri").distinct().join(chosen, "site", "left_semi")


def remaining_frontier(selected: DataFrame, frontier: DataFrame) -> DataFrame:
    """What still waits after ``fetch_list`` was taken out."""
    chosen = selected.select("site")
    return frontier.select("site", "uri").distinct().join(chosen, "site", "left_anti")


def politeness_schedule(
    fetches: DataFrame,
    waits: DataFrame | None = None,
    default_wait_s: float = 5.0,
    throttle_s: float = 5.0,
    jitter_ms: int = 200,
    pieces: int = 2,
) -> DataFrame:
    """When each URL of (site, uri) is requested: ``rn`` and ``offset_ms`` from the start.

    A site gets one request per wait, never less than the throttle, plus a repeatable
    jitter below ``jitter_ms``. Slots are longer than the wait by the largest jitter, so the
    gap between two requests is never below the wait. Within a site URLs go in the order of their MD5, which
    stands for the arbitrary order of a set and lets a huge site be ranked in
    ``16 ** pieces`` parts.
    """
    digest = fetches.withColumn("_digest", F.md5(F.col("uri")))
    wait = F.lit(default_wait_s)
    ranked = split_rank(
        digest,
        ["site"],
        ["_digest", "uri"],
        [F.substring("_digest", 1, pieces)],
        per_key=None if waits is None else waits.select("site", "wait_s"),
    ).drop("_digest")
    ranked = ranked.withColumn("wait_s", wait if waits is None else F.coalesce("wait_s", wait))
    step = F.round(F.greatest(F.lit(throttle_s), F.col("wait_s")) * 1000).cast("bigint")
    drawn = F.conv(F.substring(F.md5(F.col("uri")), 1, 6), 16, 10).cast("bigint")
    jitter = drawn % jitter_ms if jitter_ms else F.lit(0).cast("bigint")
    slot = step + max(jitter_ms - 1, 0)
    return ranked.withColumn("offset_ms", (F.col("rn") - 1) * slot + jitter)


def clocked_schedule(
    fetches: DataFrame,
    clocks: DataFrame,
    round_start_ms: int,
    waits: DataFrame | None = None,
    default_wait_s: float = 5.0,
    throttle_s: float = 5.0,
    jitter_ms: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """``politeness_schedule`` on each site's clock: (site, uri, rn, wait_s, at_ms) and the next clocks (site, free_ms).

    A site's clock is the earliest time its next slot may start. This round's slots start at
    ``max(round_start_ms, free_ms)`` and its clock moves to the end of its last slot: the (max, +) step
    ``free' = max(ready, free) + n * slot``, carried from round to round one row per site, so the gap between two
    requests of a site is never below its wait across rounds either. Sites without fetches keep their clock.
    """
    plan = politeness_schedule(fetches, waits, default_wait_s, throttle_s, jitter_ms)
    slot = F.round(F.greatest(F.lit(throttle_s), F.col("wait_s")) * 1000).cast("bigint") + max(jitter_ms - 1, 0)
    ready = F.lit(round_start_ms).cast("bigint")
    plan = plan.join(clocks.select("site", "free_ms"), "site", "left").withColumn(
        "_base", F.greatest(ready, F.coalesce("free_ms", ready))
    )
    schedule = plan.select("site", "uri", "rn", "wait_s", (F.col("_base") + F.col("offset_ms")).alias("at_ms"))
    ends = plan.groupBy("site").agg(F.max(F.col("_base") + F.col("rn") * slot).alias("_free"))
    moved = clocks.select("site", "free_ms").join(ends, "site", "full_outer").select(
        "site", F.greatest("free_ms", "_free").alias("free_ms")
    )
    return schedule, moved
