"""Walks over redirects and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls
from crawlframe.session import discard, stored


def resolve_redirects(edges: DataFrame, max_hops: int = 10, same_authority: bool = False) -> DataFrame:
    """Where each redirecting address ends: (src, target, hops, outcome).

    ``edges`` (src, dst) has one row per address. Outcome is ``final``, ``loop`` when an
    address comes up twice, or ``too_many`` when more than ``max_hops`` redirects follow
    one another; the last two have no target. Paths are doubled round by round, so ten
    hops take four joins, and each round is written before the next reads it. Many
    addresses that lead to one page meet a single row there, which a skew join may copy.

    With ``same_authority`` (addresses are URLs) a chain ends where it first comes to another
    authority: that address is its target, for the frontier.
    """
    further = F.col("dst")
    if same_authority:
        further = F.when(urls.address("src") == urls.address("dst"), further)
    walk = stored(edges.select("src", F.array("dst").alias("path"), further.alias("at")), "redirects")
    length = 1
    while length <= max_hops:
        ahead = walk.select(F.col("src").alias("at"), F.col("path").alias("_path"), F.col("at").alias("_at"))
        walk = stored(
            walk.join(ahead, "at", "left").select(
                "src",
                F.when(F.col("_path").isNull(), F.col("path"))
                .otherwise(F.slice(F.concat("path", "_path"), 1, max_hops + 1))
                .alias("path"),
                F.when(F.col("_path").isNull(), F.col("at")).otherwise(F.col("_at")).alias("at"),
            ),
            "redirects",
        )
        length *= 2
    seen = F.concat(F.array("src"), F.col("path"))
    walked = walk.withColumn("_seen", seen).withColumn(
        "_repeat", F.size(F.array_distinct("_seen")) < F.size("_seen")
    )
    outcome = (
        F.when(F.col("_repeat"), F.lit("loop"))
        .when(F.size("path") > max_hops, F.lit("too_many"))
        .otherwise(F.lit("final"))
    )
    judged = walked.withColumn("outcome", outcome)
    final = F.col("outcome") == "final"
    return judged.select(
        "src",
        F.when(final, F.element_at("path", -1)).alias("target"),
        F.when(final, F.size("path").cast("bigint")).alias("hops"),
        "outcome",
    )


def reachable(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (node) over ``links`` (src, dst): (node, depth).

    Different links are written once, grouped by source: what makes them is not run again in each
    round. Each round folds its targets before it drops the known ones, and is written to the
    shared folder, so plans stay short and lost executors cost one round at most. Every
    eighth round the written pieces are joined into one.
    """
    edges = stored(links.select("src", "dst").distinct().repartition("src"), "edges")
    latest = stored(seeds.select("node", F.lit(0).cast("bigint").alias("depth")).distinct(), "reach")
    known = latest
    depth = 0
    while (max_rounds is None or depth < max_rounds) and not latest.isEmpty():
        depth += 1
        targets = (
            edges.join(latest.select(F.col("node").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        latest = stored(
            targets.join(known.select("node"), "node", "left_anti").withColumn(
                "depth", F.lit(depth).cast("bigint")
            ),
            "reach",
        )
        known = known.unionByName(latest)
        if depth % 8 == 0:
            known = stored(known, "reach")
    return known


def update_reach(
    known: DataFrame, links: DataFrame, new_links: DataFrame | None = None, new_seeds: DataFrame | None = None
) -> DataFrame:
    """``known`` (node, depth) brought up to date for added links (src, dst) and seeds (node), semi-naively.

    ``links`` holds all links, the added ones included. Only changes travel: the added seeds at depth 0
    and the targets of added links from reached sources are candidates; each round keeps the candidates
    that lower a depth or reach a new node, and sends only those over the links. Depths only fall when
    links and seeds are added, so the result equals a run of ``reachable`` from all seeds over all links.
    """
    spark = known.sparkSession
    empty = spark.createDataFrame([], "node string, depth bigint").select(
        F.col("node").cast(known.schema["node"].dataType), "depth"
    )
    edges = stored(links.select("src", "dst").distinct(), "edges")
    known = stored(known.select("node", F.col("depth").cast("bigint")), "reach")
    cand = empty
    if new_seeds is not None:
        cand = cand.unionByName(new_seeds.select("node", F.lit(0).cast("bigint").alias("depth")))
    if new_links is not None:
        reached = new_links.select("src", "dst").join(known.select(F.col("node").alias("src"), "depth"), "src")
        cand = cand.unionByName(reached.select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")))
    while True:
        best = cand.groupBy("node").agg(F.min("depth").alias("depth"))
        better = best.join(known.select("node", F.col("depth").alias("_old")), "node", "left").where(
            F.col("_old").isNull() | (F.col("depth") < F.col("_old"))
        ).select("node", "depth")
        better = stored(better, "reach-better")
        if better.isEmpty():
            return known
        before = known
        known = stored(known.join(better.select("node"), "node", "left_anti").unionByName(better), "reach")
        discard(before)
        cand = edges.join(better.select(F.col("node").alias("src"), "depth"), "src").select(
            F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")
        )
