"""Operators put together: what to crawl next, and one whole round of a crawl."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.config import CrawlConfig
from crawlframe.functions import urls
from crawlframe.operators import frontier as fr
from crawlframe.operators.fetchlog import redirect_target, status_route
from crawlframe.operators.pages import language_gate, link_sets
from crawlframe.operators.robots import robots_allow, robots_outcome, rule_sets
from crawlframe.session import stored


def next_sites(
    pages: DataFrame, site_state: DataFrame, active: DataFrame, config: CrawlConfig = CrawlConfig()
) -> DataFrame:
    """Which sites to crawl next, from the links on fetched pages."""
    waiting = fr.to_frontier(link_sets(pages, suffixes=config.ignored_suffixes))
    return fr.select_sites(waiting, site_state, active, config.concurrency)


def site_admission(
    candidates: DataFrame, rules: DataFrame, fetched: DataFrame, config: CrawlConfig = CrawlConfig()
) -> DataFrame:
    """A site's own test of (site, uri) rows: permitted by robots, not handled yet, suffix wanted."""
    wanted = candidates.filter(urls.suffix_filter(urls.path("uri"), config.ignored_suffixes))
    return fr.drop_viewed(robots_allow(wanted, rules), fetched)


def redirect_links(fetch_log: DataFrame) -> DataFrame:
    """Targets of the log's redirects (site, uri, queue), each once.

    ``queue`` tells whether a target stays with the site that named it or goes to the
    frontier.
    """
    moved = fetch_log.filter(status_route(F.col("status"), F.col("location")) == "redirect")
    found = redirect_target(moved.select("uri", "location"), base="uri").filter("target IS NOT NULL")
    return found.select(urls.site_key("target").alias("site"), F.col("target").alias("uri"), "queue").distinct()


@dataclass(frozen=True)
class Round:
    """What one round leaves behind.

    ``skipped`` are selected sites (site, kind) that fetch nothing: events for ``site_weight``.
    """

    frontier: DataFrame
    admitted: DataFrame
    selected: DataFrame
    schedule: DataFrame
    skipped: DataFrame


def crawl_round(
    pages: DataFrame,
    lang: Column,
    robots_log: DataFrame,
    fetched: DataFrame,
    frontier: DataFrame,
    active: DataFrame,
    site_state: DataFrame,
    config: CrawlConfig = CrawlConfig(),
) -> Round:
    """From fetched pages (page_id, url, html) to the next fetch schedule.

    Gate, links, robots, handled paths, admission, site choice, then each chosen site's own
    test of its whole queue, schedule. Only sites whose robots.txt is settled are fetched
    from. A site that it closes, or whose answer cannot be had, is skipped and its queue
    dropped; a site that still follows a redirect, or has no answer yet, stays in the frontier. The
    new frontier is read several times and so written once to the shared folder.
    """
    gate = language_gate(lang, urls.path("url"), config.target_lang)
    links = link_sets(pages, gate=gate, suffixes=config.ignored_suffixes)
    outcome = robots_outcome(
        robots_log, config.agent, config.default_wait_s, config.reconnect_above_s, config.skip_above_s, config.max_hops
    )
    rules = rule_sets(robots_log.filter("status = 200"), config.agent)
    fresh = site_admission(fr.to_frontier(links), rules, fetched, config)
    admitted = stored(
        fr.frontier_admit(fresh, frontier, active, site_state, config.block_weight), "admitted"
    )
    waiting = stored(
        fr.merge_frontiers(frontier, admitted.filter("dest = 'pending'")), "frontier"
    )
    selected = stored(fr.select_sites(waiting, site_state, active, config.concurrency), "selected")
    settled = stored(selected.select("site").join(outcome, "site", "left"), "settled")
    ready = settled.filter(F.col("outcome").isin("rules", "allow_all"))
    skipped = settled.filter(F.col("outcome").isin("skip", "redirect_overflow"))
    queue = site_admission(fr.fetch_list(ready, waiting), rules, fetched, config)
    schedule = fr.politeness_schedule(queue, outcome, config.default_wait_s, config.throttle_s)
    left = fr.remaining_frontier(ready.select("site").union(skipped.select("site")), waiting)
    return Round(left, admitted, selected, schedule, skipped.select("site", F.lit("skipped").alias("kind")))
