"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sql import ROUND_LANG, SUFFIX_PATTERN, encoded, path_of, robots_chain_sql, site_of, sql
from checks.views import SITE, table, view
from crawlframe.config import CrawlConfig
from crawlframe.functions import headers, markup, urls
from crawlframe.operators import fetchlog, frontier, graph, language, pages, robots, sieve
from crawlframe.operators.archive import byte_batches
from crawlframe.plans import crawl
from crawlframe.session import configure, spread, stored, work_path
from crawlframe.sinks.writers import write_html_archive, write_uri_log
from crawlframe.sources import readers
from crawlframe.streaming import jobs, sites

CONFIG = CrawlConfig(target_lang=ROUND_LANG, concurrency=25)
LANGUAGES = ("de", "en", "es", "fr")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[build.__name__] = run
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return register


# Inputs shared by several queries


def page_table(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet")


def page_bodies(spark, sf):
    return readers.read_pages(spark, f"{sf}/pages.parquet", use_all_cores=True)


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def page_links(spark, sf):
    return pages.extract_links(page_bodies(spark, sf))


def link_frontier(spark, sf):
    return frontier.to_frontier(pages.link_sets(page_bodies(spark, sf)))


def waiting(spark, sf):
    return view(spark, sf, "waiting_v")


def weights(spark, sf):
    return frontier.site_weight(view(spark, sf, "page_events_v"))


def everything(spark, sf):
    return frontier.merge_frontiers(waiting(spark, sf), link_frontier(spark, sf))


def no_sites(spark):
    return spark.createDataFrame([], "site string, weight bigint")


def active(spark, sf):
    """The five sites an earlier round picked."""
    nothing = no_sites(spark)
    return frontier.select_sites(waiting(spark, sf), nothing, nothing, 5).select("site")


def robots_docs(spark, sf):
    return view(spark, sf, "robots_log_v").filter("status = 200").select("site", "body")


# Sources


@query("SELECT trim(url) AS value FROM pages")
def load_seeds(spark, sf):
    folder = work_path(spark, "seeds")
    page_table(spark, sf).select("url").write.text(folder)
    return readers.load_seeds(spark, [f"{folder}/part-*"])


@query("SELECT page_id, url, octet_length(encode(html)) AS read_bytes FROM pages")
def read_pages(spark, sf):
    return page_table(spark, sf).select("page_id", "url", F.octet_length("html").cast("bigint").alias("read_bytes"))


@query(sql("SELECT event_id, epoch_us(ts) AS ts_us, site, uri, status, bytes FROM fetch_log_v", "fetch_log_v"))
def read_fetch_log(spark, sf):
    folder = work_path(spark, "fetch-log")
    view(spark, sf, "fetch_log_v").write.parquet(folder)
    log = readers.read_fetch_log(spark, folder)
    return log.select("event_id", F.unix_micros("ts").alias("ts_us"), "site", "uri", "status", "bytes")


@query("SELECT url, md5(html) AS digest FROM pages")
def read_html_archive(spark, sf):
    folder = work_path(spark, "archive")
    write_html_archive(page_table(spark, sf), folder, max_bytes=100_000)
    return readers.read_html_archive(spark, folder).select("url", F.md5("html").alias("digest"))


# Projections, filters, predicates


@query(sql(
    f"SELECT page_id, href, {site_of('url')} AS page_site, CASE WHEN regexp_matches(href, '^[a-z]+://[^/]') THEN "
    f"replace(lower({site_of('href')}), ':80/', '/') END AS href_site FROM (SELECT page_id, base AS url, href "
    "FROM hrefs_v)", "hrefs_v"))
def site_key(spark, sf):
    rows = view(spark, sf, "hrefs_v")
    return rows.select("page_id", "href", urls.site_key("base").alias("page_site"), urls.site_key("href").alias("href_site"))


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS uri FROM pages")
def strip_fragment(spark, sf):
    return page_table(spark, sf).select("page_id", urls.strip_fragment("url").alias("uri"))


@query(sql(
    "SELECT page_id, href, NOT regexp_matches(regexp_extract(regexp_replace(href, '[?#].*$', ''), '([^/]*)$', 1), "
    f"'{SUFFIX_PATTERN}') AS kept FROM hrefs_v", "hrefs_v"))
def suffix_filter(spark, sf):
    path = F.regexp_extract("href", r"^([^?#]*)", 1)
    return view(spark, sf, "hrefs_v").select("page_id", "href", urls.suffix_filter(path).alias("kept"))


@query(sql(
    "SELECT page_id, href FROM hrefs_v WHERE NOT starts_with(lower(href), 'javascript:') "
    "AND NOT starts_with(lower(href), 'mailto:')", "hrefs_v"))
def href_scheme_filter(spark, sf):
    return view(spark, sf, "hrefs_v").select("page_id", "href").filter(urls.href_scheme_filter("href"))


@query(sql(
    "SELECT page_id, href, lower(split_part(href, ':', 1)) IN ('http', 'https') AS fetchable FROM hrefs_v", "hrefs_v"))
def fetchable_scheme(spark, sf):
    return view(spark, sf, "hrefs_v").select("page_id", "href", urls.fetchable_scheme("href").alias("fetchable"))


@query(sql(
    "SELECT page_id, CASE WHEN regexp_matches(coalesce(content_type, ''), '^(text/xml|application/(xhtml[+])?xml)') "
    "THEN 'xml' ELSE 'html' END AS kind FROM headers_v", "headers_v"))
def parser_kind(spark, sf):
    return view(spark, sf, "headers_v").select("page_id", headers.parser_kind("content_type").alias("kind"))


@query(sql(
    "SELECT page_id, CASE WHEN contains(content_type, 'charset=') THEN split_part(content_type, 'charset=', 2) END "
    "AS charset FROM headers_v", "headers_v"))
def charset_of(spark, sf):
    return view(spark, sf, "headers_v").select("page_id", headers.charset_of("content_type").alias("charset"))


@query("SELECT page_id, octet_length(encode(html)) AS read_bytes, octet_length(encode(html)) > 3000 AS too_large FROM pages")
def body_size_cap(spark, sf):
    sized = pages.with_body_size(page_table(spark, sf), cap=3000)
    return sized.select("page_id", "read_bytes", "too_large")


@query(sql(
    "SELECT event_id, status, CASE WHEN status = 200 THEN 'document' WHEN status BETWEEN 300 AND 399 AND location "
    "IS NOT NULL THEN 'redirect' ELSE 'drop' END AS route FROM fetch_log_v", "fetch_log_v"))
def status_route(spark, sf):
    route = fetchlog.status_route(F.col("status"), F.col("location"))
    return view(spark, sf, "fetch_log_v").select("event_id", "status", route.alias("route"))


@query(sql(
    "SELECT page_id, CASE page_id % 15 WHEN 0 THEN o || href WHEN 1 THEN o || href WHEN 2 THEN o || href "
    "WHEN 5 THEN regexp_extract(base, '^([a-z]+:)', 1) || href WHEN 6 THEN regexp_replace(b, '[?].*$', '') || href "
    "WHEN 7 THEN b WHEN 10 THEN b WHEN 8 THEN replace(href, '#s', '') WHEN 9 THEN href "
    "WHEN 14 THEN 'http://example.net/k' || page_id END AS target, CASE WHEN page_id % 15 IN (0, 1, 2, 6, 7, 10) "
    "THEN 'site' WHEN page_id % 15 IN (5, 8, 9, 14) THEN 'frontier' END AS queue FROM (SELECT *, "
    "regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) AS o, regexp_replace(base, '#.*$', '') AS b FROM hrefs_v)",
    "hrefs_v"))
def redirect_target(spark, sf):
    rows = view(spark, sf, "hrefs_v")
    return fetchlog.redirect_target(rows, location="href").select("page_id", "target", "queue")


@query(sql(
    f"SELECT page_id, lang, coalesce(lang = 'en', false) OR {path_of('url')} = '/' AS links, "
    "lang = 'en' AS archived FROM page_lang", "page_lang"))
def language_gate(spark, sf):
    rows = page_table(spark, sf).select("page_id", "url", markup.page_lang(F.col("html")).alias("lang"))
    gate = pages.language_gate(F.col("lang"), urls.path("url"), "en")
    return rows.select("page_id", "lang", gate.alias("links"), pages.archive_gate(F.col("lang"), "en").alias("archived"))


@query(sql("SELECT page_id, dst_url, rtrim(dst_site, '/') || raw_href AS readable FROM links", "links"))
def human_url(spark, sf):
    return page_links(spark, sf).select("page_id", "dst_url", urls.human_url("dst_url").alias("readable"))


# Page jobs


@query(
    "SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), "
    "'\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS declared_lang, true AS ok, "
    "len(regexp_extract_all(html, '<a href=\"')) AS anchors, md5(trim(regexp_replace(replace(replace(replace(replace("
    "replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '</?(a|b)( [^>]*)?>', '', 'g'), '<[^>]*>', "
    "' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g'))) "
    "AS text_digest FROM pages")
def parse_pages(spark, sf):
    parsed = pages.parse_pages(page_bodies(spark, sf))
    return parsed.select(
        "page_id", "title", "declared_lang", "ok", F.size("hrefs").cast("bigint").alias("anchors"),
        F.md5("text").alias("text_digest"))


@query("SELECT page_id, md5(html) AS digest FROM pages")
def decode_body(spark, sf):
    lang = markup.page_lang(F.col("html"))
    charset = F.when(lang == "de", F.lit("UTF-16LE")).when(lang == "fr", F.lit("UTF-16BE")).when(lang == "en", F.lit("UTF-8"))
    raw = page_bodies(spark, sf).select(
        "page_id", charset.alias("charset"),
        F.when(lang == "de", F.encode("html", "UTF-16LE")).when(lang == "fr", F.encode("html", "UTF-16BE"))
        .otherwise(F.encode("html", "UTF-8")).alias("body"))
    return raw.select("page_id", F.md5(markup.decode_body("body", "charset")).alias("digest"))


@query(sql("SELECT page_id, src_url, raw_href, dst_url, dst_site FROM links", "links"))
def extract_links(spark, sf):
    return page_links(spark, sf)


@query(sql("SELECT page_id, src_url, raw_href, dst_url, dst_site FROM links", "links"))
def extract_links_parsed(spark, sf):
    parsed = pages.parse_pages(page_bodies(spark, sf))
    return pages.parsed_links(parsed).filter("reject_reason IS NULL").drop("reject_reason")


RESOLVED = (
    "SELECT page_id, href, CASE WHEN page_id % 15 IN (1) THEN o || href "
    "WHEN page_id % 15 = 5 THEN regexp_extract(base, '^([a-z]+:)', 1) || href "
    "WHEN page_id % 15 = 6 THEN regexp_replace(b, '[?].*$', '') || href WHEN page_id % 15 IN (7, 10) THEN b "
    "WHEN page_id % 15 = 8 THEN replace(href, '#s', '') WHEN page_id % 15 = 9 THEN href "
    "WHEN page_id % 15 = 14 THEN 'http://example.net/k' || page_id END AS dst_url, CASE page_id % 15 "
    "WHEN 0 THEN 'suffix' WHEN 2 THEN 'suffix' WHEN 3 THEN 'scheme' WHEN 4 THEN 'scheme' WHEN 11 THEN 'no_host' "
    "WHEN 12 THEN 'bad_port' WHEN 13 THEN 'bad_host' END AS reject_reason FROM (SELECT *, "
    "regexp_extract(base, '^([a-z]+://[^/?#]+)', 1) AS o, regexp_replace(base, '#.*$', '') AS b FROM hrefs_v)"
)


@query(sql(RESOLVED, "hrefs_v"))
def resolve_links(spark, sf):
    return pages.resolve_links(view(spark, sf, "hrefs_v")).select(
        "page_id", F.col("raw_href").alias("href"), "dst_url", "reject_reason")


@query(sql("SELECT DISTINCT page_id, dst_url, dst_site FROM links", "links"))
def dedup_links(spark, sf):
    return pages.dedup_links(page_links(spark, sf))


@query(sql("SELECT DISTINCT page_id, dst_url, dst_site FROM links", "links"))
def link_sets(spark, sf):
    return pages.link_sets(page_bodies(spark, sf))


@query(sql(
    f"SELECT reject_reason, count(*) AS links FROM ({RESOLVED}) WHERE reject_reason IN "
    "('no_host', 'bad_port', 'bad_host') GROUP BY reject_reason", "hrefs_v"))
def invalid_links(spark, sf):
    return pages.rejects_by_reason(pages.invalid_links(pages.resolve_links(view(spark, sf, "hrefs_v"))))


def _script_sql() -> str:
    rest = "regexp_replace(text, '[\\p{Latin}\\p{Common}\\p{Inherited}]', '', 'g')"
    count = lambda s: f"(length(text) - length(regexp_replace(text, '\\p{{{s}}}', '', 'g')))"
    share = lambda s: f"CASE WHEN {count(s)} > 0 AND {count(s)} / (latin + rest) < 0.02 THEN '\\p{{{s}}}' ELSE '' END"
    removed = " || ".join(share(s) for s in language.SCRIPTS)
    return (
        "SELECT doc_id, md5(CASE WHEN p = '' THEN text ELSE regexp_replace(text, '[' || p || ']', '', 'g') END) AS digest, "
        "length(p) > 0 AS changed FROM (SELECT doc_id, text, CASE WHEN rest = 0 THEN '' ELSE " + removed + " END AS p "
        f"FROM (SELECT doc_id, text, {count('Latin')} AS latin, length({rest}) AS rest FROM mixed_v))"
    )


@query(sql(_script_sql(), "mixed_v"))
def script_filter(spark, sf):
    kept = language.script_filter(spread(view(spark, sf, "mixed_v")))
    return kept.select("doc_id", F.md5("text").alias("digest"), (F.col("scripts_removed") > 0).alias("changed"))


@query(sql("SELECT lang, gram, weight FROM profiles", "profiles"))
def train_lang_profiles(spark, sf):
    return language.train_lang_profiles(documents(spark, sf))


def _detect_sql() -> str:
    names = ", ".join(f"sum(n * coalesce({l}, {language.UNSEEN})) AS {l}" for l in LANGUAGES)
    wide = ", ".join(f"max(CASE WHEN lang = '{l}' THEN weight END) AS {l}" for l in LANGUAGES)
    best = f"greatest({', '.join(LANGUAGES)})"
    odds = " + ".join(f"exp(({l} - {best}) / 10000.0::DOUBLE)" for l in LANGUAGES)
    pick = " ".join(f"WHEN {l} = {best} THEN '{l}'" for l in LANGUAGES)
    return sql(
        f"SELECT doc_id, CASE WHEN c >= 0.7 THEN l END AS lang, c AS confidence FROM (SELECT doc_id, CASE {pick} END AS l, "
        f"round(1.0 / ({odds}), 6) AS c FROM (SELECT doc_id, {names} FROM gram_counts g LEFT JOIN "
        f"(SELECT gram, {wide} FROM profiles GROUP BY gram) w ON g.gram = w.gram GROUP BY doc_id))", "gram_counts", "profiles")


@query(_detect_sql())
def detect_language(spark, sf):
    docs = documents(spark, sf)
    profiles = stored(language.train_lang_profiles(docs), "profiles")
    return language.detect_language(docs.select("doc_id", "text"), profiles, LANGUAGES)


# Robots and joins


@query(sql("SELECT site, rule_no, allow, pattern FROM rules", "rules"))
def robots_rules(spark, sf):
    return robots.robots_rules(robots_docs(spark, sf), CONFIG.agent)


@query(sql("SELECT site, delay_s, allow_none, rules FROM meta", "meta"))
def robots_meta(spark, sf):
    return robots.robots_meta(robots_docs(spark, sf), CONFIG.agent)


@query(sql("SELECT site, uri FROM permitted", "permitted"))
def robots_allow(spark, sf):
    return robots.robots_allow(everything(spark, sf), robots.rule_sets(robots_docs(spark, sf), CONFIG.agent))


@query(sql("SELECT site, outcome, wait_s, reconnect FROM outcome", "outcome"))
def robots_outcome(spark, sf):
    return robots.robots_outcome(view(spark, sf, "robots_log_v"), CONFIG.agent)


@query(ORACLES["robots_allow"])
def robots_allow_indexed(spark, sf):
    """``robots_allow`` by a prefix table of the rules."""
    sets = robots.rule_sets(robots_docs(spark, sf), CONFIG.agent)
    return robots.robots_decisions_indexed(everything(spark, sf), sets).filter("allowed").drop("allowed")


@query(robots_chain_sql("SELECT site, status, location, hops, looped, body FROM robots_log_v", "robots_log_v"))
def robots_chains(spark, sf):
    return robots.robots_chains(view(spark, sf, "robots_fetches_v"))


@query(robots_chain_sql("SELECT site, outcome, wait_s, reconnect FROM outcome", "outcome"))
def robots_chain_outcome(spark, sf):
    return robots.robots_outcome(robots.robots_chains(view(spark, sf, "robots_fetches_v")), CONFIG.agent)


@query(sql(
    "SELECT a.site, a.location AS robots_uri, b.body FROM robots_log_v a JOIN robots_log_v b ON a.location = b.uri "
    "WHERE a.status // 100 = 3 AND b.status = 200 AND a.site <> b.site", "robots_log_v"))
def robots_cross_domain(spark, sf):
    return robots.robots_cross_domain(view(spark, sf, "robots_log_v"))


def _candidates(spark, sf):
    again = waiting(spark, sf).withColumn("uri", F.concat(F.regexp_extract("uri", r"^([^?#]*)", 1), F.lit("?again=1")))
    return frontier.merge_frontiers(frontier.merge_frontiers(everything(spark, sf), again), waiting(spark, sf))


def _handled(spark, sf):
    done = page_table(spark, sf).filter(markup.page_lang(F.col("html")) == "en")
    return done.select(urls.site_key("url").alias("site"), urls.strip_fragment("url").alias("uri"))


_CANDIDATES = (
    "(SELECT * FROM everything UNION SELECT site, regexp_replace(uri, '[?].*$', '') || '?again=1' FROM waiting_v) c"
)
_HANDLED = f"(SELECT {SITE} AS site, regexp_replace(url, '#.*$', '') AS uri FROM page_lang WHERE lang = 'en') h"


@query(sql(
    f"SELECT site, uri FROM {_CANDIDATES} WHERE NOT EXISTS (SELECT 1 FROM {_HANDLED} WHERE h.site = c.site "
    f"AND {path_of('h.uri')} = {path_of('c.uri')})", "everything", "page_lang"))
def drop_viewed(spark, sf):
    return frontier.drop_viewed(_candidates(spark, sf), _handled(spark, sf))


@query(sql(
    f"SELECT site, uri FROM {_CANDIDATES} WHERE uri NOT IN (SELECT h.uri FROM {_HANDLED})", "everything", "page_lang"))
def drop_viewed_uri(spark, sf):
    return frontier.drop_viewed(_candidates(spark, sf), _handled(spark, sf), key="uri")


@query(ORACLES["drop_viewed"])
def drop_viewed_sieved(spark, sf):
    """``drop_viewed`` behind a blocked Bloom filter of the handled paths; only its hits are checked exactly."""
    handled = stored(_handled(spark, sf), "handled")
    blocks = sieve.blocks_for(handled.count())
    filters = stored(sieve.build(handled, blocks), "sieve")
    return sieve.sieve(_candidates(spark, sf), filters, handled, blocks).select("site", "uri")


def _fresh(spark, sf):
    """Links, the pages' own URLs, and every site's root."""
    known = everything(spark, sf)
    return known.unionByName(known.select("site", F.col("site").alias("uri")))


_FRESH = "(SELECT * FROM everything UNION SELECT site, site FROM everything) n"


@query(sql(
    f"SELECT n.site, n.uri, CASE WHEN n.site IN (SELECT site FROM active) THEN 'active' ELSE 'pending' END AS dest "
    f"FROM {_FRESH} WHERE n.uri NOT IN (SELECT site FROM weights WHERE weight >= 100) AND (n.site IN (SELECT site "
    "FROM active) OR n.uri NOT IN (SELECT uri FROM waiting_v))", "everything", "active", "weights", "waiting_v"))
def frontier_admit(spark, sf):
    return frontier.frontier_admit(
        _fresh(spark, sf), waiting(spark, sf), active(spark, sf), stored(weights(spark, sf), "weights"))


@query(sql(
    f"SELECT n.site, n.uri, CASE WHEN n.site IN (SELECT site FROM active) THEN 'active' ELSE 'pending' END AS dest "
    f"FROM {_FRESH} WHERE n.site NOT IN (SELECT site FROM weights WHERE weight >= 100) AND (n.site IN (SELECT site "
    "FROM active) OR n.uri NOT IN (SELECT uri FROM waiting_v))", "everything", "active", "weights", "waiting_v"))
def frontier_admit_block_site(spark, sf):
    return frontier.frontier_admit(
        _fresh(spark, sf), waiting(spark, sf), active(spark, sf), stored(weights(spark, sf), "weights"), block_site=True)


_WALK = (
    "/*RECURSE*/, walk AS (SELECT src, dst AS node, 1 AS hops, [src, dst] AS seen, src = dst AS looped FROM redirects_v "
    "UNION ALL SELECT w.src, e.dst, w.hops + 1, list_append(w.seen, e.dst), list_contains(w.seen, e.dst) "
    "FROM walk w JOIN redirects_v e ON w.node = e.src WHERE NOT w.looped AND w.hops < 11) "
)


@query(sql(
    _WALK + "SELECT src, CASE WHEN NOT looped AND hops <= 10 THEN node END AS target, CASE WHEN NOT looped AND hops <= 10 "
    "THEN CAST(hops AS BIGINT) END AS hops, CASE WHEN looped THEN 'loop' WHEN hops > 10 THEN 'too_many' ELSE 'final' "
    "END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY hops DESC) AS r FROM walk) WHERE r = 1",
    "redirects_v"))
def resolve_redirects(spark, sf):
    return graph.resolve_redirects(view(spark, sf, "redirects_v"))


@query(sql(
    "/*RECURSE*/, reach AS (SELECT CAST(n AS BIGINT) AS node FROM (VALUES (0), (1)) t(n) UNION SELECT e.dst FROM reach r "
    "JOIN graph_v e ON r.node = e.src) SELECT node FROM reach", "graph_v"))
def reachable(spark, sf):
    seeds = spark.createDataFrame([(0,), (1,)], "node bigint")
    return graph.reachable(seeds, view(spark, sf, "graph_v")).select("node")


# Aggregations


@query(sql("SELECT site, count(DISTINCT uri) AS pending FROM everything GROUP BY site", "everything"))
def pending_by_site(spark, sf):
    return frontier.pending_by_site(everything(spark, sf))


@query(sql(
    "SELECT e.site, CAST(max(CASE WHEN l.at IS NULL THEN 0 ELSE 100 END) + 20 * count_if(e.kind = 'completed' AND "
    "(l.at IS NULL OR e.seq > l.at)) AS BIGINT) AS weight FROM site_events_v e LEFT JOIN (SELECT site, max(seq) AS at "
    "FROM site_events_v WHERE kind = 'skipped' GROUP BY site) l ON e.site = l.site GROUP BY e.site", "site_events_v"))
def site_weight(spark, sf):
    return frontier.site_weight(view(spark, sf, "site_events_v"))


@query(sql(
    "SELECT (SELECT count(*) FROM active) AS active_sites, count(DISTINCT uri) AS pending_links, "
    "count(DISTINCT site) AS pending_sites FROM everything", "everything", "active"))
def crawl_gauge(spark, sf):
    return frontier.crawl_gauge(active(spark, sf), everything(spark, sf))


_THROUGHPUT = sql(
    "SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS docs, "
    "CAST(sum(bytes) AS BIGINT) AS bytes FROM fetch_log_v WHERE status = 200 GROUP BY 1", "fetch_log_v")


@query(_THROUGHPUT)
def throughput_report(spark, sf):
    return fetchlog.throughput_report(view(spark, sf, "fetch_log_v").filter("status = 200"))


@query(sql(
    "SELECT s.i * 5000000 AS start_us, coalesce(c.docs, 0) AS docs, coalesce(c.bytes, 0) AS bytes FROM "
    "(SELECT unnest(range(min(i), max(i) + 1)) AS i FROM (SELECT epoch_us(ts) // 5000000 AS i FROM fetch_log_v "
    "WHERE status = 200)) s LEFT JOIN (SELECT epoch_us(ts) // 5000000 AS i, count(*) AS docs, CAST(coalesce(sum(bytes), 0) "
    "AS BIGINT) AS bytes FROM fetch_log_v WHERE status = 200 GROUP BY 1) c ON c.i = s.i", "fetch_log_v"))
def throughput_filled(spark, sf):
    return fetchlog.throughput_filled(view(spark, sf, "fetch_log_v").filter("status = 200"), every_s=5)


@query(sql(f"SELECT DISTINCT site, {path_of('uri')} AS path FROM fetch_log_v", "fetch_log_v"))
def viewed_paths(spark, sf):
    return fetchlog.viewed_paths(view(spark, sf, "fetch_log_v"))


# Windows


@query(sql(
    "SELECT e.site, e.uri, CAST(row_number() OVER (PARTITION BY e.site ORDER BY md5(e.uri), e.uri) AS BIGINT) AS rn, "
    "coalesce(o.wait_s, 5.0) AS wait_s, (row_number() OVER (PARTITION BY e.site ORDER BY md5(e.uri), e.uri) - 1) * "
    "(CAST(round(greatest(5.0, coalesce(o.wait_s, 5.0)) * 1000) AS BIGINT) + 199) + CAST(concat('0x', "
    "substr(md5(e.uri), 1, 6)) AS BIGINT) % 200 AS offset_ms FROM everything e LEFT JOIN "
    "outcome o ON e.site = o.site", "everything", "outcome"))
def politeness_schedule(spark, sf):
    waits = robots.robots_outcome(view(spark, sf, "robots_log_v"), CONFIG.agent)
    return frontier.politeness_schedule(everything(spark, sf), waits, jitter_ms=200)


@query(sql(
    "SELECT event_id, uri, kind, CAST(failures AS BIGINT) AS failures, CASE WHEN kind = 'ok' THEN 'done' WHEN kind = "
    "'too_large' OR failures % 3 = 0 THEN 'give_up' ELSE 'retry' END AS decision FROM (SELECT *, sum(f) OVER (PARTITION "
    "BY uri, run ORDER BY ts, event_id) AS failures FROM (SELECT *, CASE WHEN kind IN ('ok', 'too_large') THEN 0 ELSE 1 "
    "END AS f, sum(CASE WHEN kind IN ('ok', 'too_large') THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY ts, event_id) "
    "- CASE WHEN kind IN ('ok', 'too_large') THEN 1 ELSE 0 END AS run FROM attempts_v))", "attempts_v"))
def retry_decision(spark, sf):
    return fetchlog.retry_decision(view(spark, sf, "attempts_v")).select(
        "event_id", "uri", "kind", "failures", "decision")


@query(sql(
    "SELECT site, from_us, to_us, CASE WHEN look < until THEN look END AS redriven_us FROM (SELECT *, base + 300000000 * "
    "greatest(CAST(floor((from_us + 600000000 - base) / 300000000) AS BIGINT) + 1, 0) AS look FROM (SELECT site, from_us, "
    "to_us, coalesce(to_us, last) AS until, start + 900000000 AS base FROM (SELECT site, epoch_us(ts) AS from_us, "
    "epoch_us(lead(ts) OVER (PARTITION BY site ORDER BY ts)) AS to_us, epoch_us(min(ts) OVER (PARTITION BY site)) AS "
    "start, epoch_us(max(ts) OVER ()) AS last FROM fetch_log_v)) WHERE until - from_us > 600000000)", "fetch_log_v"))
def stale_sites(spark, sf):
    return fetchlog.stale_sites(view(spark, sf, "fetch_log_v"))


_SESSIONS = (
    "SELECT site, min(us) AS first_us, max(us) AS last_us, count(*) AS requests{more} FROM (SELECT *, sum(brk) OVER "
    "(PARTITION BY site ORDER BY us, event_id) AS run FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY site "
    "ORDER BY us, event_id) > 36000000000 THEN 1 ELSE 0 END AS brk FROM (SELECT *, epoch_us(ts) AS us FROM "
    "fetch_log_v))) GROUP BY site, run"
)


@query(sql(_SESSIONS.format(more=""), "fetch_log_v"))
def site_sessions(spark, sf):
    return fetchlog.site_sessions(view(spark, sf, "fetch_log_v"), gap="10 hours")


@query(sql(
    "SELECT event_id, n AS line_no, (n - 1) // 1000 AS batch FROM (SELECT event_id, row_number() OVER "
    "(ORDER BY ts, event_id) AS n FROM fetch_log_v)", "fetch_log_v"))
def uri_batches(spark, sf):
    return fetchlog.uri_batches(view(spark, sf, "fetch_log_v"), 1000).select("event_id", "line_no", "batch")


_SHARDS = (
    "/*RECURSE*/, docs AS (SELECT page_id, octet_length(encode(html)) AS size, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) "
    "AS shard FROM pages), lined AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY page_id) AS n FROM docs), "
    "rolled AS (SELECT page_id, shard, n, size AS counted, CAST(0 AS BIGINT) AS batch FROM lined WHERE n = 1 UNION ALL "
    "SELECT l.page_id, l.shard, l.n, CASE WHEN r.counted >= 20000 THEN 0 ELSE r.counted + l.size END, CASE WHEN "
    "r.counted >= 20000 THEN r.batch + 1 ELSE r.batch END FROM rolled r JOIN lined l ON r.shard = l.shard AND "
    "l.n = r.n + 1) "
)


@query(sql(_SHARDS.replace("/*RECURSE*/, ", "WITH RECURSIVE ", 1) + "SELECT page_id, shard, batch FROM rolled"))
def byte_batches_(spark, sf):
    sized = page_table(spark, sf).select("page_id", F.octet_length("html").cast("bigint").alias("read_bytes"))
    return byte_batches(sized, 20_000, digits=1).select("page_id", "shard", "batch")


# Top-k


@query(sql("SELECT site, pending, weight, score, CAST(rank AS BIGINT) AS rank FROM selected", "selected"))
def select_sites(spark, sf):
    return frontier.select_sites(everything(spark, sf), weights(spark, sf), active(spark, sf), CONFIG.concurrency)


@query(sql(
    "SELECT site, uri, site IN (SELECT site FROM selected) AS launched FROM everything", "everything", "selected"))
def launch_fetch_list(spark, sf):
    known = stored(everything(spark, sf), "frontier")
    chosen = stored(frontier.select_sites(known, weights(spark, sf), active(spark, sf), CONFIG.concurrency), "selected")
    taken = frontier.fetch_list(chosen, known).withColumn("launched", F.lit(True))
    return taken.unionByName(frontier.remaining_frontier(chosen, known).withColumn("launched", F.lit(False)))


@query(sql(
    "SELECT site, CAST(pending AS BIGINT) AS pending, CAST(row_number() OVER (ORDER BY pending - weight DESC, site) AS "
    "BIGINT) AS rank FROM (SELECT f.site, count(*) AS pending, coalesce(any_value(w.weight), 0) AS weight FROM "
    "link_frontier f LEFT JOIN weights w ON f.site = w.site GROUP BY f.site) ORDER BY pending - weight DESC, site LIMIT 25",
    "link_frontier", "weights"))
def next_sites_(spark, sf):
    chosen = crawl.next_sites(page_bodies(spark, sf), weights(spark, sf), no_sites(spark), CONFIG)
    return chosen.select("site", "pending", "rank")


# Set operations


@query("SELECT url AS value FROM pages UNION ALL SELECT DISTINCT url FROM pages")
def merge_seeds(spark, sf):
    lines = page_table(spark, sf).select(F.col("url").alias("value"))
    return frontier.merge_seeds(lines, lines.distinct())


@query(sql("SELECT site, uri FROM everything", "everything"))
def merge_frontiers(spark, sf):
    return frontier.merge_frontiers(waiting(spark, sf), link_frontier(spark, sf))


# Sinks


@query(sql("SELECT uri AS url, status FROM fetch_log_v", "fetch_log_v"))
def write_uri_log_(spark, sf):
    folder = work_path(spark, "uri-log")
    write_uri_log(view(spark, sf, "fetch_log_v"), folder, lines=5000, exact=True)
    return readers.read_uri_log(spark, folder)


@query(sql("SELECT url, md5(html) AS digest FROM page_lang WHERE lang = 'en'", "page_lang"))
def write_html_archive_(spark, sf):
    folder = work_path(spark, "archive")
    docs = page_table(spark, sf).withColumn("lang", markup.page_lang(F.col("html")))
    write_html_archive(docs, folder, max_bytes=100_000, target_lang="en")
    return readers.read_html_archive(spark, folder).select("url", F.md5("html").alias("digest"))


# Streaming


def page_stream(spark, sf):
    # A pattern, since a stream takes no path of a single file; it meets a file and a folder of part files.
    return spark.readStream.schema(readers.PAGES_SCHEMA).parquet(f"{sf}/[p]ages.parquet")


def log_stream(spark, sf):
    """The fetch log, written once and then read as a stream."""
    folder = work_path(spark, "fetch-log")
    view(spark, sf, "fetch_log_v").write.parquet(folder)
    return readers.read_fetch_log(spark, folder, streaming=True)


@query(_THROUGHPUT)
def stream_throughput(spark, sf):
    report = jobs.stream_throughput(log_stream(spark, sf).filter("status = 200"))
    return jobs.run_to_table(report, "throughput", "complete")


@query(sql("SELECT site, uri FROM link_frontier", "link_frontier"))
def stream_frontier(spark, sf):
    links = pages.extract_links(page_stream(spark, sf))
    live = links.select(F.col("dst_site").alias("site"), F.col("dst_url").alias("uri"))
    return jobs.run_to_table(jobs.stream_frontier(live), "frontier")


@query(sql(
    "SELECT 'uri' AS output, regexp_replace(url, '#.*$', '') AS url, '200' AS content FROM page_lang UNION ALL "
    "SELECT 'html', regexp_replace(url, '#.*$', ''), md5(html) FROM page_lang WHERE lang = 'en'", "page_lang"))
def stream_route(spark, sf):
    docs = page_stream(spark, sf).select(
        urls.strip_fragment("url").alias("uri"), F.lit(200).alias("status"), markup.page_lang(F.col("html")).alias("lang"), "html")
    uris, archive, state = (work_path(spark, name) for name in ("route-uris", "route-html", "route-state"))
    jobs.start_route(docs, uris, archive, state, "en").awaitTermination()
    lines = readers.read_uri_log(spark, uris).select(
        F.lit("uri").alias("output"), "url", F.col("status").cast("string").alias("content"))
    kept = readers.read_html_archive(spark, archive).select(
        F.lit("html").alias("output"), "url", F.md5("html").alias("content"))
    return lines.unionByName(kept)


@query(sql(
    _SESSIONS.format(more=", CASE WHEN count_if(uri LIKE '%/robots.txt' AND status = 503) > 0 THEN 'skipped' WHEN "
                     "count_if(uri NOT LIKE '%/robots.txt') = 0 THEN 'robots' ELSE 'completed' END AS state"),
    "fetch_log_v"))
def stream_site_state(spark, sf):
    state = jobs.stream_site_state(log_stream(spark, sf), idle="10 hours")
    return jobs.run_to_table(state, "site-state", "complete")


_RUNS = (
    "WITH r AS (SELECT *, sum(brk) OVER (PARTITION BY site ORDER BY us, event_id) AS run FROM (SELECT *, CASE WHEN us - "
    "lag(us) OVER (PARTITION BY site ORDER BY us, event_id) > 36000000000 THEN 1 ELSE 0 END AS brk FROM (SELECT *, "
    "epoch_us(ts) // 1000 * 1000 AS us, uri LIKE '%/robots.txt' AS robots, CASE WHEN status BETWEEN 300 AND 399 AND location IS "
    "NOT NULL THEN regexp_extract(uri, '^([a-z]+://[^/]+)', 1) || location END AS target FROM fetch_log_v))), "
    "a AS (SELECT site, run, target AS uri, max(us) AS asked FROM r WHERE target IS NOT NULL GROUP BY ALL), "
    "g AS (SELECT site, run, uri, max(us) AS got FROM r GROUP BY ALL), "
    "w AS (SELECT a.site, a.run, count(*) AS waiting FROM a LEFT JOIN g USING (site, run, uri) WHERE g.got IS NULL OR "
    "g.got < a.asked GROUP BY ALL), "
    "s AS (SELECT site, run, min(us) AS first_us, max(us) AS last_us, count(*) AS requests, count_if(NOT robots) AS pages, "
    "count_if(robots AND ((status NOT IN (200, 400, 403, 404, 500) AND NOT status BETWEEN 300 AND 399) OR (status "
    "BETWEEN 300 AND 399 AND location IS NULL))) AS refused FROM r GROUP BY site, run) "
    "SELECT s.site, first_us, last_us, requests, coalesce(waiting, 0) AS waiting, CASE WHEN refused > 0 THEN 'skipped' "
    "WHEN pages = 0 THEN 'robots' WHEN coalesce(waiting, 0) = 0 THEN 'completed' ELSE 'stalled' END AS state "
    "FROM s LEFT JOIN w USING (site, run)"
)


@query(sql(f"SELECT * FROM ({_RUNS})", "fetch_log_v"))
def stream_site_runs(spark, sf):
    """Runs of each site with a timer each, in append mode; a last request far ahead closes the stream."""
    folder = work_path(spark, "fetch-log")
    log = view(spark, sf, "fetch_log_v")
    log.write.parquet(folder)
    end = spark.createDataFrame([(None, None, None)], "site string, uri string, status int").select(
        F.lit(None).cast(log.schema["event_id"].dataType).alias("event_id"), F.lit("9999-01-01").cast("timestamp").alias("ts"),
        "site", "uri", "status", F.lit(None).cast("string").alias("location"), F.lit(None).cast("bigint").alias("bytes"),
    ).select(*log.columns)
    # Timers fire in the batch after the one that moved the watermark: a second last request makes that batch.
    end.coalesce(1).write.mode("append").parquet(folder)
    end.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # The log's files are in no order of time: the allowed lateness spans all of it.
    return jobs.run_to_table(sites.stream_site_runs(stream, idle_s=36000, late="36500 days"), "site-runs")


# A whole round


@query(sql(
    f"SELECT c.site, c.uri FROM permitted c WHERE NOT regexp_matches({path_of('c.uri')}, '{SUFFIX_PATTERN}') AND NOT "
    f"EXISTS (SELECT 1 FROM {_HANDLED} WHERE h.site = c.site AND {path_of('h.uri')} = {path_of('c.uri')})",
    "permitted", "page_lang"))
def site_admission(spark, sf):
    rules = robots.rule_sets(robots_docs(spark, sf), CONFIG.agent)
    return crawl.site_admission(everything(spark, sf), rules, _handled(spark, sf), CONFIG)


@query(sql(
    "SELECT DISTINCT site, rtrim(site, '/') || location AS uri, 'site' AS queue FROM fetch_log_v WHERE status BETWEEN "
    "300 AND 399 AND location IS NOT NULL", "fetch_log_v"))
def redirect_links(spark, sf):
    return crawl.redirect_links(view(spark, sf, "fetch_log_v"))


@query(sql(
    "SELECT q.site, q.uri, CAST(row_number() OVER (PARTITION BY q.site ORDER BY md5(q.uri), q.uri) AS BIGINT) AS rn, "
    "o.wait_s FROM r_queue q JOIN outcome o ON q.site = o.site", "r_queue", "outcome"))
def crawl_round_(spark, sf):
    fetched = page_table(spark, sf).select(urls.site_key("url").alias("site"), urls.strip_fragment("url").alias("uri"))
    result = crawl.crawl_round(
        page_bodies(spark, sf), markup.page_lang(F.col("html")), view(spark, sf, "robots_log_v"), fetched,
        waiting(spark, sf), stored(active(spark, sf), "active"), stored(weights(spark, sf), "weights"), CONFIG)
    return result.schedule.select("site", "uri", "rn", "wait_s")


@query(robots_chain_sql(
    "SELECT q.site, q.uri, CAST(row_number() OVER (PARTITION BY q.site ORDER BY md5(q.uri), q.uri) AS BIGINT) AS rn, "
    "o.wait_s FROM r_queue q JOIN outcome o ON q.site = o.site", "r_queue", "outcome"))
def crawl_round_chained(spark, sf):
    """A round whose robots answers come from the fetch log's redirect chains."""
    fetched = page_table(spark, sf).select(urls.site_key("url").alias("site"), urls.strip_fragment("url").alias("uri"))
    answers = robots.robots_chains(view(spark, sf, "robots_fetches_v"))
    result = crawl.crawl_round(
        page_bodies(spark, sf), markup.page_lang(F.col("html")), answers, fetched,
        waiting(spark, sf), stored(active(spark, sf), "active"), stored(weights(spark, sf), "weights"), CONFIG)
    return result.schedule.select("site", "uri", "rn", "wait_s")


QUERIES = {name.rstrip("_"): build for name, build in QUERIES.items()}
ORACLES = {name.rstrip("_"): text for name, text in ORACLES.items()}
