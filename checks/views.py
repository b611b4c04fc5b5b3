"""Derived views: one SQL text for Spark and DuckDB. Table names stand in braces."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

SITE = "concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/')"

VIEWS = {
    "fetch_log_v": """
SELECT event_id, ts, concat('https://h', user_id, '.example.com/') AS site,
       CASE event_type WHEN 'signup' THEN concat('https://h', user_id, '.example.com/robots.txt')
            ELSE concat('https://h', user_id, '.example.com/p/', event_id % 97) END AS uri,
       CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN
            CASE WHEN value > 30 THEN 503 ELSE 301 END
            WHEN 'purchase' THEN 404 ELSE 500 END AS status,
       CASE WHEN event_type = 'signup' AND value > 20 THEN '/moved' END AS location,
       CAST(round(value * 100) AS BIGINT) AS bytes
FROM {events}""",
    "site_events_v": """
SELECT concat('https://h', user_id, '.example.com/') AS site, event_id AS seq,
       CASE event_type WHEN 'error' THEN 'skipped' ELSE 'completed' END AS kind
FROM {events} WHERE event_type IN ('error', 'purchase')""",
    "attempts_v": """
SELECT event_id, ts, concat('https://h', user_id, '.example.com/p/', event_id % 13) AS uri,
       CASE event_type WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'error'
                       WHEN 'signup' THEN 'too_large' ELSE 'ok' END AS kind
FROM {events}""",
    "page_events_v": f"""
SELECT {SITE} AS site, page_id AS seq,
       CASE WHEN url LIKE '%#top' THEN 'skipped' ELSE 'completed' END AS kind
FROM {{pages}}""",
    "waiting_v": f"""
SELECT DISTINCT {SITE} AS site, regexp_replace(url, '#.*$', '') AS uri FROM {{pages}}""",
    "robots_log_v": f"""
SELECT s.site, concat(s.site, 'robots.txt') AS uri,
       CASE length(s.site) % 11 WHEN 4 THEN 404 WHEN 5 THEN 301 WHEN 6 THEN 302 WHEN 7 THEN 503
            WHEN 8 THEN 403 WHEN 9 THEN 301 ELSE 200 END AS status,
       CASE length(s.site) % 11 WHEN 5 THEN concat(f.site, 'robots.txt') WHEN 9 THEN '/robots2.txt'
            END AS location,
       length(s.site) % 13 AS hops, length(s.site) % 17 = 12 AS looped,
       concat('# rules', chr(10), 'User-agent: OtherBot', chr(10), 'Disallow: /', chr(10), chr(10),
              'User-Agent: *', chr(10),
              CASE length(s.site) % 5 WHEN 0 THEN 'Disallow: /' WHEN 1 THEN 'Disallow: /the  # most'
                   WHEN 2 THEN concat('Disallow: /', chr(10), 'Allow: /en', chr(10), 'Allow: /*n$')
                   WHEN 3 THEN 'Disallow: /*a' ELSE 'Disallow:' END, chr(10),
              CASE length(s.site) % 7 WHEN 0 THEN 'Crawl-delay: 1' WHEN 1 THEN 'Crawl-delay: 30'
                   WHEN 2 THEN 'crawl-delay: 300' WHEN 3 THEN 'Crawl-delay: soon'
                   ELSE 'Sitemap: /map.xml' END, chr(10)) AS body
FROM (SELECT DISTINCT {SITE} AS site FROM {{pages}}) s
JOIN (SELECT regexp_extract(site, '([a-z]+)/$', 1) AS tld, min(site) AS site
      FROM (SELECT {SITE} AS site FROM {{pages}}) p
      WHERE length(site) % 11 IN (0, 1, 2, 3, 10) GROUP BY 1) f
  ON regexp_extract(s.site, '([a-z]+)/$', 1) = f.tld""",
    # A fetch log of robots.txt: chains of 0 to 12 redirects within a site, loops back to the start, redirects
    # to another site's robots.txt, chains whose last answer has not come yet; stale (v = 1) and later (v = 2)
    # answers for each target beside the one a redirect leads to.
    "robots_fetches_v": f"""
SELECT s.site,
       concat(s.site, CASE WHEN n.k = 0 THEN '' ELSE concat('r', CAST(n.k AS STRING), '/') END, 'robots.txt') AS uri,
       CASE v.v WHEN 0 THEN CASE WHEN n.k = 0 AND s.away THEN 990 ELSE 1000 + 10 * n.k + length(s.site) % 3 END WHEN 1 THEN 985 + 10 * n.k ELSE 1500 + 10 * n.k END AS ts,
       CASE WHEN v.v = 1 THEN 500 WHEN v.v = 2 THEN 404 WHEN n.k < s.h THEN 301 + n.k % 2 WHEN length(s.site) % 7 = 0 THEN 404
            WHEN length(s.site) % 7 = 1 THEN 503 WHEN length(s.site) % 7 = 2 THEN 418 ELSE 200 END AS status,
       CASE WHEN v.v > 0 THEN NULL WHEN n.k = 0 AND s.away THEN concat(f.site, 'robots.txt')
            WHEN n.k = s.h - 1 AND s.loop THEN '/robots.txt'
            WHEN n.k < s.h THEN concat('/r', CAST(n.k + 1 AS STRING), '/robots.txt') END AS location,
       CASE WHEN v.v = 0 AND n.k = s.h THEN concat('User-Agent: *', chr(10),
            CASE length(s.site) % 5 WHEN 0 THEN 'Disallow: /' WHEN 1 THEN 'Disallow: /the'
                 WHEN 2 THEN concat('Disallow: /', chr(10), 'Allow: /en') ELSE 'Disallow:' END, chr(10),
            CASE length(s.site) % 4 WHEN 0 THEN 'Crawl-delay: 1' WHEN 1 THEN 'Crawl-delay: 30'
                 WHEN 2 THEN 'crawl-delay: 300' ELSE 'Sitemap: /map.xml' END, chr(10)) END AS body
FROM (SELECT site, (ascii(substr(md5(site), 1, 1)) + 3 * ascii(substr(md5(site), 2, 1))) % 13 AS h,
             ascii(substr(md5(site), 3, 1)) % 5 = 0 AS away, ascii(substr(md5(site), 4, 1)) % 4 = 1 AS loop,
             ascii(substr(md5(site), 5, 1)) % 5 = 2 AS miss
      FROM (SELECT DISTINCT {SITE} AS site FROM {{pages}}) d) s
JOIN (SELECT DISTINCT p_partkey AS k FROM {{part}} WHERE p_partkey BETWEEN 0 AND 12) n ON n.k <= s.h
JOIN (SELECT DISTINCT p_partkey AS v FROM {{part}} WHERE p_partkey BETWEEN 0 AND 2) v
  ON v.v = 0 AND NOT (n.k = s.h AND s.miss AND s.h > 0) OR v.v = 1 AND n.k >= 1 OR v.v = 2 AND n.k >= 1 AND n.k < s.h
JOIN (SELECT regexp_extract(site, '([a-z]+)/$', 1) AS tld, min(site) AS site
      FROM (SELECT DISTINCT {SITE} AS site FROM {{pages}}) p GROUP BY 1) f
  ON regexp_extract(s.site, '([a-z]+)/$', 1) = f.tld""",
    "redirects_v": """
SELECT p_partkey AS src, CASE WHEN p_size > 4 THEN (p_partkey * 7 + 3) % (SELECT count(*) FROM {part})
       ELSE -p_partkey - 1 END AS dst
FROM {part}""",
    "graph_v": """
SELECT p_partkey AS src, CASE WHEN p_size > 12 THEN (p_partkey * 3 + 1) % (SELECT count(*) FROM {part})
       ELSE -p_partkey - 1 END AS dst
FROM {part}
UNION ALL
SELECT p_partkey, CASE WHEN p_size > 12 THEN (p_partkey * 5 + 2) % (SELECT count(*) FROM {part})
       ELSE -p_partkey - 1 END
FROM {part}""",
    "mixed_v": """
SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN 'жук' WHEN 1 THEN repeat('жук', 200) WHEN 2 THEN '日本' ELSE '' END AS text
FROM {documents}""",
    "hrefs_v": """
SELECT page_id, url AS base, CASE page_id % 15
         WHEN 0 THEN concat('/files/a', page_id, '.jpg')
         WHEN 1 THEN concat('/files/a', page_id, '.JPG')
         WHEN 2 THEN concat('/files/a', page_id, '.pdf?dl=1')
         WHEN 3 THEN 'JavaScript:void(0)'
         WHEN 4 THEN concat('mailto:u', page_id, '@example.com')
         WHEN 5 THEN concat('//cdn.example.org/x', page_id)
         WHEN 6 THEN concat('?page=', page_id)
         WHEN 7 THEN '#frag'
         WHEN 8 THEN concat('https://user@other.example.org:8443/p/', page_id, '?q=1#s')
         WHEN 9 THEN concat('ftp://ftp.example.org/d', page_id, '.zip/')
         WHEN 10 THEN ''
         WHEN 11 THEN concat('tel:', page_id)
         WHEN 12 THEN concat('http://example.net:99999/k', page_id)
         WHEN 13 THEN concat('https:///', page_id, '%20x/y')
         ELSE concat('http://Example.NET:80/k', page_id) END AS href
FROM {pages}""",
    "headers_v": """
SELECT page_id, CASE page_id % 7
         WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'text/plain'
         WHEN 2 THEN 'application/xhtml+xml; charset=Shift_JIS' WHEN 3 THEN 'text/xml'
         WHEN 4 THEN 'application/xml; charset=utf-8' WHEN 5 THEN 'application/pdf'
         ELSE NULL END AS content_type
FROM {pages}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(text: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(text) if name}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view in Spark; times become UTC timestamps."""
    text = VIEWS[name]
    df = spark.sql(text, **{t: table(spark, sf_dir, t) for t in _tables(text)})
    return df.withColumn("ts", df.ts.cast("timestamp")) if "ts" in df.columns else df


def view_sql(name: str) -> str:
    """The view's text for DuckDB."""
    text = VIEWS[name]
    return text.format(**{t: t for t in _tables(text)})
