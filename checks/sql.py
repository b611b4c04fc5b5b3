"""Shared pieces of the DuckDB texts."""

from __future__ import annotations

import re

from checks.views import SITE, VIEWS, view_sql
from crawlframe.config import IGNORED_SUFFIXES

SUFFIX_PATTERN = "(" + "|".join(re.escape(s) for s in IGNORED_SUFFIXES) + ")$"


def encoded(text: str, also: str = "") -> str:
    """Percent-encode the unsafe characters of a SQL expression."""
    return (
        f"array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN "
        f"regexp_matches(c, '[^\\x21-\\x7E]|[\"<>`{also}]') THEN "
        "regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') ELSE c END), '')"
    )


def site_of(url: str) -> str:
    return (
        f"(regexp_extract({url}, '^([A-Za-z]+://)', 1) || "
        f"regexp_extract({url}, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1) || '/')"
    )


def path_of(url: str) -> str:
    return f"coalesce(nullif(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


ROUND_LANG = "en"

# name -> (what it reads, text); views are known by their own names.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "page_lang": ((), "SELECT *, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages"),
    "hrefs": (
        ("page_lang",),
        "SELECT page_id, url, lang, replace(h, '&amp;', '&') AS raw_href FROM (SELECT page_id, url, lang, "
        "unnest(list_distinct(regexp_extract_all(html, "
        "'(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1))) AS h FROM page_lang)",
    ),
    "links": (
        ("hrefs",),
        f"SELECT page_id, url AS src_url, lang, raw_href, rtrim({SITE}, '/') || {encoded('raw_href', '{}')} "
        f"AS dst_url, {SITE} AS dst_site FROM hrefs",
    ),
    "link_frontier": (("links",), "SELECT DISTINCT dst_site AS site, dst_url AS uri FROM links"),
    "active": (
        ("waiting_v",),
        "SELECT site FROM waiting_v GROUP BY site ORDER BY count(*) DESC, site LIMIT 5",
    ),
    "weights": (
        ("page_events_v",),
        "SELECT e.site, CAST(max(CASE WHEN l.at IS NULL THEN 0 ELSE 100 END) + 20 * count_if(e.kind = 'completed' "
        "AND (l.at IS NULL OR e.seq > l.at)) AS BIGINT) AS weight FROM page_events_v e LEFT JOIN (SELECT site, "
        "max(seq) AS at FROM page_events_v WHERE kind = 'skipped' GROUP BY site) l ON e.site = l.site GROUP BY e.site",
    ),
    "robots_docs": (("robots_log_v",), "SELECT site, body FROM robots_log_v WHERE status = 200"),
    "robots_lines": (
        ("robots_docs",),
        "SELECT site, generate_subscripts(string_split(body, chr(10)), 1) AS pos, "
        "unnest(string_split(body, chr(10))) AS line FROM robots_docs",
    ),
    "robots_records": (
        ("robots_lines",),
        "SELECT site, pos, lower(trim(split_part(l, ':', 1))) AS field, trim(substr(l, strpos(l, ':') + 1)) AS v "
        "FROM (SELECT site, pos, regexp_replace(line, '#.*$', '') AS l FROM robots_lines) "
        "WHERE regexp_matches(lower(l), '^\\s*(user-agent|allow|disallow|crawl-delay)\\s*:')",
    ),
    "robots_starts": (
        ("robots_records",),
        "SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos), '') "
        "<> 'user-agent' THEN 1 ELSE 0 END AS s FROM robots_records",
    ),
    "robots_groups": (
        ("robots_starts",),
        "SELECT *, sum(s) OVER (PARTITION BY site ORDER BY pos) AS g FROM robots_starts",
    ),
    "robots_ours": (
        ("robots_groups",),
        "SELECT r.* FROM robots_groups r JOIN (SELECT DISTINCT site, g FROM robots_groups "
        "WHERE field = 'user-agent' AND v = '*') o ON r.site = o.site AND r.g = o.g",
    ),
    "rules": (
        ("robots_ours",),
        "SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY pos) - 1 AS BIGINT) AS rule_no, "
        "field = 'allow' AS allow, v AS pattern FROM robots_ours WHERE field IN ('allow', 'disallow') AND v <> ''",
    ),
    "meta": (
        ("robots_docs", "robots_ours", "rules"),
        "SELECT d.site, (SELECT min(try_cast(v AS DOUBLE)) FROM robots_ours o WHERE o.site = d.site AND "
        "o.field = 'crawl-delay') AS delay_s, EXISTS (SELECT 1 FROM rules r WHERE r.site = d.site AND NOT r.allow "
        "AND r.pattern = '/') AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.site = d.site AND r.allow) AS allow_none, "
        "(SELECT count(*) FROM rules r WHERE r.site = d.site) AS rules FROM robots_docs d",
    ),
    "outcome": (
        ("robots_log_v", "meta"),
        "SELECT site, outcome, CASE outcome WHEN 'rules' THEN wait WHEN 'allow_all' THEN 5.0 END AS wait_s, "
        "outcome = 'rules' AND wait > 20 AS reconnect FROM (SELECT l.site, coalesce(m.delay_s, 5.0) AS wait, CASE "
        "WHEN status = 200 AND (allow_none OR coalesce(delay_s, 5) > 120) THEN 'skip' WHEN status = 200 THEN 'rules' "
        "WHEN status // 100 = 3 AND location IS NULL THEN 'skip' WHEN status // 100 = 3 AND looped THEN 'allow_all' "
        "WHEN status // 100 = 3 AND hops > 10 THEN 'redirect_overflow' WHEN status // 100 = 3 THEN 'follow' "
        "WHEN status IN (400, 403, 404, 500) THEN 'allow_all' ELSE 'skip' END AS outcome "
        "FROM robots_log_v l LEFT JOIN meta m ON l.site = m.site)",
    ),
    "targets": (
        ("link_frontier", "waiting_v"),
        "SELECT site, uri, regexp_extract(uri, '^[a-z]+://[^/?#]*([^#]*)', 1) AS target FROM "
        "(SELECT * FROM link_frontier UNION SELECT * FROM waiting_v)",
    ),
    "permitted": (
        ("targets", "rules"),
        "SELECT t.site, t.uri FROM targets t LEFT JOIN rules r ON t.site = r.site AND regexp_matches(t.target, "
        "'^' || replace(replace(replace(r.pattern, '.', '\\.'), '?', '\\?'), '*', '.*')) GROUP BY t.site, t.uri "
        "HAVING coalesce(arg_max(r.allow, 2 * length(r.pattern) + CAST(r.allow AS INTEGER)), true)",
    ),
    "everything": (
        ("link_frontier", "waiting_v"),
        "SELECT * FROM link_frontier UNION SELECT * FROM waiting_v",
    ),
    "selected": (
        ("everything", "weights", "active"),
        "SELECT * FROM (SELECT site, pending, weight, pending - weight AS score, row_number() OVER "
        "(ORDER BY pending - weight DESC, site) AS rank FROM (SELECT f.site, count(*) AS pending, "
        "coalesce(any_value(w.weight), 0) AS weight FROM everything f LEFT JOIN weights w ON f.site = w.site "
        "GROUP BY f.site)) WHERE rank <= least(25 - (SELECT count(*) FROM active), "
        "greatest(100, (SELECT count(DISTINCT site) FROM everything) * 2 // 100 + 1))",
    ),
    # One round: pages in ROUND_LANG contribute links.
    "r_links": (("links",), f"SELECT DISTINCT dst_site AS site, dst_url AS uri FROM links WHERE lang = '{ROUND_LANG}' "
                f"OR {path_of('src_url')} = '/'"),
    "r_permitted": (
        ("r_links", "rules"),
        "SELECT t.site, t.uri FROM r_links t LEFT JOIN rules r ON t.site = r.site AND regexp_matches("
        "regexp_extract(t.uri, '^[a-z]+://[^/?#]*(.*)', 1), "
        "'^' || replace(replace(replace(r.pattern, '.', '\\.'), '?', '\\?'), '*', '.*')) GROUP BY t.site, t.uri "
        "HAVING coalesce(arg_max(r.allow, 2 * length(r.pattern) + CAST(r.allow AS INTEGER)), true)",
    ),
    "r_waiting": (
        ("r_permitted", "waiting_v", "active"),
        "SELECT site, uri FROM waiting_v UNION SELECT site, uri FROM r_permitted "
        "WHERE site NOT IN (SELECT site FROM active)",
    ),
    "r_selected": (
        ("r_waiting", "weights", "active"),
        "SELECT site FROM (SELECT site, row_number() OVER (ORDER BY pending - weight DESC, site) AS rank FROM "
        "(SELECT f.site, count(*) AS pending, coalesce(any_value(w.weight), 0) AS weight FROM r_waiting f "
        "LEFT JOIN weights w ON f.site = w.site GROUP BY f.site)) WHERE rank <= least("
        "25 - (SELECT count(*) FROM active), greatest(100, (SELECT count(DISTINCT site) FROM r_waiting) * 2 // 100 + 1))",
    ),
    # What a chosen site with a settled robots.txt fetches: no page seen before, nothing forbidden.
    "r_queue": (
        ("r_waiting", "r_selected", "outcome", "rules"),
        "SELECT t.site, t.uri FROM (SELECT w.site, w.uri FROM r_waiting w JOIN outcome o ON w.site = o.site "
        "WHERE o.outcome IN ('rules', 'allow_all') AND w.site IN (SELECT site FROM r_selected) AND NOT EXISTS ("
        f"SELECT 1 FROM pages p WHERE {site_of('p.url')} = w.site AND {path_of('p.url')} = {path_of('w.uri')})) t "
        "LEFT JOIN rules r ON t.site = r.site AND regexp_matches("
        "regexp_extract(t.uri, '^[a-z]+://[^/?#]*(.*)', 1), "
        "'^' || replace(replace(replace(r.pattern, '.', '\\.'), '?', '\\?'), '*', '.*')) GROUP BY t.site, t.uri "
        "HAVING coalesce(arg_max(r.allow, 2 * length(r.pattern) + CAST(r.allow AS INTEGER)), true)",
    ),
    "chars": ((), "SELECT doc_id, lang, string_split(text, '') AS c FROM documents"),
    "text_grams": (
        ("chars",),
        "SELECT doc_id, lang, unnest(list_concat(c, "
        "[c[i] || c[i + 1] for i in range(1, len(c))], "
        "[c[i] || c[i + 1] || c[i + 2] for i in range(1, len(c) - 1)])) AS gram FROM chars",
    ),
    "gram_counts": (
        ("text_grams",),
        "SELECT doc_id, lang, gram, count(*) AS n FROM text_grams WHERE gram <> '' GROUP BY ALL",
    ),
    "lang_counts": (
        ("gram_counts",),
        "SELECT lang, gram, sum(n) AS n, length(gram) AS size FROM gram_counts GROUP BY lang, gram",
    ),
    "profiles": (
        ("lang_counts",),
        "SELECT lang, gram, CAST(round(ln(n / sum(n) OVER (PARTITION BY lang, size)) * 10000) AS BIGINT) AS weight "
        "FROM lang_counts",
    ),
}


def sql(final: str, *reads: str) -> str:
    """``final`` with the parts and views it reads in front."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][0] if name in PARTS else ():
            need(other)
        order.append(name)

    for name in reads:
        need(name)
    texts = [f"{n} AS ({view_sql(n) if n in VIEWS else PARTS[n][1]})" for n in order]
    head = "WITH RECURSIVE " if "RECURSE" in final else "WITH "
    return (head + ",\n".join(texts) + "\n" if texts else "") + final.replace("/*RECURSE*/", "")


# Each site's robots.txt chain through the fetch log: redirects resolved, an as-of join to the next answer for
# the target, a hop per step of the recursion.
ROBOTS_CHAINS = """
WITH RECURSIVE f AS (SELECT row_number() OVER () AS id, * FROM robots_fetches_v),
m AS (SELECT id, uri, ts, CASE WHEN location LIKE '%://%' THEN location
                               ELSE regexp_extract(uri, '^([a-z]+://[^/]+)', 1) || location END AS target
      FROM f WHERE status BETWEEN 300 AND 399 AND location IS NOT NULL),
l AS (SELECT m.id, m.target, regexp_extract(m.uri, '^[a-z]+://([^/]+)', 1) <> regexp_extract(m.target, '^[a-z]+://([^/]+)', 1)
             AS away, n.id AS next_id FROM m ASOF LEFT JOIN f n ON m.target = n.uri AND m.ts <= n.ts),
st AS (SELECT site, arg_min(id, ts) AS cur FROM f WHERE uri = site || 'robots.txt' GROUP BY site),
c(site, cur, seen, hops) AS (
  SELECT site, cur, [site || 'robots.txt'], 0 FROM st
  UNION ALL
  SELECT c.site, l.next_id, list_append(c.seen, l.target), c.hops + 1 FROM c JOIN l ON l.id = c.cur
  WHERE NOT l.away AND NOT list_contains(c.seen, l.target) AND c.hops + 1 <= 10 AND l.next_id IS NOT NULL),
e AS (SELECT c.*, l.target, coalesce(l.away, false) AS away, l.next_id,
             coalesce(NOT l.away AND list_contains(c.seen, l.target), false) AS looped
      FROM c LEFT JOIN l ON l.id = c.cur
      WHERE NOT coalesce(NOT l.away AND NOT list_contains(c.seen, l.target) AND c.hops + 1 <= 10 AND l.next_id IS NOT NULL, false))
SELECT e.site, o.uri, CASE WHEN e.away AND t.status = 200 THEN 200 ELSE o.status END AS status,
       CASE WHEN e.away AND coalesce(t.status, 0) <> 200 THEN NULL ELSE o.location END AS location,
       CAST(CASE WHEN e.target IS NOT NULL THEN e.hops + 1 ELSE e.hops END AS INTEGER) AS hops, e.looped,
       CASE WHEN e.away THEN CASE WHEN t.status = 200 THEN t.body END ELSE o.body END AS body
FROM e JOIN f o ON o.id = e.cur LEFT JOIN f t ON t.id = e.next_id"""


def robots_chain_sql(final: str, *reads: str) -> str:
    """``final`` over parts that read the chains' answers in place of the plain robots log."""
    plain = f"robots_log_v AS ({view_sql('robots_log_v')})"
    text = sql(final, *reads)
    chained = f"robots_fetches_v AS ({view_sql('robots_fetches_v')}),\nrobots_log_v AS ({ROBOTS_CHAINS})"
    return text.replace(plain, chained) if plain in text else text
