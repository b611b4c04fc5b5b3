"""Pages to text and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.config import IGNORED_SUFFIXES
from crawlframe.functions import markup, urls
from crawlframe.functions.headers import charset_of, parser_kind

BODY_CAP = 2 * 1024 * 1024

# Reasons under which a link could not be read at all, as opposed to not being wanted.
INVALID_REASONS = ("no_host", "bad_port", "bad_host")


def with_body_size(pages: DataFrame, body: str = "html", cap: int = BODY_CAP) -> DataFrame:
    """Add ``read_bytes`` and ``too_large``."""
    size = F.octet_length(body).cast("bigint")
    return pages.withColumn("read_bytes", size).withColumn("too_large", size > cap)


def body_size_cap(pages: DataFrame, body: str = "html", cap: int = BODY_CAP) -> DataFrame:
    """Pages whose body is within ``cap`` bytes."""
    return pages.filter(F.octet_length(body) <= cap)


def body_size_rejects(pages: DataFrame, body: str = "html", cap: int = BODY_CAP) -> DataFrame:
    """Pages whose body is over ``cap`` bytes; they are never fetched again."""
    return pages.filter(F.octet_length(body) > cap)


def parse_pages(
    pages: DataFrame, body: str = "html", content_type: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Parse bodies to title, text, declared language, hrefs, ok and error.

    Only the body and its two parser hints travel to Python. ``partitions`` spreads the
    work when the input has few files.
    """
    hint = F.col(content_type) if content_type else F.lit(None).cast("string")
    if partitions:
        pages = pages.repartition(partitions)
    parsed = pages.withColumn("_parsed", markup.parse_markup(F.col(body), charset_of(hint), parser_kind(hint)))
    return parsed.select(*pages.columns, "_parsed.*")


def _judged(rows: DataFrame, keys: Sequence[str], url: str, hrefs: Column, suffixes: Sequence[str]) -> DataFrame:
    """One row per element of ``hrefs`` with its fate.

    Hrefs are resolved inside their row and then set free, so a filter on the outcome is
    not pushed back into the resolving.
    """
    found = rows.select(*keys, F.col(url).alias("src_url"), hrefs.alias("_hrefs"))
    links = found.select(*keys, "src_url", F.explode(urls.resolved("src_url", "_hrefs")).alias("_link"))
    reason = (
        F.when(~urls.href_scheme_filter("_link.raw_href"), F.lit("scheme"))
        .when(F.col("_link.fault").isNotNull(), F.col("_link.fault"))
        .when(~urls.suffix_filter("_link.path", suffixes), F.lit("suffix"))
    )
    judged = links.withColumn("reject_reason", reason)
    kept = F.col("reject_reason").isNull()
    return judged.select(
        *keys,
        "src_url",
        "_link.raw_href",
        F.when(kept, F.col("_link.url")).alias("dst_url"),
        F.when(kept, F.col("_link.site")).alias("dst_site"),
        "reject_reason",
    )


def resolve_links(
    hrefs: DataFrame, base: str = "base", href: str = "href", suffixes: Sequence[str] = IGNORED_SUFFIXES
) -> DataFrame:
    """Every (base, href) row with ``dst_url``, ``dst_site`` and ``reject_reason``."""
    keys = [c for c in hrefs.columns if c not in (base, href)]
    return _judged(hrefs, keys, base, F.array(href), suffixes)


def all_links(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    suffixes: Sequence[str] = IGNORED_SUFFIXES,
    gate: Column | None = None,
) -> DataFrame:
    """Anchors of every page with their fate, refused ones included.

    ``gate`` picks the pages that contribute links; it is applied ahead of the scan of
    their markup. Equal hrefs of a page are folded before they leave its row: no shuffle
    and no Python.
    """
    if gate is not None:
        pages = pages.filter(gate)
    return _judged(pages, [key], url, markup.href_values(F.col(html)), suffixes)


def parsed_links(
    parsed: DataFrame, key: str = "page_id", url: str = "url", suffixes: Sequence[str] = IGNORED_SUFFIXES
) -> DataFrame:
    """As ``all_links``, from the hrefs ``parse_pages`` found; failed pages have none."""
    return _judged(parsed, [key], url, F.array_distinct("hrefs"), suffixes)


def extract_links(pages: DataFrame, **options) -> DataFrame:
    """Links a crawl may follow: (page_id, src_url, raw_href, dst_url, dst_site)."""
    return all_links(pages, **options).filter("reject_reason IS NULL").drop("reject_reason")


def invalid_links(links: DataFrame) -> DataFrame:
    """Links that could not be read, as (src_url, raw_href, reject_reason)."""
    broken = links.filter(F.col("reject_reason").isin(*INVALID_REASONS))
    return broken.select("src_url", "raw_href", "reject_reason")


def rejects_by_reason(links: DataFrame) -> DataFrame:
    return links.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("links")
    )


def dedup_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Each page's links as a set."""
    return links.select(key, "dst_url", "dst_site").distinct()


def link_sets(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    suffixes: Sequence[str] = IGNORED_SUFFIXES,
    gate: Column | None = None,
) -> DataFrame:
    """What ``dedup_links`` makes of ``extract_links``, folded inside each page's row: no shuffle."""
    if gate is not None:
        pages = pages.filter(gate)
    found = pages.select(key, F.col(url).alias("src_url"), markup.href_values(F.col(html)).alias("_hrefs"))
    wanted = F.filter(
        urls.resolved("src_url", "_hrefs"),
        lambda link: link["fault"].isNull()
        & urls.href_scheme_filter(link["raw_href"])
        & urls.suffix_filter(link["path"], suffixes),
    )
    pairs = F.transform(wanted, lambda link: F.struct(link["url"].alias("dst_url"), link["site"].alias("dst_site")))
    return found.select(key, F.explode(F.array_distinct(pairs)).alias("_link")).select(key, "_link.*")


def language_gate(lang, path, target: str) -> Column:
    """True for pages that may contribute links: the target language, or a site's root."""
    return F.coalesce(lang == target, F.lit(False)) | F.coalesce(path == "/", F.lit(False))


def archive_gate(lang, target: str) -> Column:
    """True for pages that may be archived."""
    return F.coalesce(lang == target, F.lit(False))
