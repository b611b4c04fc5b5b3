"""Gzipped output files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.config import ARCHIVE_SEPARATOR
from crawlframe.operators.archive import byte_batches, html_record, uri_line
from crawlframe.operators.fetchlog import uri_batches
from crawlframe.operators.pages import archive_gate


def write_uri_log(
    log: DataFrame, path: str, lines: int = 100_000, exact: bool = False, mode: str = "append"
) -> None:
    """Write ``human_url<TAB>status`` lines, gzipped, ``lines`` to a file.

    By default each task rolls its own files. With ``exact`` the log's order decides:
    file k holds lines k*n+1 to (k+1)*n, in folder ``batch=%04d``.
    """
    if not exact:
        lines_only = log.select(uri_line("uri", "status").alias("value"))
        lines_only.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", lines).text(path)
        return
    numbered = uri_batches(log, lines)
    placed = numbered.select(
        F.format_string("%04d", F.col("batch")).alias("batch"), "line_no", uri_line("uri", "status").alias("value")
    )
    placed = placed.repartition("batch").sortWithinPartitions("batch", "line_no").drop("line_no")
    placed.write.mode(mode).partitionBy("batch").option("compression", "gzip").text(path)


def write_html_archive(
    docs: DataFrame,
    path: str,
    max_bytes: int = 200 * 1024 * 1024,
    target_lang: str | None = None,
    key: str = "page_id",
    digits: int | None = None,
    mode: str = "append",
) -> None:
    """Write documents (key, url, html[, lang][, ok]) as gzipped archives rolled by size.

    Failed parses (``ok`` false) and, with ``target_lang``, other languages are left out.
    Files lie in ``file=<shard>-%06d`` folders. Documents are read twice unless ``digits`` is given; see ``byte_batches`` for ``digits``.
    """
    if "ok" in docs.columns:
        docs = docs.filter("ok")
    if target_lang is not None:
        docs = docs.filter(archive_gate(F.col("lang"), target_lang))
    sized = docs.select(key, "url", "html", F.octet_length("html").cast("bigint").alias("read_bytes"))
    batched = byte_batches(sized, max_bytes, key=key, digits=digits)
    named = batched.select(
        F.format_string("%s-%06d", "shard", "batch").alias("file"), key, html_record("url", "html").alias("value")
    )
    placed = named.repartition("file").sortWithinPartitions("file", key).drop(key)
    placed.write.mode(mode).partitionBy("file").option("compression", "gzip").option(
        "lineSep", ARCHIVE_SEPARATOR
    ).text(path)
