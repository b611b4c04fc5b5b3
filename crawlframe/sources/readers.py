"""Tables and files a crawl reads."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.config import ARCHIVE_SEPARATOR
from crawlframe.session import spread

PAGES_SCHEMA = "page_id bigint, url string, html string"
FETCH_LOG_SCHEMA = "event_id bigint, ts timestamp, site string, uri string, status int, bytes bigint"


def load_seeds(
    spark: SparkSession, patterns: Sequence[str] = (), bundled: Sequence[str] = ()
) -> DataFrame:
    """Seed lines (value): the bundled list, then every line of the files ``patterns`` name.

    A pattern's last part may be a glob. A pattern that matches nothing warns and yields
    nothing. Blank lines are dropped, repeated ones kept.
    """
    parts = [spark.createDataFrame([(s,) for s in bundled], "value string")]
    for pattern in patterns:
        try:
            parts.append(spark.read.text(pattern))
        except AnalysisException:
            warnings.warn(f"could not read seeds from {pattern}", stacklevel=2)
    lines = reduce(DataFrame.unionByName, parts)
    return lines.select(F.trim("value").alias("value")).filter("value <> ''")


def read_pages(spark: SparkSession, path: str, use_all_cores: bool = False) -> DataFrame:
    """Fetched pages; bodies are only read by jobs that use them.

    ``use_all_cores`` is for jobs that work on bodies of a table in few files, see ``spread``.
    """
    pages = spark.read.parquet(path)
    return spread(pages) if use_all_cores else pages


def with_fetch_time(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Times without a zone as UTC timestamps."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def read_fetch_log(
    spark: SparkSession, path: str, streaming: bool = False, schema: str = FETCH_LOG_SCHEMA, files: str | None = None
) -> DataFrame:
    """One row per handled response, robots requests included, as a table or a stream.

    ``files`` restricts a folder to matching names.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return with_fetch_time(reader.parquet(path))


def read_html_archive(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of what ``write_html_archive`` wrote."""
    records = spark.read.option("lineSep", ARCHIVE_SEPARATOR).option("recursiveFileLookup", "true").text(path)
    return records.select(
        F.substring_index("value", "\n", 1).alias("url"),
        F.expr("substring(value, locate('\n', value) + 1)").alias("html"),
    )


def read_uri_log(spark: SparkSession, path: str) -> DataFrame:
    """(url, status) of what ``write_uri_log`` wrote."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.substring_index("value", "\t", 1).alias("url"),
        F.substring_index("value", "\t", -1).try_cast("int").alias("status"),
    )
