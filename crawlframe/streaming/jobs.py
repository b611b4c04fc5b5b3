"""The same rules over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlframe.config import ARCHIVE_SEPARATOR
from crawlframe.operators.archive import html_record, uri_line
from crawlframe.operators.fetchlog import throughput_report
from crawlframe.operators.pages import archive_gate
from crawlframe.session import work_path


def stream_throughput(docs: DataFrame, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Interval report over a live stream of (ts, bytes)."""
    return throughput_report(docs.withWatermark("ts", late), every)


def stream_frontier(links: DataFrame, within: str | None = None, ts: str = "ts") -> DataFrame:
    """Live links (site, uri) admitted once each.

    Without ``within`` every URL is remembered; with it, only for that long, which bounds
    the state.
    """
    if within is None:
        return links.select("site", "uri").dropDuplicates(["uri"])
    known = links.withWatermark(ts, within).dropDuplicatesWithinWatermark(["uri"])
    return known.select("site", "uri")


def stream_site_state(log: DataFrame, idle: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """State of each site's run of activity, reported when it has been idle.

    A run whose robots.txt was answered with a status that forbids a crawl, or (if the log has
    ``location``) with a redirect that names no target, is ``skipped``,
    one that only asked for robots.txt is ``robots``, others are ``completed``. Runs are
    session windows: their partial counts are merged in each task before they move, so a
    site with a third of the traffic does not pass through one task row by row.
    """
    robots = F.col("uri").endswith("/robots.txt")
    refused = robots & ~F.col("status").isin(200, 400, 403, 404, 500) & ~F.col("status").between(300, 399)
    if "location" in log.columns:
        refused = refused | (robots & F.col("status").between(300, 399) & F.col("location").isNull())
    runs = (
        log.withWatermark("ts", late)
        .groupBy("site", F.session_window("ts", idle).alias("_w"))
        .agg(
            F.min("ts").alias("_first"),
            F.max("ts").alias("_last"),
            F.count(F.lit(1)).alias("requests"),
            F.count_if(~robots).alias("_pages"),
            F.count_if(refused).alias("_refused"),
        )
    )
    state = (
        F.when(F.col("_refused") > 0, F.lit("skipped"))
        .when(F.col("_pages") == 0, F.lit("robots"))
        .otherwise(F.lit("completed"))
    )
    return runs.select(
        "site",
        F.unix_micros("_first").alias("first_us"),
        F.unix_micros("_last").alias("last_us"),
        "requests",
        state.alias("state"),
    )


def start_route(
    docs: DataFrame, uri_path: str, html_path: str, checkpoint: str, target_lang: str, every: str | None = None
) -> StreamingQuery:
    """One feed, two outputs: every event to the URI log, target-language documents to the archive.

    ``docs`` has (uri, status, lang, html). Each micro-batch writes folders of its own
    number, so a repeated batch replaces what it wrote before. With ``every`` (an interval)
    the query keeps running; else it ends with the input at hand.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            lines = batch.select(uri_line("uri", "status").alias("value"))
            lines.write.mode("overwrite").option("compression", "gzip").text(f"{uri_path}/run={number}")
            kept = batch.filter(archive_gate(F.col("lang"), target_lang) & (F.col("status") == 200))
            records = kept.select(html_record("uri", "html").alias("value"))
            records.write.mode("overwrite").option("compression", "gzip").option(
                "lineSep", ARCHIVE_SEPARATOR
            ).text(f"{html_path}/run={number}")
        finally:
            batch.unpersist()

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .start()
    )


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all available input and return what it put out.

    Output and stream state go to the shared folder.
    """
    spark = stream.sparkSession
    path, state = work_path(spark, name), work_path(spark, f"{name}-state")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        # A complete result replaces the one before it; the last one stays.
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)
        ).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
