"""Which archive file a document goes to, and how it is written there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.urls import human_url


def uri_line(uri, status) -> Column:
    """One line of a URI log."""
    return F.concat(human_url(uri), F.lit("\t"), F.col(status).cast("string"))


def html_record(url, html) -> Column:
    """One record of an HTML archive, without the separator after it."""
    return F.concat(human_url(url), F.lit("\n"), F.col(html))


def file_starts(sizes: np.ndarray, counted: int, limit: int) -> tuple[list[int], int]:
    """Positions that open a new file, and what the last file has counted.

    A record opens a file once ``limit`` bytes are counted; it is not counted itself.
    """
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    starts, begin = [], 0
    while True:
        at = max(int(np.searchsorted(total, limit - counted + total[begin])), begin)
        if at >= len(sizes):
            return starts, counted + int(total[-1] - total[begin])
        starts.append(at)
        begin, counted = at + 1, 0


def digits_for(total: int, max_bytes: int, files: int = 10) -> int:
    """Fewest digits with which a shard is ``files`` files at most on average."""
    digits = 0
    while 16**digits * files * max_bytes < total:
        digits += 1
    return digits


def byte_batches(
    docs: DataFrame, max_bytes: int, key: str = "page_id", size: str = "read_bytes", digits: int | None = None
) -> DataFrame:
    """Add ``shard`` and ``batch``: within a shard, in ``key`` order, files of ``max_bytes``.

    Rolling by size goes record by record, so documents are dealt to ``16 ** digits``
    shards by a digest of their unique key: shards are alike in size whatever site the
    documents come from. Without ``digits`` the sizes are added up first, and a shard is some
    ten files. Only keys and sizes are rolled, in batches and with constant memory; only the
    first keys of files come back, and documents find their file by them.
    """
    if digits is None:
        digits = digits_for(docs.agg(F.sum(F.col(size).cast("bigint"))).first()[0] or 0, max_bytes)
    sharded = docs.withColumn("shard", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    key_type = docs.schema[key].dataType.simpleString()

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, batch, counted = None, 0, 0
        for rows in batches:
            for name, part in rows.groupby("shard", sort=False):
                if name != shard:
                    shard, batch, counted = name, 0, 0
                starts, counted = file_starts(part["_size"].to_numpy(), counted, max_bytes)
                opened = range(batch + 1, batch + 1 + len(starts))
                batch += len(starts)
                yield pd.DataFrame(
                    {"shard": name, "batch": opened, "first": part["_key"].to_numpy()[starts]}
                )

    meta = sharded.select("shard", F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size"))
    opened = (
        meta.repartition("shard")
        .sortWithinPartitions("shard", "_key")
        .mapInPandas(roll, f"shard string, batch bigint, first {key_type}")
    )
    files = opened.groupBy("shard").agg(F.collect_list("first").alias("_firsts"))
    placed = sharded.join(files, "shard", "left")
    batch = F.coalesce(F.size(F.filter("_firsts", lambda first: first <= F.col(key))), F.lit(0))
    return placed.withColumn("batch", batch.cast("bigint")).drop("_firsts")
