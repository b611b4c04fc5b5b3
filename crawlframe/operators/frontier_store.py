"""The frontier kept between rounds: a store bucketed by URL, counts kept by signed deltas.

Each version of the store is a table bucketed on (site, uri); a round reads the last version without an
exchange, since its other sides (links found, URLs fetched) are hash-partitioned on the same keys into as
many parts, removes what was fetched, adds what is new and writes the next version in the same layout.
Buckets follow the URL, not the site alone, so a site with a third of all URLs is spread over all of them.

Pending counts per site are a second table, bucketed by site, one row per site: a round adds +1 for each
URL it admits and -1 for each waiting URL it fetches, folds these deltas by site ahead of the shuffle, and
joins them to the counts of the last version; the old URLs are never counted again. Sites whose count falls
to zero leave the table. Each version is written to the shared folder and named in the catalog; a version's
tables are dropped once the next is written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class FrontierStore:
    name: str
    version: int
    buckets: int = BUCKETS

    @property
    def uris(self) -> str:
        return f"{self.name}_uris_{self.version}"

    @property
    def counts(self) -> str:
        return f"{self.name}_counts_{self.version}"


def _save(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A managed table of the session's warehouse, the folder executors share: dropping it deletes it."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def create(spark: SparkSession, name: str, buckets: int = BUCKETS) -> FrontierStore:
    """An empty store, version 0; its tables are named ``name``, a fresh suffix and the version."""
    store = FrontierStore(f"{name}_{uuid.uuid4().hex[:12]}", 0, buckets)
    _save(spark.createDataFrame([], "site string, uri string"), store.uris, buckets, "site", "uri")
    _save(spark.createDataFrame([], "site string, pending bigint"), store.counts, buckets, "site")
    return store


def waiting(spark: SparkSession, store: FrontierStore) -> DataFrame:
    return spark.table(store.uris)


def pending(spark: SparkSession, store: FrontierStore) -> DataFrame:
    return spark.table(store.counts)


def advance(store: FrontierStore, added: DataFrame, fetched: DataFrame) -> FrontierStore:
    """The next version: ``added`` (site, uri) admitted once each, ``fetched`` (site, uri) taken out."""
    spark = added.sparkSession
    old = spark.table(store.uris)
    keys = ["site", "uri"]
    # The new sides are dealt as the store is bucketed, so the store is read without an exchange.
    found = added.select(*keys).where(F.col("site").isNotNull() & F.col("uri").isNotNull())
    found = found.repartition(store.buckets, *keys).dropDuplicates(keys)
    taken = fetched.select(*keys).repartition(store.buckets, *keys).dropDuplicates(keys)
    fresh = found.join(old, keys, "left_anti").join(taken, keys, "left_anti")
    gone = old.join(taken, keys, "left_semi")
    kept = old.join(taken, keys, "left_anti")
    nxt = FrontierStore(store.name, store.version + 1, store.buckets)
    _save(kept.unionByName(fresh), nxt.uris, store.buckets, *keys)
    deltas = fresh.select("site", F.lit(1).alias("d")).unionByName(gone.select("site", F.lit(-1).alias("d")))
    deltas = deltas.groupBy("site").agg(F.sum("d").alias("d"))
    counts = spark.table(store.counts).join(deltas, "site", "full_outer").select(
        "site", (F.coalesce("pending", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("bigint").alias("pending")
    )
    _save(counts.where(F.col("pending") > 0), nxt.counts, store.buckets, "site")
    spark.sql(f"DROP TABLE IF EXISTS {store.uris}")
    spark.sql(f"DROP TABLE IF EXISTS {store.counts}")
    return nxt


def drop(spark: SparkSession, store: FrontierStore) -> None:
    """Delete the store's last version."""
    spark.sql(f"DROP TABLE IF EXISTS {store.uris}")
    spark.sql(f"DROP TABLE IF EXISTS {store.counts}")
