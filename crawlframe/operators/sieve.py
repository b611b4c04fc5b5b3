"""A sieve ahead of ``drop_viewed``: a blocked Bloom filter of handled paths in Spark bitmaps.

Handled (site, path) keys are hashed to one block of 32 768 bits and to ``hashes`` bits inside it; a block
is a Spark bitmap (``bitmap_construct_agg``), built with partial aggregation and stored as one row. Adding
handled paths ORs the new blocks into the old (``bitmap_or_agg``), so the filter is extended without reading
the old paths again. A candidate joins the one block of its key: if any of its bits is clear, it was never
handled; if all are set it is a hit, and only hits are checked exactly against the handled table (a semi
join, where Spark broadcasts the hits when they are few). Results equal ``drop_viewed`` with ``key="path"``.

The number of blocks is fixed when the filter is made, from the paths it should hold at ``bits_per_key``;
holding more only raises the share of false hits, which are counted and never change a result. Keys are
spread over blocks by their hash, so a site with a third of all paths is spread too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls

BLOCK_BITS = 32768
HASHES = 7
BITS_PER_KEY = 12


def _key(df: DataFrame) -> DataFrame:
    return df.select("*", urls.path("uri").alias("_path"))


def _bits(blocks: int, hashes: int) -> tuple[Column, Column]:
    """Block number (from 1) and the bit positions in it of ``(site, _path)``."""
    first = F.xxhash64("site", "_path")
    second = F.xxhash64(F.lit("sieve"), "site", "_path")
    block = (F.pmod(first, F.lit(blocks)) + 1).cast("long")
    # Double hashing inside the block: bit i is h2 + i * h3 modulo the block's bits.
    h2, h3 = F.pmod(second, F.lit(BLOCK_BITS)), F.pmod(F.shiftright(second, 16), F.lit(BLOCK_BITS - 1)) * 2 + 1
    bits = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h2 + i * h3, F.lit(BLOCK_BITS)))
    return block, bits


def blocks_for(expected_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, math.ceil(expected_keys * bits_per_key / BLOCK_BITS))


def build(handled: DataFrame, blocks: int, hashes: int = HASHES) -> DataFrame:
    """(block, bitmap) of handled (site, uri)."""
    block, bits = _bits(blocks, hashes)
    rows = _key(handled).select(block.alias("block"), F.explode(bits).alias("bit"))
    # A block's bit q is the bitmap's position q + 1 of bucket 1.
    return rows.groupBy("block").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))


def extend(filters: DataFrame, handled: DataFrame, blocks: int, hashes: int = HASHES) -> DataFrame:
    """The filter with more handled paths ORed in."""
    return filters.unionByName(build(handled, blocks, hashes)).groupBy("block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


def sieve(candidates: DataFrame, filters: DataFrame, handled: DataFrame, blocks: int, hashes: int = HASHES) -> DataFrame:
    """Candidates (site, uri, ...) whose (site, path) was not handled; column ``_hit`` tells sieve hits."""
    block, bits = _bits(blocks, hashes)
    probes = _key(candidates).withColumn("_block", block).withColumn("_bits", bits)
    looked = probes.join(filters.withColumnRenamed("block", "_block"), "_block", "left")
    hit = F.coalesce(F.forall("_bits", lambda b: _is_set(F.col("bitmap"), b)), F.lit(False))
    looked = looked.withColumn("_hit", hit).drop("_block", "_bits", "bitmap")
    misses = looked.where(~F.col("_hit"))
    seen = _key(handled).select("site", "_path").distinct()
    kept_hits = looked.where(F.col("_hit")).join(seen, ["site", "_path"], "left_anti")
    return misses.unionByName(kept_hits).drop("_path")
