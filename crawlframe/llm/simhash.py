"""Near-duplicates by 64-bit SimHash: positional byte index, count filter, components.

Two fingerprints that differ in at most two bits share at least six of their eight
positional bytes, and so at least two of the four byte pairs (0,1) (2,3) (4,5) (6,7). Each
distinct fingerprint is posted under its six choices of two byte pairs: a posting is four
positional bytes, because lists of a single byte hold a 256th of all fingerprints and their
pairs grow with the square. The members of a posting list are tallied by shared positional
bytes; pairs with six or more are verified by their differing bits.

Posting lists of over ``SHORT_LIST`` members (a large group of near copies) are not paired.
Their members are linked exactly by another rule without pairs: two fingerprints differ in
at most two bits if and only if the balls of radius one about them meet. Every member is
posted under the 65 points of its ball; at most 65 fingerprints share a point, all of them
lie within two bits of each other, and each is linked to the smallest.

Nulls and repeats: null and wordless texts have fingerprint zero, which links like any
other; repeated rows get equal results; a null id never names a component unless no member
has an id. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import map_batches, packed, unpacked
from crawlframe.session import stored

#: Longest posting list whose pairs are formed (2016 pairs at most).
SHORT_LIST = 64
#: Shingles hashed at once, so that very long texts need no more memory.
SHINGLES = 1 << 16
#: Differing bits of a link; the index and the balls are built for two.
BITS = 2
BYTE_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """Majority of the XXH64 bits of all word shingles, as an unsigned number."""
    found = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(first), SHINGLES):
        pairs = zip(first[k : k + SHINGLES], last[k : k + SHINGLES], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp bigint): the fingerprint's bits as a signed number."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(t or b"", words, seed) for t in batch.column(1).to_pylist()]
        fp = pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), fp], names=[id_col, "fp"])

    slim = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    return map_batches(slim, work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def shared_bytes(a, b):
    """How many of the eight positional bytes are equal."""
    other = a.bitwiseXOR(b)
    same = [(F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8)]
    return sum(same[1:], same[0])


def links(fps: DataFrame) -> DataFrame:
    """Links (a < b) that join all distinct ``fp`` within ``BITS`` into their groups.

    Short posting lists give every pair; long lists give stars with the same components.
    """
    pair = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535))
    keys = [
        F.struct(F.lit(n).alias("slot"), F.shiftleft(pair(i), 16).bitwiseOR(pair(j)).alias("bytes"))
        for n, (i, j) in enumerate(BYTE_PAIRS)
    ]
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.slot", "p.bytes", "fp")
    sizes = posted.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = posted.join(sizes, ["slot", "bytes"])

    lists = listed.where(F.col("n") <= SHORT_LIST).groupBy("slot", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    near = lambda a, b: (b > a) & (shared_bytes(a, b) >= 8 - BITS) & (F.bit_count(a.bitwiseXOR(b)) <= BITS)
    partners = lambda a: F.transform(
        F.filter("m", lambda b: near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )
    short = lists.select(F.explode(F.flatten(F.transform("m", partners))).alias("l")).select("l.a", "l.b")

    hot = listed.where(F.col("n") > SHORT_LIST).select("fp").distinct()
    flips = [F.lit((1 << i) - ((1 << 64) if i == 63 else 0)) for i in range(64)]
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(flip) for flip in flips])
    met = hot.select("fp", F.explode(ball).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("m"))
    star = (
        met.where(F.size("m") > 1)
        .select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
        .where("a < b")
    )
    return short.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn, until nothing changes. A step joins the links
    of a node with its one minimum, so the links of a hub can be split among tasks. Every
    round is a table in the shared folder.
    """
    seen, now = None, stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp, component_id) for every document; see the module's text."""
    rows = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = fps.join(components(links(fps)), fps.fp == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root")
    )
    named = roots.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows.join(roots.join(named, "root").select("fp", "component_id"), "fp")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Documents are named by id and hash of their text, so that rows without id and different texts under one
    id are apart; rows without id come after those with one, and of equal names one row stays.
    """
    name = lambda: F.struct(F.col(id_col).isNull().alias("bare"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    rows = near_duplicates(docs.select(name().alias("_name"), text_col), "_name", text_col, **how)
    kept = rows.select(F.col("component_id.id").alias("_kept"), F.col("component_id.text").alias("_kept_text")).distinct()
    # Other columns travel in one struct, so none of them can clash with the names used here.
    named = packed(docs, id_col, text_col).withColumn("_text_hash", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_text_hash") == F.col("_kept_text"))
    chosen = named.join(kept, same, "left_semi").dropDuplicates([id_col, "_text_hash"])
    return unpacked(chosen, docs.columns, **{id_col: F.col(id_col), text_col: F.col(text_col)})
