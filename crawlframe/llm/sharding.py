"""Shards along a Hilbert curve over a document's metadata, in built-in expressions only.

Several dimensions are quantised to ``bits`` bits and woven to the index of the Hilbert
curve through their grid. Documents are put in the order of the curve and cut into runs of equally many
rows (law ``rows``: counts at most one apart), so that neighbours in all dimensions share files
and the files' minima and maxima prune on any of them.

The rank along the curve is found without one task seeing all rows: the order is cut into
pieces (cell, part of the text's hash, block of ids), rows are numbered within their piece, and only
counts of pieces are summed up. The index is an automaton: at each level, from the top
bit down, the state and one bit of each dimension give the next digit and state.

Nulls and repeats: a null source, language or id has a place of its own at the start of its dimension;
a null text has no bytes and the checksum of the empty text; repeated rows get places of their own next to each
other; copies of one text lie in the same cell, next to each other by blocks of ids, and are cut where a
shard is full. With fewer rows than shards some shards are empty. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.ordered import split_rank

SHARDS = 24
BITS = 5
OVERHEAD = 8
#: Ids of a block of this many are numbered by one task.
ID_BLOCK_BITS = 12


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for ``state * 2**n + bits``; a state is (entry corner, direction)."""
    mask = (1 << n) - 1
    turn_left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    rank = {g: w for w, g in enumerate(gray)}
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    ones = lambda w: (w ^ (w + 1)).bit_length() - 1  # noqa: E731  trailing ones
    step = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(1 << n)]
    digits, states = [], []
    for e in range(1 << n):
        for d in range(n):
            for bits in range(1 << n):
                w = rank[turn_left(bits ^ e, n - (d + 1) % n)]
                digits.append(w)
                states.append((e ^ turn_left(entry[w], d + 1)) * n + (d + step[w] + 1) % n)
    return digits, states


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of whole numbers below ``2**bits``."""
    n = len(dims)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions or more, and 62 bits in all at most")
    digits, states = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))
    # One number for each level, from the top: a bit of each dimension.
    levels = F.array(*[
        sum((F.shiftright(x.cast("int"), b).bitwiseAND(F.lit(1)) * (1 << j) for j, x in enumerate(dims)), F.lit(0))
        for b in reversed(range(bits))
    ])
    at = lambda acc, level: acc["state"] * (1 << n) + level
    walk = lambda acc, level: F.struct(
        (acc["index"] * (1 << n) + F.get(digits, at(acc, level))).alias("index"), F.get(states, at(acc, level)).alias("state")
    )
    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, walk, lambda acc: acc["index"])


def name_cell(value: Column, bits: int = BITS) -> Column:
    """Equal names share a cell; null has cell 0."""
    return F.coalesce(F.crc32(value.cast("string")) % ((1 << bits) - 1) + 1, F.lit(0)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Two cells for each doubling; the last one holds all larger sizes."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(2 * F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 6)).cast("int")


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    names: tuple[str, ...] = ("source", "lang"),
    carry: bool = False,
) -> DataFrame:
    """(id, size, text_crc32, cell, shard, slot), and all columns of ``docs`` in ``row`` if ``carry``."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint") + OVERHEAD
    dims = [*(name_cell(F.col(c)) for c in names), size_cell(size)]
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        hilbert_index(dims).alias("cell"),
        F.xxhash64(text).alias("_hash"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("_id"),
        *carried,
    )
    rows = rows.withColumns({"_part": F.shiftright("_hash", 56), "_block": F.shiftright("_id", ID_BLOCK_BITS)})
    order = ["cell", "_part", "_block", "_hash", "_id"]
    placed = split_rank(rows, [], order, [F.col("cell"), F.col("_part"), F.col("_block")], name="_rank")
    total, rank = docs.count(), F.col("_rank") - 1
    shard = F.expr(f"(_rank - 1) * {shards} div {max(total, 1)}")
    # The first rank of shard s is the least r with r * shards div total = s.
    first = F.expr(f"(shard * {max(total, 1)} + {shards} - 1) div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", rank - first)
    return out.select("doc_id", "size", "text_crc32", "cell", F.col("shard").cast("int"), "slot", *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """The documents as Parquet folders ``shard=…`` in the order of their slots; bodies are shuffled twice.

    A shard's rows are dealt to tasks by ranges of slots, so a shard may be of several files.
    """
    placed = assign(docs, shards, carry=True, **how)
    ranged = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.select("shard", "slot", "row.*").write.partitionBy("shard").parquet(path)
