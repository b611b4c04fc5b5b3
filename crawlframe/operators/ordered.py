"""Ranks over keys of any size.

A window over a key that holds a third of all rows is one task's work. Here each key's
order is cut into pieces by a column that never decreases along that order: pieces are
worked on apart, and only one row per piece is carried across them. Rows are shuffled
once, by key and piece; joining the carried rows back needs no further shuffle of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(keys: Sequence[str]) -> dict[str, Column]:
    """Never-null stand-ins for ``keys``, so that plain equality joins keep null keys together."""
    return {f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)}


def before(*keys: str, order: str):
    """Window over the rows of ``keys`` ahead of the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def split_rank(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    splits: Sequence[Column],
    name: str = "rn",
    per_key: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in its key's order.

    ``splits`` goes from coarse to fine; each must never decrease along ``order`` within
    the one before it. With no keys the coarsest split bounds the one-task part: it sees
    one row per coarse value. Columns of ``per_key`` (unique by keys) are added on the
    way, joined to the pieces and not to the rows.
    """
    marks = {f"_split{i}": split for i, split in enumerate(splits)}
    stands = by_key(keys)
    cut = rows.withColumns({**stands, **marks})
    piece = [*stands, *marks]
    local = Window.partitionBy(*piece).orderBy(*order)
    ranked = cut.withColumn(name, F.row_number().over(local).cast("bigint"))

    sizes = cut.groupBy(*piece).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.withColumn("_before", F.lit(0).cast("bigint"))
    for depth in range(len(marks), 0, -1):
        inner = piece[: len(stands) + depth]
        level = sizes if depth == len(marks) else sizes.groupBy(*inner).agg(F.sum("_rows").alias("_rows"))
        ahead = F.coalesce(F.sum("_rows").over(before(*inner[:-1], order=inner[-1])), F.lit(0))
        if depth == len(marks):
            offsets = level.select(*inner, ahead.alias("_before"))
        else:
            offsets = offsets.join(level.select(*inner, ahead.alias("_ahead")), inner, "left").withColumn(
                "_before", F.col("_before") + F.coalesce("_ahead", F.lit(0))
            ).drop("_ahead")
    if per_key is not None:
        added = [c for c in per_key.columns if c not in keys]
        offsets = offsets.join(per_key.select(*[c.alias(n) for n, c in by_key(keys).items()], *added), list(stands), "left")
    placed = ranked.join(offsets, piece, "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", *piece)
