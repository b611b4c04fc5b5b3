"""As-of join: each probe finds the first row of its key at or after its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Windows work on one key and one stretch of this many seconds at a time.
STRETCH_S = 3600


def asof_next(rows: DataFrame, probes: DataFrame, stretch_s: int = STRETCH_S) -> DataFrame:
    """(pid, next_id): for each probe (pid, key, ts) the row (id, key, ts) of its key with the least ``ts`` not before it.

    A row at the probe's very time counts; rows of equal time are taken by ``id``. Probes without such a row get
    a null ``next_id``. A key with a third of all rows is not one task's work: rows and probes are ordered within
    (key, stretch of time); a probe with no later row in its stretch looks for the first later stretch that
    has one, over a table of one row per (key, stretch). The scans run backwards in time, so each window
    grows row by row and is worked out in one pass.
    """
    second = lambda c: F.col(c).cast("long")
    stretch = lambda c: F.floor(second(c) / stretch_s)
    found = rows.select("key", second("ts").alias("t"), stretch("ts").alias("s"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pid"), "id")
    asked = probes.select("key", second("ts").alias("t"), stretch("ts").alias("s"), F.lit(0).alias("kind"), "pid", F.lit(None).cast("long").alias("id"))
    # Backwards in time, rows before probes at equal times, so a row at the probe's time is in its frame.
    back = Window.partitionBy("key", "s").orderBy(F.col("t").desc(), F.col("kind").desc(), F.col("id").desc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = found.unionByName(asked).withColumn("next_id", F.last("id", ignorenulls=True).over(back))
    near = both.where(F.col("kind") == 0).select("pid", "key", "s", "next_id")
    firsts = found.groupBy("key", "s").agg(F.min(F.struct("t", "id"))["id"].alias("first_id"))
    open_ = near.where(F.col("next_id").isNull())
    # One row per (key, stretch): later stretches come first, and a probe's own stretch after the probe.
    later = Window.partitionBy("key").orderBy(F.col("s").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = firsts.select("key", "s", F.lit(0).alias("kind"), "first_id").unionByName(
        open_.select("key", "s").distinct().select("key", "s", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first_id"))
    ).withColumn("later_id", F.last("first_id", ignorenulls=True).over(later)).where(F.col("kind") == 1)
    far = open_.join(steps.select("key", "s", "later_id"), ["key", "s"], "left").select("pid", F.col("later_id").alias("next_id"))
    return near.where(F.col("next_id").isNotNull()).select("pid", "next_id").unionByName(far)
