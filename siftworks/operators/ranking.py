"""Row numbers within groups of any size.

A window sorts a whole group in one task.  Here a group is first cut into buckets
that follow the wanted order; rows are numbered within a bucket, and the number of
rows in earlier buckets is added.  Only one row per (group, bucket) is ever
brought together, so a group holding a third of all rows still spreads out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.session import staged


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    name: str = "rank",
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add ``name``: the 1-based position of a row among rows with equal ``keys``, sorted by ``order``.

    ``bucket`` must not decrease along ``order``; ``keys`` must not be NULL.
    ``attach`` holds at most one row per key; its other columns are left-joined
    along the same spread-out way.
    """
    groups = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket)
    local = bucketed.withColumn("_local", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*groups)
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    if attach is not None:
        offsets = offsets.join(attach, list(keys), "left")
    joined = local.join(offsets, groups).withColumn(name, F.col("_local") + F.col("_before"))
    return joined.drop("_bucket", "_local", "_before")


def ranked_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """The same positions from one sort by ranges, for orders that no bucket follows; the sorted rows are stored once.

    ``order`` must tell rows apart, or equal ones be interchangeable; nulls in ``keys`` are a group of their own.
    """
    sort = [*keys, *order]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(ranged, "ranges")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    parts = placed.groupBy(*keys, "_part").agg(F.min("_nth").alias("_first"), F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1
    names = [F.col(k).alias(f"_of_{k}") for k in keys]
    shifts = staged(parts.select(*names, F.col("_part").alias("_of_part"), shift.alias("_shift")), "shifts")
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = placed.join(shifts, same).withColumn(name, F.col("_nth") + F.col("_shift"))
    return joined.select(*df.columns, name)
