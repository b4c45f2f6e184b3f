"""Row numbers that do not need one task per key or one task for the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profseek.functions.shared import checkpointed

HOT_GROUP_ROWS = 4_000_000


def dense_ordinals(df: DataFrame, *keys: str, digits: int = 3) -> DataFrame:
    """Number distinct rows 0..n-1 in the order of the digest of their keys.

    The leading hex digits of the digest are even buckets. Each bucket is
    numbered on its own and shifted by the size of the buckets before it; the
    bucket table has at most 16**digits rows.
    """
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    tagged = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_digest", *keys)
    return (
        tagged.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("dense_ord", (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_digest", "_bucket", "_rank", "_offset")
    )


def largest_group(df: DataFrame, *keys: str) -> int:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
    return int(row["m"] or 0)


def _numbered_by_window(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys)
    return (
        df.withColumn("pos", (F.row_number().over(group.orderBy(*order)) - 1).cast("long"))
        .withColumn("group_len", F.count(F.lit(1)).over(group))
    )


def _numbered_by_range(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Range-partition on key and order, so that a hot key spreads over many tasks."""
    parts = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    parts = checkpointed(parts)  # fixes the range bounds for both uses below
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_len"),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        parts.withColumn("_rank", F.row_number().over(within))
        .join(sizes, [*keys, "_part"])
        .withColumn("pos", (F.col("_offset") + F.col("_rank") - 1).cast("long"))
        .drop("_part", "_rank", "_offset")
    )


def number_all(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Number all rows 0..n-1 in the given order, which must have no ties, over many tasks."""
    numbered = _numbered_by_range(df.withColumn("_all", F.lit(0)), ["_all"], list(order))
    return numbered.withColumnRenamed("pos", name).drop("_all", "group_len")


def number_positions(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_GROUP_ROWS,
                     largest: int | None = None) -> DataFrame:
    """Add `pos` (0-based rank within the key) and `group_len`.

    Ordinary keys use one window. Keys above `hot_rows` are split by range.
    `largest` is the known size of the biggest group, if the caller has it.
    """
    if largest is None:
        largest = largest_group(df, *keys)
    if largest <= hot_rows:
        return _numbered_by_window(df, keys, order)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    cold_rows = df.join(hot, keys, "left_anti")
    hot_rows_df = df.join(hot, keys, "left_semi")
    return _numbered_by_window(cold_rows, keys, order).unionByName(_numbered_by_range(hot_rows_df, keys, order))
