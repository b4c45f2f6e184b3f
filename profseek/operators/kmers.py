"""Query windows: extraction, trimming, completeness and complexity filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import capped, gini, has_missing, trim_range
from profseek.functions.shared import broadcast_if_small
from profseek.operators.tiles import pieces


def cap_profiles(profiles: DataFrame, cfg) -> DataFrame:
    return profiles.withColumn("reactivity", capped(F.col("reactivity"), cfg.max_reactivity))


def windows(profiles: DataFrame, cfg) -> DataFrame:
    """Every window on the offset grid that lies inside the trimmed range.

    The grid starts at position 0, not at the first present value.
    """
    k = cfg.kmer_len
    trimmed = profiles.withColumn("_trim", trim_range(F.col("reactivity"))).where(F.size("reactivity") >= k)
    grid = F.sequence(F.lit(0), F.size("reactivity") - k, F.lit(cfg.kmer_offset))
    kept = F.filter(grid, lambda i: (i >= F.col("_trim.start"))
                    & (i <= F.greatest(F.col("_trim.end") - k, F.lit(0))))
    return trimmed.withColumn("_i", F.explode(kept)).select(
        F.col("id").alias("query_id"), F.col("_i").cast("long").alias("q_pos"),
        F.slice("reactivity", F.col("_i") + 1, k).alias("values"),
        F.substring(F.col("bases"), F.col("_i") + 1, F.lit(k)).alias("window_bases"),
        F.size("reactivity").cast("long").alias("q_len"))


def trim_ranges(rows: DataFrame) -> DataFrame:
    """(id, start, end) of long rows, as `trim_range` gives it for one array."""
    there = F.when(F.col("reactivity").isNotNull(), F.col("pos"))
    return rows.groupBy("id").agg(
        F.coalesce(F.min(there), F.lit(0).cast("long")).alias("start"),
        F.coalesce(F.max(there) + 1, F.max("group_len")).alias("end"))


def windows_of_long(rows: DataFrame, cfg, size: int) -> DataFrame:
    """`windows` of long rows, cut from pieces of `size` positions."""
    k = cfg.kmer_len
    cut = pieces(rows, size, k - 1).join(broadcast_if_small(trim_ranges(rows)), F.col("target_id") == F.col("id"))
    at = cut.where(F.size("reactivity") >= k).withColumn("_i", F.explode(F.sequence(
        F.lit(0), F.least(F.col("core"), F.size("reactivity") - k + 1) - 1))).withColumn(
        "q_pos", F.col("tile") * size + F.col("_i"))
    inside = at.where((F.col("q_pos") % cfg.kmer_offset == 0) & (F.col("q_pos") >= F.col("start"))
                      & (F.col("q_pos") <= F.greatest(F.col("end") - k, F.lit(0))))
    return inside.select(
        F.col("id").alias("query_id"), "q_pos", F.slice("reactivity", F.col("_i") + 1, k).alias("values"),
        F.substring(F.col("bases"), F.col("_i") + 1, F.lit(k)).alias("window_bases"), F.col("target_len").alias("q_len"))


def complete_windows(found: DataFrame) -> DataFrame:
    return found.where(~has_missing(F.col("values")))


def complex_windows(found: DataFrame, cfg) -> DataFrame:
    return found.where(gini(F.col("values")) >= F.lit(float(cfg.kmer_min_complexity)))


def query_windows(profiles: DataFrame, cfg) -> DataFrame:
    """Windows of capped queries that take part in the search."""
    return complex_windows(complete_windows(windows(profiles, cfg)), cfg)
