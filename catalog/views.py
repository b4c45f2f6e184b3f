"""Profiles derived from the driver's tables, in Spark and as DuckDB SQL.

Database: one profile per user, the user's events in time order; the event type
is the base, value / 100 the measurement. Queries: one profile per event type, a
whole-number mix of all values of each six-hour slot, missing where a slot is
empty; the hour of the slot is the base. Every row of the table enters both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profseek.config import SearchConfig
from profseek.operators.numbering import number_positions
from profseek.operators.tiles import Sizes, wide_from_long

CFG = SearchConfig(kmer_len=8, kmer_min_complexity=0.2, kmer_max_match_every_nt=5, max_kmer_dist=20,
                   inclusion_evalue=1.0, report_evalue=10.0, null_hsgs=2000)
SLOT_SECONDS = 6 * 3600
MIX = 15013
BASES = {"view": "A", "click": "C", "purchase": "G", "signup": "T"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def db_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, Sizes]:
    """(id, ord, pos, group_len, base, reactivity) of the database and its sizes."""
    base = F.lit("N")
    for kind, letter in BASES.items():
        base = F.when(F.col("event_type") == kind, letter).otherwise(base)
    rows = events(spark, sf).select(
        F.col("user_id").cast("string").alias("id"), "ts", "event_id", base.alias("base"),
        F.when(F.col("event_id") % 97 != 0, F.col("value") / 100.0).alias("reactivity"))
    per_user = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    size = per_user.agg(F.sum("n").alias("cells"), F.max("n").alias("most"), F.count(F.lit(1)).alias("users")).first()
    sizes = Sizes(int(size["users"]), int(size["cells"] or 0), int(size["most"] or 0))
    numbered = number_positions(rows, ["id"], ["ts", "event_id"], largest=int(size["most"] or 0))
    return numbered.select("id", F.lit(0).cast("long").alias("ord"), "pos", "group_len", "base", "reactivity"), sizes


def query_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Long rows of the query profiles: every event type on every slot of the table's time span."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    slot = F.floor(micros / F.lit(SLOT_SECONDS * 1_000_000)).cast("long")
    # sums of whole numbers, so that every value counts and both engines agree whatever the order
    mixed = F.pmod(F.sum(F.floor(F.col("value") * 100.0).cast("long")), F.lit(MIX)).cast("double") / 100.07
    opened = events(spark, sf).withColumn("slot", slot).groupBy("event_type", "slot").agg(mixed.alias("value"))
    span = opened.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    slots = F.sequence(F.lit(span["lo"]), F.lit(span["hi"]))
    grid = opened.select("event_type").distinct().select("event_type", F.explode(slots).alias("slot"))
    letter = F.element_at(F.array(*[F.lit(c) for c in "ACGT"]), (F.col("slot") % 4 + 1).cast("int"))
    return grid.join(opened, ["event_type", "slot"], "left").select(
        F.col("event_type").alias("id"), (F.col("slot") - F.lit(span["lo"])).alias("pos"), letter.alias("base"),
        (F.col("value") / 100.0).alias("reactivity"))


def query_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return wide_from_long(query_rows(spark, sf))
