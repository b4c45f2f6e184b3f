"""Dot-bracket structures as paired blocks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("l_start", "l_end", "r_start", "r_end")
BLOCKS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in NAMES]))


def _bracket_pairs(df: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """(keys, i, j) of matching brackets: the next bracket of the same depth is the partner.

    The depth is a running sum over the brackets; an opening one and the closing
    one that ends it have the same depth around them. A wrong character or an
    unbalanced bracket stops the query.
    """
    stop = lambda text: F.raise_error(F.lit(text)).cast("int")
    marks = df.select(*keys, F.posexplode(F.split(structure, "")).alias("at", "mark")).where("mark NOT IN ('.', '')")
    turn = F.when(F.col("mark") == "(", 1).when(F.col("mark") == ")", -1).otherwise(stop("invalid dot-bracket character"))
    along = Window.partitionBy(*keys).orderBy("at")
    depth = F.sum("turn").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opens = F.col("turn") > 0
    deep = marks.withColumn("turn", turn).withColumn("level", depth + F.when(opens, 0).otherwise(1))
    level = F.when(F.col("level") > 0, F.col("level")).otherwise(stop("unbalanced dot-bracket: closing without opening"))
    partner = F.lead("at").over(Window.partitionBy(*keys, "level").orderBy("at"))
    met = deep.withColumn("level", level).withColumn("j", partner).where(opens)
    return met.select(*keys, F.col("at").alias("i"), F.coalesce(
        "j", stop("unbalanced dot-bracket: opening without closing")).alias("j"))


def paired_blocks(df: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """(keys, l_start, l_end, r_start, r_end) of the maximal stems, as half-open ranges.

    Pairs that follow each other on both sides are one stem: islands of pairs in
    the order of their left bases.
    """
    along = Window.partitionBy(*keys).orderBy("i")
    apart = (F.col("i") != F.lag("i").over(along) + 1) | (F.col("j") != F.lag("j").over(along) - 1)
    pairs = _bracket_pairs(df, keys, structure).withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    stems = pairs.withColumn("stem", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return stems.groupBy(*keys, "stem").agg(
        F.min("i").alias("l_start"), (F.max("i") + 1).alias("l_end"), F.min("j").alias("r_start"),
        (F.max("j") + 1).alias("r_end")).drop("stem")


def with_blocks(df: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """`df` with the array `blocks` of its structures, by left start; `keys` identify its rows. Null stays null."""
    found = paired_blocks(df, keys, structure).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*NAMES))).cast(BLOCKS).alias("blocks"))
    none = F.when(F.col(structure).isNotNull(), F.array().cast(BLOCKS))
    return df.join(found, keys, "left").withColumn("blocks", F.coalesce("blocks", none))


def structure_text(blocks: Column, length: Column) -> Column:
    """Render blocks as a dot-bracket string: the stretches in their order, with what is between them."""
    side = lambda name, mark: F.transform(blocks, lambda b: F.struct(
        b[f"{name}_start"].alias("start"), b[f"{name}_end"].alias("end"), F.lit(mark).alias("mark")))
    kind = "array<struct<start:int,end:int,mark:string>>"
    parts = F.array_sort(F.concat(side("l", "(").cast(kind), side("r", ")").cast(kind)))
    ends = F.concat(F.array(F.lit(0)), F.transform(parts, lambda p: p["end"]))
    shown = F.zip_with(parts, F.slice(ends, 1, F.size(parts)), lambda p, end: F.concat(
        F.call_function("repeat", F.lit("."), p["start"] - end), F.call_function("repeat", p["mark"], p["end"] - p["start"])))
    rest = F.repeat(F.lit("."), (length - F.element_at(ends, -1)).cast("int"))
    return F.concat(F.array_join(shown, ""), rest)
