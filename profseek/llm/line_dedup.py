"""Line dedup by distinct-site spread: HyperLogLog sketches of the sites of every line.

Lines are text between line feeds that holds a word. Their 128-bit digests are
grouped; each group merges a sketch of the sites it stands on and keeps its
smallest document. A sketch far above the wanted spread decides at once, one far
below it clears the line; near the threshold the distinct sites are counted
exactly. A line that spreads over enough sites is boilerplate: it goes from every
document but that of the smallest id that holds it, so nothing disappears from
the corpus altogether. Sketches and counts are grouped with
map-side combining, so one very common line is no burden.

Null texts stay null, empty texts empty; a text that loses all its lines is
empty and its row stays. A null site counts as no site. Rows that repeat an id
are treated alike. Other columns pass through untouched, whatever their names.
Empty tables give empty results. Line breaks are kept as they were between the
lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import broadcast_if_small
from profseek.llm.components import stored
from profseek.llm.rows import packed

#: Sketches have 2^SKETCH registers; counts within a factor of NEAR of the threshold are counted exactly.
SKETCH = 10
NEAR = 2.0


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def widespread_lines(df: DataFrame, min_sites: int, id_col: str = "doc_id", text: str = "text",
                     site: str = "source") -> DataFrame:
    """(line digest, first document, sites) of lines on at least min_sites sites; sites is estimated far above."""
    lines = df.select(F.col(id_col).alias("id"), F.col(site).alias("site"), F.explode(F.split(text, "\n")).alias("line")) \
        .filter(_has_word(F.col("line"))).select("id", "site", _digest(F.col("line")).alias("line"))
    # a line on one site only is none: it drops out before any sketch is built
    spread = lines.groupBy("line").agg(F.min("id").alias("first"), F.min("site").alias("a"), F.max("site").alias("b"),
                                       F.count("site").alias("n"))
    some = stored(spread.filter((F.col("a") != F.col("b")) & (F.col("n") >= min_sites)).select("line", "first"), "spread")
    met = stored(lines.join(broadcast_if_small(some.select("line")), "line", "left_semi")
                 .filter(F.col("site").isNotNull()).select("line", "site"), "met")
    sketched = met.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH)).alias("sketch"))
    judged = stored(sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")), "sketched")
    sure = judged.filter(F.col("sites") > NEAR * min_sites)
    near = judged.filter((F.col("sites") <= NEAR * min_sites) & (F.col("sites") >= min_sites / NEAR))
    exact = met.join(broadcast_if_small(near.select("line")), "line", "left_semi").select("line", "site").distinct() \
        .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact).join(some, "line")


def without_widespread_lines(df: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text: str = "text",
                             site: str = "source") -> DataFrame:
    """`row` as it came, `text` without boilerplate lines, `n_lines` and `n_removed` of those with a word."""
    gone = stored(widespread_lines(df, min_sites, id_col, text, site).select("line", "first"), "gone")
    rows = packed(df, id=id_col)
    value = F.col("row")[text]
    here = rows.select("id", F.explode(F.split(value, "\n")).alias("line")).filter(_has_word(F.col("line"))) \
        .select("id", _digest(F.col("line")).alias("line"))
    held = here.join(broadcast_if_small(gone), "line").filter(~F.col("id").eqNullSafe(F.col("first"))) \
        .groupBy(F.col("id").alias("of")).agg(F.collect_set("line").alias("drop"))
    marked = rows.join(held, F.col("id").eqNullSafe(F.col("of")), "left").select(
        "row", "drop", F.filter(F.split(value, "\n"), _has_word).alias("with_word"), F.when(
            F.col("drop").isNotNull(), F.filter(F.split(value, "\n"), lambda x: ~(
                _has_word(x) & F.array_contains("drop", _digest(x))))).alias("stay"), F.split(value, "\n").alias("lines"))
    text_now = F.when(F.col("drop").isNull(), value).otherwise(F.array_join("stay", "\n"))
    removed = F.when(F.col("drop").isNull(), 0).otherwise(F.size("lines") - F.size("stay"))
    return marked.select("row", text_now.alias("text"), F.coalesce(F.size("with_word"), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"))


def drop_widespread_lines(df: DataFrame, min_sites: int = 6, id_col: str = "doc_id", text: str = "text",
                          site: str = "source") -> DataFrame:
    """The input with its texts freed of boilerplate lines; same columns, same rows."""
    found = without_widespread_lines(df, min_sites, id_col, text, site)
    return found.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])
