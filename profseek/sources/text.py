"""Query text: records of a name line, a base line and a comma-separated value line.

Blank lines may precede a name. Lines are read in splits and numbered from
per-split counts, so a large file is parsed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, before, line): 1-based line number and the count of non-blank lines before it.

    `earlier` counts the records of the files before.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"),
        (~F.col("value").rlike(r"^\s*$")).cast("long").alias("full"))
    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("f"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                           F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("f0"))
    files = sizes.groupBy("file").agg(F.ceil(F.sum("f") / 3).alias("records"))  # one row per file
    sooner = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.join(files.select("file", F.coalesce(F.sum("records").over(sooner), F.lit(0)).alias("earlier")), "file")
    here = Window.partitionBy("file", "split").orderBy("seq")
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    return (
        lines.withColumn("rn", F.row_number().over(here))
        .withColumn("fb", F.coalesce(F.sum("full").over(above), F.lit(0)))
        .join(offsets, ["file", "split"])
        .select("file", (F.col("n0") + F.col("rn")).alias("row"), (F.col("f0") + F.col("fb")).alias("before"),
                "line", "full", "earlier")
    )


def parse_values(tokens: Column) -> Column:
    """Single-precision values; NaN and the sentinel become NULL."""
    def one(token):
        x = token.try_cast("float").cast("double")
        return F.when(~(F.isnan(x) | (x == F.lit(-999.0))), x)

    return F.transform(tokens, one)


def _base_error(token: Column, lead: Column, row: Column) -> Column:
    """First letter outside the alphabet, or the one that mixes T with U."""
    good = F.length(F.regexp_extract(token, "^[ACGTUN]*", 0))
    t, u = F.locate("T", token), F.locate("U", token)
    far = F.length(token) + 1
    bad = F.least(F.when(good < F.length(token), good + 1).otherwise(far),
                  F.when((t > 0) & (u > 0), F.greatest(t, u)).otherwise(far))
    return F.when(bad < far, F.format_string("invalid sequence base at line %d and column %d", row, lead + bad))


def parse_records(lines: DataFrame) -> DataFrame:
    """One row per record with an `error` text, NULL for a valid record."""
    state, full = F.col("before") % 3, F.col("full") == 1
    named = lines.where(full | (state != 0)).withColumn("rec", F.floor(F.col("before") / 3))

    def pick(n: int, value: str) -> Column:
        return F.min(F.when(full & (state == n), F.col(value)))

    grouped = named.groupBy("file", "rec").agg(
        pick(0, "line").alias("name"), pick(0, "row").alias("row"), F.min("earlier").alias("earlier"), pick(1, "line").alias("seq"),
        pick(2, "line").alias("vals"), F.min(F.when(~full & (state == 1), F.col("row"))).alias("gap1"),
        F.min(F.when(~full & (state == 2), F.col("row"))).alias("gap2"))
    token = F.regexp_extract("seq", r"^\s*(\S*)", 1)
    lead = F.length(F.regexp_extract("seq", r"^\s*", 0))
    tokens = F.split(F.regexp_replace("vals", r"\s+$", ""), ",")
    parsed = grouped.select(
        "file", "rec", "row", "earlier", F.regexp_replace("name", r"^\s+|\s+$", "").alias("id"), token.alias("raw"),
        lead.alias("lead"), tokens.alias("tokens"), "seq", "vals", "gap1", "gap2")
    bad = F.array_position(F.transform("tokens", lambda t: t.rlike(NUMBER)), False)
    before = F.aggregate(F.slice("tokens", F.lit(1), (bad - 1).cast("int")), F.lit(0), lambda s, t: s + F.length(t))
    lengths = F.format_string(
        "unmatching lengths between sequence (%d) and reactivities (%d) for query starting at line %d",
        F.length("raw"), F.size("tokens"), F.col("row"))
    value_error = "invalid reactivity at line %d and column %d"
    error = F.coalesce(
        F.when(F.col("gap1").isNotNull(), F.format_string("unexpected empty sequence at line %d", F.col("gap1"))),
        F.when(F.col("seq").isNull(), F.lit("file truncated, expected sequence")),
        _base_error(F.col("raw"), F.col("lead"), F.col("row") + 1),
        F.when(F.col("gap2").isNotNull(), F.format_string(value_error, F.col("gap2"), F.lit(1))),
        F.when(F.col("vals").isNull(), F.lit("file truncated, expected reactivities")),
        F.when(bad > 0, F.format_string(value_error, F.col("row") + 2, (before + bad).cast("int"))),
        F.when(F.length("raw") != F.size("tokens"), lengths))
    kind = F.when(F.col("raw").contains("T"), "DNA").when(F.col("raw").contains("U"), "RNA").otherwise("UNKNOWN")
    return parsed.withColumn("error", error).select(
        "file", "id", (F.col("rec") + F.col("earlier")).cast("long").alias("ord"), F.translate("raw", "U", "T").alias("bases"),
        F.when(F.col("error").isNull(), parse_values(F.col("tokens"))).alias("reactivity"),
        kind.alias("molecule"), "row", "error")


def fail_on_error(records: DataFrame) -> DataFrame:
    """Stop on the first bad record that is met; good records lose the error column."""
    stop = F.raise_error(F.col("error"))
    guard = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(
        stop.cast(records.schema[c].dataType))
    # each column on its own, so no plan that prunes some of them passes a bad record
    return records.select(*[guard(c).alias(c) for c in ("id", "ord", "bases", "reactivity", "molecule")])


def read_query_text(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Query profiles; `permissive` keeps bad records with their error instead of failing."""
    records = parse_records(numbered_lines(spark, path))
    return records if permissive else fail_on_error(records)
