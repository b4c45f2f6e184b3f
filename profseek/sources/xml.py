"""XML profiles: one transcript per file, read with Spark's XML source."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profseek.functions.shared import broadcast_if_small, checkpointed
from profseek.operators.numbering import number_all
from profseek.sources.text import NUMBER, parse_values

LOG = logging.getLogger(__name__)

_TEXTS = T.ArrayType(T.StringType())
_OTHER = T.StructField("xs_any", _TEXTS)  # child elements outside the schema


def _group(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _TEXTS) for n in names]


_SOURCE = T.StructType([*_group("citation", "pmid"), _OTHER])
_META = T.StructType([*_group("organism", "probe", "replicate", "condition"),
                      T.StructField("source", T.ArrayType(_SOURCE)), _OTHER])
_TRANSCRIPT = T.StructType([T.StructField("_id", T.StringType()), *_group("sequence", "reactivity"), _OTHER])
ROOT = T.StructType([T.StructField("meta-data", T.ArrayType(_META)),
                     T.StructField("transcript", T.ArrayType(_TRANSCRIPT)), _OTHER,
                     T.StructField("_corrupt", T.StringType())])


def _filled(column: str):
    """Text contents that are not blank."""
    return F.filter(F.coalesce(F.col(column), F.array().cast(_TEXTS)), lambda x: x.isNotNull() & ~x.rlike(r"^\s*$"))


def parse_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with a NULL `error` where the file holds a valid profile."""
    reader = (spark.read.format("xml").schema(ROOT).option("rowTag", "data").option("wildcardColName", "xs_any")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
              .option("inferSchema", "false").option("pathGlobFilter", "*.[xX][mM][lL]"))
    rows = reader.load(path).withColumn("file", F.col("_metadata.file_path"))
    one = F.col("transcript")[0]
    flat = rows.select(
        "file", "_corrupt", F.size("transcript").alias("n"), one["_id"].alias("id"),
        one["sequence"].alias("s"), one["reactivity"].alias("r"),
        F.flatten(F.array(
            F.coalesce("xs_any", F.array().cast(_TEXTS)), F.coalesce(one["xs_any"], F.array().cast(_TEXTS)),
            F.flatten(F.transform(F.coalesce(F.col("meta-data"), F.array().cast(T.ArrayType(_META))),
                                  lambda m: F.coalesce(m["xs_any"], F.array().cast(_TEXTS)))))).alias("other"))
    flat = flat.withColumn("s", _filled("s")).withColumn("r", _filled("r"))
    bases = F.regexp_replace(F.try_element_at("s", F.lit(1)), r"\s", "")
    tokens = F.transform(F.split(F.try_element_at("r", F.lit(1)), ","),
                         lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    ready = flat.withColumn("raw", bases).withColumn("tokens", tokens)
    error = (
        F.when(F.col("_corrupt").isNotNull(), "malformed file")
        .when(F.size("other") > 0, "unexpected tag")
        .when(F.coalesce(F.col("n"), F.lit(0)) < 1, "missing transcript")
        .when(F.col("n") > 1, "multiple transcripts")
        .when(F.col("id").isNull(), "missing transcript id")
        .when(F.size("s") < 1, "missing sequence").when(F.size("s") > 1, "multiple sequences")
        .when(F.size("r") < 1, "missing reactivity").when(F.size("r") > 1, "multiple reactivities")
        .when(~F.col("raw").rlike("^[ACGTUN]*$"), "invalid sequence")
        .when(F.exists("tokens", lambda t: ~t.rlike(NUMBER)), "invalid reactivity")
        .when(F.length("raw") != F.size("tokens"), "sequence and reactivity differ in length"))
    return ready.withColumn("error", error).select(
        "file", "id", F.translate("raw", "U", "T").alias("bases"),
        F.when(F.col("error").isNull(), parse_values(F.col("tokens"))).alias("reactivity"), "error")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(path)
            .select(F.col("_metadata.file_path").alias("file")))


def _invalid(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, error) of the files without a valid profile among the parsed rows."""
    return files.join(rows.select("file", "error", F.lit(True).alias("seen")), "file", "left").select(
        "file", F.when(F.col("seen").isNull(), "missing data tag").otherwise(F.col("error")).alias("error")
    ).where(F.col("error").isNotNull())


def problems(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no valid profile, with the reason."""
    return _invalid(_files(spark, path), parse_xml(spark, path))


def read_xml(spark: SparkSession, path: str, skip_invalid: bool = False) -> DataFrame:
    """Profiles from a file (a bad one fails) or a folder (bad ones are skipped), numbered in the order of the files.

    A folder is parsed once and the parsed rows are stored; each bad file among
    them is named in a warning.
    """
    rows = parse_xml(spark, path).withColumn("ord", F.lit(0).cast("long"))
    if skip_invalid:
        files, rows = checkpointed(number_all(_files(spark, path), "file")), checkpointed(rows)
        for bad in _invalid(files, rows).toLocalIterator():
            LOG.warning("left out %s: %s", bad["file"], bad["error"])
        rows = rows.where(F.col("error").isNull()).drop("ord").join(broadcast_if_small(files), "file")
    stop = F.raise_error(F.concat(F.lit("cannot read "), F.col("file"), F.lit(": "), F.col("error")))
    kept = [F.when(F.col("error").isNull(), F.col(c)).otherwise(stop.cast(rows.schema[c].dataType)).alias(c)
            for c in ("id", "bases", "reactivity")]
    return rows.select(kept[0], "ord", kept[1], kept[2], F.lit("DNA").alias("molecule"))
