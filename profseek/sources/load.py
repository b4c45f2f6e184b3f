"""Choose the reader of a database by its path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profseek.functions.shared import filesystem
from profseek.operators.numbering import number_all
from profseek.operators.tiles import Sizes
from profseek.sources.native import native_sizes, read_native
from profseek.sources.xml import read_xml


def _kind(path: str) -> str:
    from pyarrow.fs import FileSelector, FileType

    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    name = inner.rstrip("/").rsplit("/", 1)[-1]
    if info.type == FileType.Directory:
        names = [f.path.lower() for f in fs.get_file_info(FileSelector(inner))]
        if any(n.endswith(".db") for n in names):
            return "native"
        if any(n.endswith(".parquet") for n in names):
            return "parquet"
        return "xml folder"
    if "." not in name:
        raise ValueError("db file does not have an extension")
    extension = name.rsplit(".", 1)[-1].lower()
    if extension == "db":
        return "native"
    if extension in ("xml", "parquet"):
        return extension
    raise ValueError(f'extension "{extension}" is not valid for a db')


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Database profiles from .db, .xml, a folder of XML or .db files, or Parquet."""
    kind = _kind(path)
    if kind == "native":
        return read_native(spark, path)
    if kind == "parquet":
        return _told_apart(spark.read.parquet(path))
    return read_xml(spark, path, skip_invalid=kind == "xml folder")


def _told_apart(profiles: DataFrame) -> DataFrame:
    """Parquet profiles with their own ordinals, or with new ones in that order if two records share name and ordinal."""
    repeated = profiles.groupBy("id", "ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return profiles
    place = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    order = number_all(profiles.select("ord", *[c.alias(k) for k, c in place.items()]), "ord", "_file", "_row", name="_new")
    return profiles.withColumns(place).join(order.select(*place, "_new"), [*place]).withColumn("ord", F.col("_new")).select(
        *profiles.columns)


def load_sizes(spark: SparkSession, path: str, profiles: DataFrame) -> Sizes:
    """Sizes of a loaded database by the cheapest way its format allows."""
    return native_sizes(spark, path) if _kind(path) == "native" else Sizes.of(profiles)


def first_by_id(profiles: DataFrame) -> DataFrame:
    """Reports look up a record by name and take the first of several equal names."""
    columns = [c for c in profiles.columns if c not in ("id", "ord")]
    first = F.min_by(F.struct(*columns), F.col("ord")).alias("r")
    return profiles.groupBy("id").agg(first).select("id", *[F.col(f"r.{c}").alias(c) for c in columns])
