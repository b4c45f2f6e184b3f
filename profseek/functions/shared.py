"""Reliable intermediate storage in the folder that the session names."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a private one only for a local session that sets none, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="profseek-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame, label: str = "stored", metrics: Observation | None = None, **observed: Column) -> DataFrame:
    """Cut the lineage through a Parquet copy in the shared folder, which outlives lost executors.

    Later reads fetch the columns they need. The schema is known, so reading
    starts no job. `metrics` gets the observed aggregates of the rows written.
    """
    path = fresh_path(df.sparkSession, label)
    watched = df.observe(metrics, *[c.alias(name) for name, c in observed.items()]) if metrics else df
    watched.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a broadcast side may hold at most: rows, and bytes of the relation that the driver builds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
_ROW_OVERHEAD = 32


def rows_and_bytes(df: DataFrame, rows: int | None = None) -> tuple[int, int]:
    """Number of rows, counted unless given, and an upper estimate of their bytes in memory.

    Numbers have a fixed size; strings, arrays and the like are measured over all rows.
    """
    fixed, varying = _ROW_OVERHEAD, []
    for field in df.schema.fields:
        fixed += 8
        if not isinstance(field.dataType, (NumericType, BooleanType, DateType, TimestampType)):
            varying.append(F.length(F.to_json(F.struct(F.col(f"`{field.name}`")))))
    if rows is None or varying:
        size = sum(varying, F.lit(0)).cast("long")
        rows, measured = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    else:
        measured = 0
    return rows, rows * fixed + (measured or 0)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark rows for broadcast when their number and their bytes are bounded; else leave them to shuffle.

    Without the mark Spark would shuffle the large side too, because it cannot
    tell the size of checkpoints and Python stages beforehand.
    """
    rows, size = rows_and_bytes(df, rows)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def spread_rows(df: DataFrame, *keys: str, wide: bool = False) -> DataFrame:
    """Distribute rows with heavy work each over all cores, also when they are few bytes.

    `wide` marks rows that grow with the database and uses all shuffle partitions.
    """
    spark = df.sparkSession
    n = 2 * spark.sparkContext.defaultParallelism
    if wide:
        n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: What a kernel takes from an Arrow batch at once; Spark's own batches hold up to 64 MB.
SLICE_BYTES = 4 << 20


def sliced(batches, size: int = SLICE_BYTES):
    """Slices of Arrow batches of about `size` bytes, one row at least, without copies.

    What a kernel makes of its input is a multiple of it, so this bounds a Python worker
    whatever the number of rows that Spark puts into a batch.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch  # not held while Spark sends the next one


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    context = spark.sparkContext
    if getattr(context, "_profseek_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    folder = pathlib.Path(tempfile.mkdtemp(prefix="profseek-code-"))
    archive = folder / "profseek.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._profseek_shipped = True


def file_uri(path: str) -> str:
    """A URI that Arrow file systems accept, from a Spark path."""
    if path.startswith("s3a://"):
        return "s3://" + path[len("s3a://"):]
    if path.startswith("file:/"):
        return "file://" + path[len("file:"):].replace("///", "/", 1)
    if "://" not in path:
        return "file://" + str(pathlib.Path(path).resolve())
    return path


def filesystem(path: str):
    """(file system, path inside it) for use inside tasks."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(file_uri(path))
