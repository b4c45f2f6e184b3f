"""Profiles in the three shapes: long rows, one wide row, bounded tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import capped


SMALL_CELLS_PER_TASK = 1_000_000
PIECE = 8192  # positions of a profile that are gathered at once


@dataclass(frozen=True)
class Sizes:
    """Number of profiles, of positions, and the longest profile.

    Taken from the bases, which are as long as the values and an eighth of their bytes, or from long rows.
    """

    profiles: int
    cells: int
    longest: int

    @classmethod
    def of(cls, profiles: DataFrame) -> "Sizes":
        n = F.length("bases")
        if is_long(profiles):
            profiles, n = lengths(profiles), F.col("n")
        row = profiles.agg(F.count(F.lit(1)).alias("p"), F.sum(n.cast("long")).alias("c"), F.max(n).alias("m")).first()
        return cls(int(row["p"]), int(row["c"] or 0), int(row["m"] or 0))


def balanced(df: DataFrame, cells: int, *keys: str) -> DataFrame:
    """Spread a small input over all cores; a large one keeps its many partitions.

    A few megabytes would else end in one task, although the work per position is
    large. Large inputs are not shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if cells < cores * SMALL_CELLS_PER_TASK else df


@dataclass(frozen=True)
class TiledDb:
    """Database tiles, whether some profile needs more than one, and the number of positions."""

    tiles: DataFrame
    has_long: bool
    cells: int


def is_long(profiles: DataFrame) -> bool:
    """Whether profiles come as one row per position."""
    return "pos" in profiles.columns


def lengths(rows: DataFrame) -> DataFrame:
    """(id, ord, n) of long rows; no profile is gathered."""
    return rows.groupBy("id", "ord").agg(F.max("group_len").alias("n"))


def long_from_wide(profiles: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.split("bases", "").alias("base"), F.col("reactivity").alias("value"))
    return profiles.select("id", "ord", F.posexplode(pairs).alias("pos", "p")).select(
        "id", "ord", F.col("pos").cast("long").alias("pos"), F.col("p.base").alias("base"),
        F.col("p.value").alias("reactivity"))


def wide_from_long(rows: DataFrame) -> DataFrame:
    """One row per profile; for results and files that hold a profile as one record.

    Cells are packed piece by piece before the pieces of a profile meet, so a group holds the record and no more.
    """
    cells = F.array_sort(F.collect_list(F.struct("pos", "base", "reactivity")))
    packed = rows.withColumn("piece", F.floor(F.col("pos") / PIECE)).groupBy("id", "piece").agg(cells.alias("c")).select(
        "id", F.struct("piece", F.array_join(F.col("c.base"), "").alias("b"), F.col("c.reactivity").alias("v")).alias("p"))
    return (
        packed.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p"))
        .select("id", F.lit(0).cast("long").alias("ord"),
                F.array_join(F.col("p.b"), "").alias("bases"),
                F.flatten(F.col("p.v")).alias("reactivity"), F.lit("DNA").alias("molecule"))
    )


def _tile_ids(pos, tile_len: int, halo: int):
    """The tile that owns a position, and the one before it whose halo reaches it."""
    own = F.floor(pos / tile_len).cast("long")
    return F.when((own > 0) & (pos % tile_len < halo), F.array(own, own - 1)).otherwise(F.array(own))


def pieces(rows: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Pieces of `size` positions and `halo` more from (id, ord, pos, group_len, base, reactivity)."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "base", "reactivity")))
    return (
        rows.withColumn("tile", F.explode(_tile_ids(F.col("pos"), size, halo)))
        .groupBy("id", "ord", "tile")
        .agg(cells.alias("c"), F.max("group_len").alias("target_len"))
        .select(
            F.col("id").alias("target_id"), F.col("ord").alias("target_ord"), "target_len", "tile",
            F.least(F.lit(size), F.col("target_len") - F.col("tile") * size).cast("int").alias("core"),
            F.array_join(F.col("c.base"), "").alias("bases"), F.col("c.reactivity").alias("reactivity"))
    )


def tiles_from_long(rows: DataFrame, cfg) -> DataFrame:
    """Tiles from long rows, capped; no group exceeds a tile."""
    cut = pieces(rows, cfg.tile_len, cfg.kmer_len - 1)
    return cut.withColumn("reactivity", capped(F.col("reactivity"), cfg.max_reactivity))


def tiles_from_wide(profiles: DataFrame, cfg, has_long: bool = True) -> DataFrame:
    """Tiles cut out of wide rows; a narrow projection, capped on the way."""
    size, halo = cfg.tile_len, cfg.kmer_len - 1
    n = F.size("reactivity")
    base = profiles.withColumn("target_len", n.cast("long"))
    if not has_long:
        return base.select(
            F.col("id").alias("target_id"), F.col("ord").alias("target_ord"), "target_len",
            F.lit(0).cast("long").alias("tile"), n.cast("int").alias("core"), "bases",
            capped(F.col("reactivity"), cfg.max_reactivity).alias("reactivity"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size).cast("int"), F.lit(0)))
    cut = base.withColumn("tile", F.explode(starts.cast("array<bigint>")))
    at = (F.col("tile") * size + 1).cast("int")
    return cut.select(
        F.col("id").alias("target_id"), F.col("ord").alias("target_ord"), "target_len", "tile",
        F.least(F.lit(size), F.col("target_len") - F.col("tile") * size).cast("int").alias("core"),
        F.substring(F.col("bases"), at, F.lit(size + halo)).alias("bases"),
        capped(F.slice("reactivity", at, F.lit(size + halo)), cfg.max_reactivity).alias("reactivity"))


def stretch(tile, cfg):
    """Number of the run of tiles that are dealt together: PIECE positions, or one tile that is as long."""
    return F.floor(tile / max(1, PIECE // cfg.tile_len)).cast("long")


def _balanced_tiles(tiles: DataFrame, sizes: Sizes, cfg) -> TiledDb:
    """Tiles of one stretch of a target stay in one task, so that what is summed over them is summed there."""
    stretched = tiles.withColumn("_stretch", stretch(F.col("tile"), cfg))
    spread = balanced(stretched, sizes.cells, "target_id", "target_ord", "_stretch").drop("_stretch")
    return TiledDb(spread, sizes.longest > cfg.tile_len, sizes.cells)


def tiled(profiles: DataFrame, cfg, sizes: Sizes | None = None) -> TiledDb:
    """Tile wide profiles; without known sizes one pruned scan finds them."""
    sizes = sizes or Sizes.of(profiles)
    return _balanced_tiles(tiles_from_wide(profiles, cfg, sizes.longest > cfg.tile_len), sizes, cfg)


def tiled_long(rows: DataFrame, cfg, sizes: Sizes) -> TiledDb:
    return _balanced_tiles(tiles_from_long(rows, cfg), sizes, cfg)
