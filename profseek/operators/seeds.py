"""Seeds: collinear hits grouped per diagonal, scored, and the target part each one needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profseek.functions.scalars import capped, seed_score, tolerance_span, trim_range
from profseek.operators.distance import QueryBlocks, long_hits, reached_islands
from profseek.operators.tiles import TiledDb

KEY = ["query_id", "target_id", "target_ord"]


def with_diagonal(hits: DataFrame) -> DataFrame:
    return hits.withColumn("diag", F.col("q_pos") - F.col("d_pos"))


def islands(hits: DataFrame, cfg) -> DataFrame:
    """Gaps and islands per diagonal: a start-to-start step above the gap opens a new group."""
    line = Window.partitionBy(*KEY, "diag").orderBy("q_pos")
    step = F.col("q_pos") - F.lag("q_pos").over(line)
    return (
        with_diagonal(hits)
        .withColumn("_new", F.when(step <= cfg.group_gap, 0).otherwise(1))
        .withColumn("_group", F.sum("_new").over(line))
        .groupBy(*KEY, "diag", "_group")
        .agg(F.min("q_pos").alias("q_first"), F.max("q_pos").alias("q_last"), F.count(F.lit(1)).alias("n_kmers"))
        .drop("_group")
    )


def as_seeds(groups: DataFrame, cfg, *extra: str) -> DataFrame:
    """Inclusive ranges of groups with enough windows."""
    k = cfg.kmer_len
    return groups.where(F.col("n_kmers") >= cfg.min_kmers).select(
        *KEY, F.col("q_first").alias("q_start"), (F.col("q_last") + k - 1).alias("q_end"),
        (F.col("q_first") - F.col("diag")).alias("d_start"), (F.col("q_last") - F.col("diag") + k - 1).alias("d_end"),
        "n_kmers", *extra)


def query_side(queries: DataFrame, cfg) -> DataFrame:
    """Capped query rows with their trimmed range, ready to join by id."""
    values = capped(F.col("reactivity"), cfg.max_reactivity)
    return queries.select(
        F.col("id").alias("query_id"), values.alias("q_values"), F.col("bases").alias("q_bases"),
        trim_range(F.col("reactivity")).alias("t")).select(
        "query_id", "q_values", "q_bases", F.col("t.start").alias("trim_start"), F.col("t.end").alias("trim_end"))


def join_queries(seeds: DataFrame, queries: DataFrame, query_cells: int, cfg) -> DataFrame:
    side = query_side(queries, cfg)
    if query_cells * 10 <= cfg.query_block_bytes:
        side = F.broadcast(side)
    return seeds.join(side, "query_id")


def attach_target_parts(seeds: DataFrame, db: TiledDb, cfg) -> DataFrame:
    """Fetch, for seeds in long targets, the reachable part of the target from its tiles.

    Each seed visits the few tiles its reach covers; the part is bounded by the
    query length, whatever the target length.
    """
    size = cfg.tile_len
    tiles = db.tiles.where(F.col("target_len") > size)
    lens = tiles.where("tile = 0").select("target_id", "target_ord", "target_len")
    room = F.greatest(F.size("q_values") - 1 - F.col("q_end"), F.lit(0)).cast("long")
    spans = (
        seeds.join(lens, ["target_id", "target_ord"])
        .withColumn("t_from", F.greatest(
            F.col("d_start") - tolerance_span(F.col("q_start"), cfg.align_len_tolerance), F.lit(0)).cast("long"))
        .withColumn("t_to", F.least(F.col("d_end") + 1 + tolerance_span(room, cfg.align_len_tolerance),
                                    F.col("target_len")))
    )
    first, last = F.floor(F.col("t_from") / size), F.floor((F.col("t_to") - 1) / size)
    visits = spans.drop("q_values", "q_bases").withColumn("tile", F.explode(F.sequence(first, last)))
    own = tiles.select("target_id", "target_ord", "tile", "core", "bases", "reactivity")
    met = visits.join(own, ["target_id", "target_ord", "tile"])
    at = F.greatest(F.col("t_from") - F.col("tile") * size, F.lit(0)).cast("int")
    to = F.least(F.col("t_to") - F.col("tile") * size, F.col("core").cast("long")).cast("int")
    pieces = met.select(
        *spans.drop("q_values", "q_bases").columns, "tile",
        F.slice("reactivity", at + 1, to - at).alias("v"), F.substring(F.col("bases"), at + 1, to - at).alias("b"))
    keys = [c for c in spans.columns if c not in ("q_values", "q_bases")]
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile", "v", "b"))).alias("p"))
    return whole.select(*[c for c in keys if c != "t_to"], F.flatten(F.col("p.v")).alias("t_values"),
                        F.array_join(F.col("p.b"), "").alias("t_bases"))


def scored_seeds(queries: DataFrame, query_cells: int, db: TiledDb, blocks: QueryBlocks, cfg) -> DataFrame:
    """Seeds with a positive score, carrying the query and the reachable target part."""
    parts = ["target_len", "t_from", "t_bases", "t_values"]
    seeds = join_queries(as_seeds(reached_islands(db, blocks, cfg), cfg, *parts), queries, query_cells, cfg)
    if db.has_long:
        found = join_queries(as_seeds(islands(long_hits(db, blocks, cfg), cfg), cfg), queries, query_cells, cfg)
        trimmed = attach_target_parts(found.drop("trim_start", "trim_end"), db, cfg)
        seeds = seeds.unionByName(join_queries(trimmed, queries, query_cells, cfg))
    return positive_seeds(seeds, cfg)


def with_seed_score(seeds: DataFrame, cfg) -> DataFrame:
    n = (F.col("q_end") - F.col("q_start") + 1).cast("int")
    q_at = (F.col("q_start") + 1).cast("int")
    t_at = (F.col("d_start") - F.col("t_from") + 1).cast("int")
    return seeds.withColumn("seed_score", seed_score(
        F.slice("q_values", q_at, n), F.slice("t_values", t_at, n), cfg,
        F.substring(F.col("q_bases"), q_at, n), F.substring(F.col("t_bases"), t_at, n)))


def positive_seeds(seeds: DataFrame, cfg) -> DataFrame:
    return with_seed_score(seeds, cfg).where(F.col("seed_score") > 0)


def first_seeds(seeds: DataFrame, limit: int) -> DataFrame:
    """The leading seeds per query in the order target, diagonal, position; `seeds` should be stored.

    A distributed prefix limit: seeds are counted per (query, target), a running
    sum over those counts finds the target in which the limit falls, and only the
    seeds of that one target are ranked. No group holds more than one target's
    seeds, or one count per target.
    """
    draw = ["query_id", "target_ord", "target_id"]
    counts = seeds.groupBy(*draw).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("query_id").orderBy("target_ord", "target_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    room = limit - (F.sum("_n").over(upto) - F.col("_n"))
    wanted = counts.select(*draw, "_n", room.alias("_room")).where("_room > 0")
    met = seeds.join(wanted, draw)
    order = Window.partitionBy(*draw).orderBy(F.col("q_start") - F.col("d_start"), "q_start")
    last = met.where("_n > _room").withColumn("_rn", F.row_number().over(order)).where("_rn <= _room").drop("_rn")
    return met.where("_n <= _room").unionByName(last).drop("_n", "_room")
