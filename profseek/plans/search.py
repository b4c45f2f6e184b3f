"""The search as one Spark plan, with the null search run first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.config import SearchConfig
from profseek.functions.shared import checkpointed, spread_rows
from profseek.operators import nulls, significance
from profseek.operators.distance import QueryBlocks, match_kmers, prepare_blocks
from profseek.operators.extend import extend_seeds
from profseek.operators.kmers import cap_profiles, query_windows
from profseek.operators.seeds import first_seeds, join_queries, scored_seeds
from profseek.operators.tiles import Sizes, TiledDb, is_long, tiled, tiled_long

SEED = ["query_id", "target_id", "target_ord", "q_start", "d_start"]
FIRST_NULL_POSITIONS = 65_536  # positions in the first round of null draws


@dataclass(frozen=True)
class Queries:
    """Query profiles with their packed windows."""

    profiles: DataFrame
    cells: int
    blocks: QueryBlocks

    @classmethod
    def prepare(cls, profiles: DataFrame, cfg: SearchConfig) -> "Queries":
        cells = profiles.agg(F.sum(F.length("bases")).alias("n")).first()["n"] or 0
        return cls(profiles, int(cells), prepare_blocks(query_windows(cap_profiles(profiles, cfg), cfg), cells, cfg))

    def only(self, ids: DataFrame, cfg: SearchConfig) -> "Queries":
        """The queries of those ids. Windows held in memory are masked, windows in files are written anew."""
        if self.blocks.broadcast is None:
            return Queries.prepare(checkpointed(self.profiles.join(ids, self.profiles["id"] == ids["query_id"], "left_semi")),
                                   cfg)
        names = {r["query_id"] for r in ids.toLocalIterator()}  # at most those of the windows in memory
        return Queries(self.profiles, self.cells, self.blocks.only(ids.sparkSession, names))


def with_record_keys(profiles: DataFrame) -> DataFrame:
    """Query profiles under the key of their record, `ord:name`, which stays apart where names repeat."""
    return profiles.withColumn("id", F.concat_ws(":", F.col("ord").cast("string"), "id"))


def with_record_names(frame: DataFrame) -> DataFrame:
    """`query_id` as the name again, and `query_ord` beside it."""
    colon = F.instr("query_id", ":")
    return frame.withColumns({
        "query_id": F.substring(F.col("query_id"), colon + 1, F.length("query_id")),
        "query_ord": F.substring(F.col("query_id"), F.lit(1), colon - 1).cast("long")})


def seeds_of(queries: Queries, db: TiledDb, cfg: SearchConfig) -> DataFrame:
    return scored_seeds(queries.profiles, queries.cells, db, queries.blocks, cfg)


def null_tiles(profiles: DataFrame, first: int, last: int, sizes: Sizes, cfg, index: DataFrame | None = None) -> TiledDb:
    """Tiles of the null draws first..last-1 of wide or long profiles; only a profile of one tile becomes a row."""
    drawn = nulls.draws(profiles, first, last, sizes.profiles, cfg, index)
    count = last - first
    expected = Sizes(count, count * sizes.cells // sizes.profiles, sizes.longest)
    if sizes.longest <= cfg.tile_len:
        return tiled(nulls.shuffled_rows(nulls.whole_draws(drawn), cfg), cfg, expected)
    rows = nulls.shuffled_positions(nulls.long_draws(drawn), cfg, sizes.longest)
    return tiled_long(rows, cfg, expected)


def null_seeds(queries: Queries, profiles: DataFrame, cfg: SearchConfig, sizes: Sizes | None = None,
               per_cell: float = 0.0) -> DataFrame:
    """The first `null_hsgs` positive seeds per query over the null database.

    The order is by draw, and draws are independent of each other, so only as many
    draws are made as the seeds need: a first round, then one sized by the yield so
    far, until every query has its seeds or the draws are used up. `per_cell`, the
    seeds of the poorest query per database position in the main search, sizes the
    first round; without it that round is small. Each round is stored once, and
    queries that have their seeds take no part in the next.
    """
    sizes = sizes or Sizes.of(profiles)
    if not sizes.profiles or not sizes.cells:
        raise ValueError("the database is empty")
    total = nulls.total_draws(sizes, cfg)
    index = checkpointed(nulls.numbered(profiles))
    cells = max(FIRST_NULL_POSITIONS, 1.25 * cfg.null_hsgs / per_cell if per_cell else 0)
    step = max(1, min(total, int(cells * sizes.profiles / sizes.cells)))
    rounds, at, open_queries = [], 0, queries
    while True:
        upto = min(total, at + step)
        tiles = null_tiles(profiles, at, upto, sizes, cfg, index)
        rounds.append(checkpointed(without_queries(seeds_of(open_queries, tiles, cfg))))
        if upto == total:
            break
        have = _union([r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")) for r in rounds]).groupBy("query_id").agg(
            F.sum("n").alias("n"))
        counts = checkpointed(queries.profiles.select(F.col("id").alias("query_id")).join(have, "query_id", "left").select(
            "query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < cfg.null_hsgs))
        left = counts.agg(F.count(F.lit(1)).alias("open"), F.min("n").alias("least")).first()
        if not left["open"]:
            break
        open_queries = queries.only(counts.select("query_id"), cfg)
        need = cfg.null_hsgs * upto // max(1, left["least"]) - upto
        at, step = upto, max(upto, need + need // 4)
    return with_queries(first_seeds(_union(rounds), cfg.null_hsgs), queries, cfg)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def without_queries(seeds: DataFrame) -> DataFrame:
    """Leave the query columns out of shuffles; they join again where they are needed."""
    return seeds.drop("q_values", "q_bases", "trim_start", "trim_end")


def with_queries(seeds: DataFrame, queries: Queries, cfg: SearchConfig) -> DataFrame:
    return join_queries(seeds, queries.profiles, queries.cells, cfg)


def null_fits(queries: Queries, null_source: DataFrame, cfg: SearchConfig, shuffled: bool = False,
              sizes: Sizes | None = None, per_cell: float = 0.0) -> DataFrame:
    """Gumbel parameters per query. `shuffled` marks a null database read from storage."""
    if shuffled:
        seeds = first_seeds(checkpointed(seeds_of(queries, tiled(null_source, cfg), cfg)), cfg.null_hsgs)
    else:
        seeds = null_seeds(queries, null_source, cfg, sizes, per_cell)
    return nulls.gumbel_fit(extend_seeds(spread_rows(seeds, *SEED), cfg, with_path=False))


def search_hits(query_profiles: DataFrame, db_profiles: DataFrame, cfg: SearchConfig,
                null_db: DataFrame | None = None, db: TiledDb | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Hits after significance, report filter and overlap removal; database profiles are wide or long rows.

    Records of one name are searched each for itself, told apart by `query_ord` and `target_ord`.
    """
    queries, sizes = Queries.prepare(with_record_keys(query_profiles), cfg), sizes or Sizes.of(db_profiles)
    null_source = db_profiles if null_db is None else null_db
    target = db or (tiled_long if is_long(db_profiles) else tiled)(db_profiles, cfg, sizes)
    # read several times below (hit counts, overlap sides): written once, and first, as its yield sizes the null search
    hits = checkpointed(extend_seeds(seeds_of(queries, target, cfg), cfg))
    found = hits.groupBy("query_id").count().agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n")).first()
    every = found["n"] and found["n"] == query_profiles.count()  # a query without hits says nothing of its yield
    per_cell = found["least"] / sizes.cells if every and sizes.cells else 0.0
    fits = checkpointed(null_fits(queries, null_source, cfg, null_db is not None, sizes, per_cell))
    scored = significance.with_evalue(significance.with_pvalue(hits, fits))
    kept = significance.remove_overlaps(significance.reportable(scored, cfg), cfg)
    return significance.with_status(with_record_names(kept), cfg)


def search(query_profiles: DataFrame, db_profiles: DataFrame, cfg: SearchConfig | None = None,
           null_db: DataFrame | None = None) -> DataFrame:
    """The result table."""
    cfg = cfg or SearchConfig()
    hits = search_hits(query_profiles, db_profiles, cfg, null_db)
    return significance.report_table(hits)


__all__ = ["Queries", "match_kmers", "null_fits", "null_seeds", "search", "search_hits", "seeds_of"]
