"""Command entry points: a full search with its outputs, and database dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profseek.config import SearchConfig
from profseek.functions.shared import checkpointed, ship_package
from profseek.operators import nulls, significance
from profseek.operators.fold import evaluate_folds
from profseek.operators.tiles import Sizes, wide_from_long
from profseek.plans.search import search_hits
from profseek.sinks import reports
from profseek.sources.load import load_profiles, load_sizes
from profseek.sources.native import write_native, write_native_file
from profseek.sources.text import read_query_text


def run_search(spark: SparkSession, database: str, query: str, output: str, cfg: SearchConfig | None = None,
               overwrite: bool = False, shuffled_db: str | None = None, dump_db: str | None = None,
               dump_shuffled_db: str | None = None, single_file: bool = False, fold_backend=None) -> DataFrame:
    """Search a query file against a database and write params.out, results.out and reports.

    Evaluating folds needs a folding function (see operators.fold). Invalid files
    of an XML folder are left out of the search, and each is warned of.
    """
    cfg = cfg or SearchConfig()
    if cfg.eval_align_fold and fold_backend is None:
        raise ValueError("evaluating folds needs a folding function: pass fold_backend")
    ship_package(spark)
    reports.prepare_output(output, overwrite)
    reports.write_text(f"{output}/params.out", cfg.to_toml())
    queries, db = read_query_text(spark, query), load_profiles(spark, database)
    null_db = load_profiles(spark, shuffled_db) if shuffled_db else None
    if dump_db or dump_shuffled_db:
        dump(db, dump_db, dump_shuffled_db, cfg)
    hits = checkpointed(search_hits(queries, db, cfg, null_db, sizes=load_sizes(spark, database, db)))
    if cfg.eval_align_fold:
        hits = checkpointed(evaluate_folds(hits, queries, db, cfg, fold_backend))
    table = significance.report_table(hits, cfg.eval_align_fold)
    reports.write_table(table, f"{output}/results.out", single_file)
    reports.write_reports(hits, queries, db, output, cfg)
    return table


def shuffled_profiles(profiles: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The null database as profiles; values are not capped."""
    sizes = Sizes.of(profiles)
    if not sizes.profiles or not sizes.cells:
        raise ValueError("the database is empty")
    drawn = nulls.draws(profiles, 0, nulls.total_draws(sizes, cfg), sizes.profiles, cfg)
    if sizes.longest <= cfg.tile_len:
        return nulls.shuffled_rows(drawn, cfg)
    rows = nulls.shuffled_positions(nulls.long_draws(drawn), cfg, sizes.longest)
    return wide_from_long(rows.withColumn("id", F.struct("id", "ord"))).select(
        F.col("id.id").alias("id"), F.col("id.ord").alias("ord"), "bases", "reactivity", "molecule")


def _write(profiles: DataFrame, path: str) -> None:
    """A path ending in .db is one file; .parquet is Parquet; anything else a folder of .db parts."""
    if path.endswith(".db"):
        write_native_file(profiles, path)
    elif path.endswith(".parquet"):
        profiles.write.mode("overwrite").parquet(path)
    else:
        write_native(profiles, path)


def dump(profiles: DataFrame, db_path: str | None, shuffled_path: str | None, cfg: SearchConfig | None = None) -> None:
    """Write the database and, if asked, its shuffled form."""
    cfg = cfg or SearchConfig()
    if db_path:
        _write(profiles, db_path)
    if shuffled_path:
        _write(shuffled_profiles(profiles, cfg), shuffled_path)
