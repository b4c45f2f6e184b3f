"""One Spark query per operator, over whole tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views
from catalog.views import CFG
from profseek.functions import scalars as S
from profseek.functions.shared import checkpointed, fresh_path, ship_package
from profseek.operators import columns, dotbracket, gapped, kmers, nulls, seeds, significance, tiles
from profseek.operators.distance import distance_profiles, kmer_names, match_kmers, reached_islands, window_stats
from profseek.operators.extend import extend_seeds
from profseek.plans import search
from profseek.plans.run import shuffled_profiles
from profseek.sinks import reports
from profseek.sources.load import first_by_id, load_profiles
from profseek.sources.native import read_native, write_native
from profseek.sources.profile_files import register
from profseek.sources.text import read_query_text

# gaps and drop-off switched off: an extension is then the best prefix sum on each side
UNGAPPED = CFG.replace(align_gap_open_penalty=-1e6, align_gap_ext_penalty=-1e6, align_max_drop_off_rate=0.0)
# the default penalties scaled to short profiles
GAPPED = CFG.replace(align_gap_open_penalty=-2.0, align_gap_ext_penalty=-0.5)


class Source:
    """Inputs of one session and data folder, prepared once."""

    def __init__(self, spark: SparkSession, sf: str):
        ship_package(spark)
        self.spark, self.sf = spark, sf
        self._prepared = {}

    @cached_property
    def _rows(self):
        return views.db_rows(self.spark, self.sf)

    @property
    def rows(self) -> DataFrame:
        """One row per position."""
        return self._rows[0]

    @property
    def sizes(self) -> tiles.Sizes:
        return self._rows[1]

    @cached_property
    def db(self) -> DataFrame:
        """One row per profile, for queries whose results are whole profiles."""
        return tiles.wide_from_long(self._rows[0])

    @cached_property
    def queries(self) -> DataFrame:
        return views.query_profiles(self.spark, self.sf)

    def tiles(self, cfg=CFG):
        return tiles.tiled_long(self._rows[0], cfg, self.sizes)

    def prepared(self, cfg=CFG) -> search.Queries:
        if cfg not in self._prepared:
            self._prepared[cfg] = search.Queries.prepare(self.queries, cfg)
        return self._prepared[cfg]

    def hits(self, cfg=CFG) -> DataFrame:
        return match_kmers(self.tiles(cfg), self.prepared(cfg).blocks, cfg)

    def seeds(self, cfg=CFG) -> DataFrame:
        return search.seeds_of(self.prepared(cfg), self.tiles(cfg), cfg)

    def all_seeds(self, cfg=CFG) -> DataFrame:
        """Seeds of any score."""
        parts = ["target_len", "t_from", "t_bases", "t_values"]
        found = seeds.as_seeds(reached_islands(self.tiles(cfg), self.prepared(cfg).blocks, cfg), cfg, *parts)
        return seeds.with_seed_score(seeds.join_queries(found, self.queries, self.prepared(cfg).cells, cfg), cfg)

    def extended(self, cfg=CFG) -> DataFrame:
        return extend_seeds(self.seeds(cfg), UNGAPPED.replace(tile_len=cfg.tile_len))

    def gapped(self) -> DataFrame:
        """Gapped hits from seed scores of six digits: ties between steps are common, and the last bits of a sum
        would decide them."""
        return extend_seeds(self.seeds().withColumn("seed_score", r6("seed_score")), GAPPED)

    def significant(self, hits: DataFrame | None = None) -> DataFrame:
        """Hits, ungapped unless given, with E-values; the fit uses the seed scores, so that SQL can repeat it."""
        hits = checkpointed(self.extended() if hits is None else hits)
        fits = nulls.gumbel_fit(hits.select("query_id", F.col("seed_score").alias("score")))
        return significance.with_evalue(significance.with_pvalue(hits, fits))

    def reported(self, hits: DataFrame | None = None) -> DataFrame:
        kept = significance.remove_overlaps(significance.reportable(self.significant(hits), CFG), CFG)
        return significance.with_status(kept, CFG)


_SOURCES: dict[tuple[str, str], Source] = {}


def source(spark: SparkSession, sf: str) -> Source:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SOURCES:
        _SOURCES[key] = Source(spark, sf)
    return _SOURCES[key]


def r6(col):
    return F.round(col, 6)


def L(name: str):
    return F.col(name).cast("long")


REGISTRY = {}


def query(fn):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(source(spark, sf))

    run.__doc__ = fn.__doc__
    REGISTRY[fn.__name__] = run
    return fn


# --- arrays and scalars -------------------------------------------------------

@query
def cap(s: Source):
    """Clip values, keeping missing ones."""
    v = S.capped(F.array("reactivity"), CFG.max_reactivity)[0]
    return s.rows.select("id", L("pos").alias("pos"), r6(v).alias("capped"))


@query
def trim_range(s: Source):
    """First and last present value per profile."""
    own = s.queries.select("id", S.trim_range(F.col("reactivity")).alias("t")).select("id", "t.start", "t.end")
    return kmers.trim_ranges(s.rows).unionByName(own)


@query
def kmer_windows(s: Source):
    """Windows on a grid of step 3 inside the trimmed range."""
    found = kmers.windows_of_long(s.rows, CFG.replace(kmer_offset=3), tiles.PIECE)
    n_missing = F.size(F.filter("values", lambda x: x.isNull())).cast("long")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return found.select("query_id", "q_pos", "window_bases", n_missing.alias("n_missing"), r6(total).alias("total"))


@query
def missing_filter(s: Source):
    """Complete windows per profile."""
    return kmers.complete_windows(kmers.windows_of_long(s.rows, CFG, tiles.PIECE)).groupBy("query_id").agg(F.count("*").alias("n_windows"))


@query
def gini_complexity(s: Source):
    """Gini index of complete windows."""
    found = kmers.complete_windows(kmers.windows_of_long(s.rows, CFG, tiles.PIECE)).withColumn(
        "values", S.capped(F.col("values"), CFG.max_reactivity))
    return found.select("query_id", "q_pos", r6(S.gini(F.col("values"))).alias("gini"))


@query
def query_kmers(s: Source):
    """Query windows that enter the search."""
    found = kmers.query_windows(kmers.cap_profiles(s.queries, CFG), CFG)
    return found.select("query_id", "q_pos", "window_bases", "q_len")


@query
def gc_fraction(s: Source):
    """Share of C and G in whole texts."""
    docs = s.spark.read.parquet(f"{s.sf}/documents.parquet")
    return docs.select("doc_id", r6(S.gc_fraction(F.col("text"))).alias("gc"))


@query
def hamming(s: Source):
    """Positional differences between the bases of users n and n + 1."""
    a = tiles.pieces(s.rows, tiles.PIECE).select(
        F.col("target_id").alias("id"), F.col("target_id").cast("long").alias("user"), "tile", "bases")
    b = a.select((F.col("user") - 1).alias("user"), "tile", F.col("bases").alias("next_bases"))
    part = S.hamming(F.col("bases"), F.col("next_bases"))
    return a.join(b, ["user", "tile"]).groupBy("id").agg(F.sum(part).alias("distance"))


def _steps(s: Source):
    """Neighbouring cells of a profile."""
    cut = tiles.pieces(s.rows, tiles.PIECE, 1)
    pairs = F.arrays_zip(F.split("bases", "").alias("b"), F.col("reactivity").alias("v"),
                         F.split(F.expr("substring(bases, 2)"), "").alias("b2"),
                         F.expr("slice(reactivity, 2, size(reactivity))").alias("v2"))
    cells = cut.select(F.col("target_id").alias("id"), F.col("target_len").alias("n"), "tile", "core",
                       F.posexplode(pairs).alias("at", "p")).where(F.col("at") < F.col("core"))
    return cells.withColumn("pos", F.col("tile") * tiles.PIECE + F.col("at")).where(F.col("pos") < F.col("n") - 1)


@query
def base_score(s: Source):
    """Pair score of neighbouring values."""
    cfg = CFG.replace(max_reactivity=1.5)
    return _steps(s).select("id", L("pos").alias("pos"),
                            r6(S.base_score(F.col("p.v"), F.col("p.v2"), cfg)).alias("score"))


@query
def seq_base_score(s: Source):
    """Pair score of neighbouring bases."""
    return _steps(s).select("id", L("pos").alias("pos"),
                            S.seq_base_score(F.col("p.b"), F.col("p.b2"), CFG).alias("score"))


@query
def deigan(s: Source):
    """Probing pseudo-energy of every value."""
    value = F.when(F.col("event_id") % 97 != 0, F.col("value") / 100.0 - 0.2)
    return views.events(s.spark, s.sf).select("event_id", r6(S.deigan(value, CFG.slope, CFG.intercept)).alias("energy"))


@query
def nibble_decode(s: Source):
    """4-bit base codes."""
    return views.events(s.spark, s.sf).select("event_id", S.nibble_base(F.col("event_id") % 5).alias("base"))


@query
def display_bases(s: Source):
    """Bases as shown for DNA and RNA."""
    molecule = F.when(F.length("bases") % 2 == 0, "RNA").otherwise("DNA")
    return s.db.select("id", S.display_bases(F.col("bases"), molecule).alias("shown"))


@query
def display_number(s: Source):
    """P- and E-value text."""
    x = F.col("value") / 7000.0 / F.pow(F.lit(10.0), F.col("event_id") % 12)
    return views.events(s.spark, s.sf).select("event_id", S.display_number(x).alias("shown"))


# --- distance join ------------------------------------------------------------

@query
def rolling_stats(s: Source):
    """Mean and deviation of every target window, missing values counted as the sentinel."""
    t = s.tiles().tiles
    k = CFG.kmer_len
    at = F.explode(F.sequence(F.lit(0), F.least(F.col("core"), F.size("reactivity") - k + 1) - 1))
    filled = F.transform("reactivity", lambda x: F.coalesce(x, F.lit(-999.0)))
    w = t.where(F.size("reactivity") >= k).select(
        "target_id", (F.col("tile") * CFG.tile_len).alias("base"), filled.alias("f"), at.alias("i"))
    w = w.select("target_id", (F.col("base") + F.col("i")).alias("d_pos"), F.slice("f", F.col("i") + 1, k).alias("w"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    w = w.withColumn("mean", total("w") / k)
    spread = total(F.transform("w", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    return w.select("target_id", "d_pos", F.round("mean", 8).alias("mean"), r6(F.sqrt(spread / k)).alias("sigma"))


@query
def window_distances(s: Source):
    """The distances themselves, summed up with their places per (query window, target)."""
    laid = F.arrays_zip("d_pos", "dist")
    weighted = F.aggregate(laid, F.lit(0.0), lambda a, x: a + x["dist"] * (x["d_pos"] + 1))
    rows = distance_profiles(s.tiles(CFG.replace(tile_len=16)), s.prepared().blocks, CFG.replace(tile_len=16)).select(
        "query_id", "q_pos", "target_id", F.size("dist").alias("n"), F.array_min("dist").alias("nearest"),
        F.array_max("dist").alias("farthest"), weighted.alias("weighted"))
    return rows.groupBy("query_id", "q_pos", "target_id").agg(
        F.sum("n").cast("long").alias("n"), r6(F.min("nearest")).alias("nearest"), r6(F.max("farthest")).alias("farthest"),
        F.round(F.sum("weighted"), 4).alias("weighted"))


@query
def distance_threshold(s: Source):
    """Moments and threshold of the distances per (query window, target)."""
    blocks = s.prepared().blocks
    stats = window_stats(s.tiles(), blocks, kmer_names(blocks, s.spark), CFG)
    return stats.select("query_id", "q_pos", "target_id", L("n").alias("n"), r6("mean_dist").alias("mean_dist"),
                        r6("sd_dist").alias("sd_dist"), r6("limit").alias("max_dist"))


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "target_id", "q_pos", "d_pos")


@query
def match_kmers_all(s: Source):
    """Window hits under the threshold and the promiscuity rule."""
    return _hit_columns(s.hits())


@query
def match_kmers_tiled(s: Source):
    """The same hits when every profile spans several tiles."""
    return _hit_columns(s.hits(CFG.replace(tile_len=16)))


@query
def promiscuity_cut(s: Source):
    """Hits under a strict promiscuity rule."""
    return _hit_columns(s.hits(CFG.replace(kmer_max_match_every_nt=40)))


@query
def seq_dist_filter(s: Source):
    """Hits whose bases differ at six positions at most."""
    from profseek.config import Distance

    return _hit_columns(s.hits(CFG.replace(match_kmer_seq=True, kmer_max_seq_dist=Distance.parse("0.75"))))


@query
def gc_diff_filter(s: Source):
    """Hits with similar GC content, default limit."""
    return _hit_columns(s.hits(CFG.replace(match_kmer_gc_content=True)))


# --- seeds --------------------------------------------------------------------

@query
def diagonals(s: Source):
    """Hits per diagonal."""
    return seeds.with_diagonal(s.hits()).groupBy("query_id", "target_id", "diag").agg(F.count("*").alias("n"))


def _seed_columns(frame: DataFrame, *more) -> DataFrame:
    return frame.select("query_id", "target_id", "q_start", "q_end", "d_start", "d_end", *more)


@query
def hsg_groups(s: Source):
    """Groups of any size, from raw hits by window functions."""
    return _seed_columns(seeds.as_seeds(seeds.islands(s.hits(), CFG), CFG.replace(min_kmers=1)), "n_kmers")


@query
def min_kmers_having(s: Source):
    """Groups with enough windows, finished inside the join tasks."""
    cfg = CFG.replace(min_kmers=3)
    return _seed_columns(seeds.as_seeds(reached_islands(s.tiles(cfg), s.prepared(cfg).blocks, cfg), cfg), "n_kmers")


@query
def seed_score(s: Source):
    """Score of every seed."""
    return _seed_columns(s.all_seeds(), r6("seed_score").alias("seed_score"))


@query
def seed_score_with_bases(s: Source):
    """Score of every seed, base matches included."""
    return _seed_columns(s.all_seeds(CFG.replace(align_score_seq=True)), r6("seed_score").alias("seed_score"))


@query
def positive_seeds(s: Source):
    """Seeds with a positive score."""
    return _seed_columns(s.seeds(), r6("seed_score").alias("seed_score"))


@query
def positive_seeds_tiled(s: Source):
    """The same seeds through the path of long targets."""
    cfg = CFG.replace(tile_len=24)
    return _seed_columns(s.seeds(cfg), r6("seed_score").alias("seed_score"))


@query
def duplicate_names(s: Source):
    """Positive seeds where queries and users share names: the parity of the type's length, the user modulo 7."""
    rows = s.rows.withColumns({"ord": F.col("id").cast("long"), "id": (F.col("id").cast("long") % 7).cast("string")})
    place = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long")
    own = s.queries.withColumns({"ord": place,
                                 "id": (F.length("id") % 2).cast("string")})
    found = search.seeds_of(search.Queries.prepare(search.with_record_keys(own), CFG),
                            tiles.tiled_long(rows, CFG, s.sizes), CFG)
    return _seed_columns(search.with_record_names(found), "query_ord", "target_ord", r6("seed_score").alias("seed_score"))


@query
def align_tolerance(s: Source):
    """Reach of the extension on both sides of each seed."""
    reach = S.align_tolerance(*[F.col(c) for c in ("q_start", "q_end", "d_start", "d_end", "trim_start", "trim_end",
                                                   "target_len")], CFG.align_len_tolerance)
    return _seed_columns(s.all_seeds().withColumn("t", reach), "t.up", "t.down")


@query
def first_null_seeds(s: Source):
    """The leading 20 positive seeds per query in target, diagonal, position order."""
    return _seed_columns(seeds.first_seeds(s.seeds(), 20))


# --- extension ----------------------------------------------------------------

HIT = ["query_id", "target_id", "q_seed_start", "d_seed_start", "q_start", "q_end", "d_start", "d_end"]


@query
def ungapped_extend(s: Source):
    """Extension without gaps and drop-off."""
    return s.extended().select(*HIT, r6("raw_score").alias("raw_score"), "q_path", "t_path")


@query
def ungapped_extend_tiled(s: Source):
    """The same extensions when every profile spans several tiles."""
    return s.extended(CFG.replace(tile_len=24)).select(*HIT, r6("raw_score").alias("raw_score"), "q_path", "t_path")


@query
def norm_score(s: Source):
    """Length-normalised score."""
    return s.extended().select(*HIT, r6("score").alias("score"))


@query
def banded_extend(s: Source):
    """Gapped extension with both paths."""
    return s.gapped().select(*HIT, r6("score").alias("score"), "q_path", "t_path")


# --- null model ---------------------------------------------------------------

@query
def shuffle_count(s: Source):
    """Draws per profile for the null database."""
    total = s.rows.agg(F.count(F.lit(1)).alias("cells"))
    return total.select("cells", nulls.shuffle_count(F.col("cells")).alias("per_profile"))


@query
def chunk_layout(s: Source):
    """Offset and chunk count of each profile for blocks of 10."""
    n = F.col("n")
    offset = nulls.block_offset(n, 10, F.lit(CFG.seed), F.lit("offset"), F.col("id"))
    return tiles.lengths(s.rows).select("id", "n", offset.alias("block_offset")).select(
        "id", "n", "block_offset", nulls.chunk_count(F.col("n"), F.col("block_offset"), 10).alias("chunks"))


@query
def ordinals(s: Source):
    """Dense numbers of profiles in digest order."""
    return nulls.numbered(s.rows).select("id", "dense_ord")


def _n_profiles(s: Source) -> int:
    return s.sizes.profiles


@query
def draws(s: Source):
    """Profiles drawn with replacement, two draws per profile on average."""
    n = _n_profiles(s)
    return nulls.draws(tiles.lengths(s.rows), 0, 2 * n, n, CFG).select("draw", "id", "n")


def _checksum(shuffled: DataFrame) -> DataFrame:
    weighted = F.aggregate(
        F.transform("reactivity", lambda x, i: F.coalesce(x, F.lit(-1.0)) * (i + 1).cast("double")), F.lit(0.0),
        lambda a, x: a + x)
    return shuffled.select("id", F.col("ord").alias("draw"), "bases", r6(weighted).alias("checksum"))


@query
def shuffled_db(s: Source):
    """Block-shuffled null profiles, two per profile on average."""
    n = _n_profiles(s)
    return _checksum(nulls.shuffled_rows(nulls.draws(s.db, 0, 2 * n, n, CFG), CFG))


@query
def shuffled_db_long(s: Source):
    """The same null profiles by renumbering positions, the way of long profiles."""
    n = _n_profiles(s)
    rows = nulls.shuffled_positions(nulls.long_draws(nulls.draws(s.rows, 0, 2 * n, n, CFG)), CFG, s.sizes.longest)
    return _checksum(tiles.wide_from_long(rows.withColumn("id", F.struct("id", "ord"))).select(
        F.col("id.id").alias("id"), F.col("id.ord").alias("ord"), "bases", "reactivity"))


@query
def shuffled_in_blocks(s: Source):
    """Null profiles with cells shuffled inside blocks as well, bases and values apart."""
    cfg = CFG.replace(db_in_block_shuffle=True)
    n = _n_profiles(s)
    return _checksum(nulls.shuffled_rows(nulls.draws(s.db, 0, 2 * n, n, cfg), cfg))


@query
def null_fit(s: Source):
    """Gumbel location and scale per query from seed scores."""
    fits = nulls.gumbel_fit(s.seeds().select("query_id", F.col("seed_score").alias("score")))
    return fits.select("query_id", L("n_null").alias("n_null"), r6("location").alias("location"),
                       r6("scale").alias("scale"))


@query
def normal_fit_z(s: Source):
    """Mean, deviation and z-score of the best seed per target."""
    scored = s.seeds().select("target_id", F.col("seed_score").alias("score"))
    best = scored.groupBy("target_id").agg(F.max("score").alias("best"))
    fit = nulls.normal_fit(scored, "target_id").join(best, "target_id")
    z = (F.col("best") - F.col("mean")) / F.when(F.col("stddev") > 0, F.col("stddev"))
    return fit.select("target_id", F.round("mean", 10).alias("mean"), r6("stddev").alias("stddev"), r6(z).alias("z"))


@query
def column_shuffle(s: Source):
    """Order of alignment columns in blocks of 3 with one odd block."""
    n = F.length("bases").cast("long")
    order = columns.column_permutation(n, 3, False, F.lit(CFG.seed), F.col("id"))
    moved = F.array_join(columns.gather(F.split("bases", ""), order), "")
    return s.db.select("id", moved.alias("bases"))


@query
def column_shuffle_in_block(s: Source):
    """The same with columns moved inside each block."""
    n = F.length("bases").cast("long")
    order = columns.column_permutation(n, 3, True, F.lit(CFG.seed), F.col("id"))
    return s.db.select("id", F.array_join(columns.gather(F.split("bases", ""), order), "").alias("bases"))


# --- significance -------------------------------------------------------------

@query
def gumbel_pvalue(s: Source):
    """P-value of every hit."""
    return s.significant().select(*HIT, r6("pvalue").alias("pvalue"))


@query
def evalue(s: Source):
    """E-value of every hit: P-value times the hits of its query."""
    return s.significant().select(*HIT, L("n_hits").alias("n_hits"), r6("evalue").alias("evalue"))


@query
def status(s: Source):
    """Reportable hits with their status."""
    kept = significance.with_status(significance.reportable(s.significant(), CFG), CFG)
    return kept.select(*HIT, "status")


@query
def overlap_removal(s: Source):
    """Hits left after overlapping weaker ones are dropped, before any E-value limit."""
    return significance.remove_overlaps(s.significant(), CFG).select(*HIT, r6("score").alias("score"))


def _with_score(table: DataFrame) -> DataFrame:
    return table.withColumn("Score", F.round(F.col("Score").cast("double"), 4))


@query
def result_table(s: Source):
    """The printed table."""
    return _with_score(significance.report_table(s.reported()))


# --- reports ------------------------------------------------------------------

def _records(s: Source) -> DataFrame:
    return reports.with_records(s.reported(), s.queries, s.rows)


@query
def fasta_text(s: Source):
    """FASTA text of significant hits."""
    return _records(s).select(reports.file_stem().alias("name"), reports.fasta_text().alias("text"))


@query
def stockholm_text(s: Source):
    """Stockholm text of significant hits."""
    return _records(s).select(reports.file_stem().alias("name"), reports.stockholm_text().alias("text"))


@query
def reactivity_json(s: Source):
    """Reactivity JSON of significant hits."""
    text = reports.reactivity_json()
    return _records(s).select(
        reports.file_stem().alias("name"), F.get_json_object(text, "$.queryId").alias("query_id"),
        F.get_json_object(text, "$.targetTo").cast("long").alias("d_end"),
        F.size(F.from_json(F.get_json_object(text, "$.query"), "array<string>")).cast("long").alias("n_query"),
        F.get_json_object(text, "$.target[0]").alias("first_target"))


def _gapped_records(s: Source) -> DataFrame:
    return reports.with_records(s.reported(s.gapped()), s.queries, s.rows)


@query
def result_table_gapped(s: Source):
    """The printed table of gapped hits."""
    return _with_score(significance.report_table(s.reported(s.gapped())))


@query
def fasta_text_gapped(s: Source):
    """FASTA text of significant gapped hits."""
    return _gapped_records(s).select(reports.file_stem().alias("name"), reports.fasta_text().alias("text"))


@query
def stockholm_text_gapped(s: Source):
    """Stockholm text of significant gapped hits."""
    return _gapped_records(s).select(reports.file_stem().alias("name"), reports.stockholm_text().alias("text"))


@query
def reactivity_json_gapped(s: Source):
    """The whole reactivity JSON of significant gapped hits."""
    return _gapped_records(s).select(reports.file_stem().alias("name"), reports.reactivity_json().alias("text"))


@query
def gapped_render(s: Source):
    """Bases laid over a path whose gaps are the N cells."""
    path = F.translate("bases", "ACGTN", "xxxx-")
    return s.db.select("id", gapped.gapped_bases(F.regexp_replace("bases", "N", ""), path).alias("text"))


@query
def gapped_values(s: Source):
    """Values laid over the same path."""
    path = F.translate("bases", "ACGTN", "xxxx-")
    cells = F.arrays_zip(F.split("bases", "").alias("b"), F.col("reactivity").alias("v"))
    kept = F.transform(F.filter(cells, lambda c: c["b"] != "N"), lambda c: c["v"])
    laid = s.db.select("id", F.posexplode(gapped.gapped_values(kept, path)).alias("pos", "c"))
    return laid.select("id", L("pos").alias("pos"), F.col("c.gap").alias("gap"), r6("c.value").alias("value"))


def _folds(s: Source) -> DataFrame:
    """A structure over each profile from its bases: two hairpins with bulges in a common stem."""
    quarter = F.floor(F.length("bases") / 4).cast("int")

    def hairpin(start):
        left = F.translate(F.substring(F.col("bases"), start, quarter), "ACGTN", "(.((.")
        right = F.reverse(F.translate(F.translate(left, ".", ""), "(", ")"))
        return F.concat(left, F.lit("..."), right)

    text = F.concat(F.lit("((."), hairpin(F.lit(1)), hairpin(quarter + 1), F.lit("..)).."))
    return s.db.select("id", text.alias("structure"), F.concat("bases", "bases").alias("sequence"))


@query
def dotbracket_blocks(s: Source):
    """Paired blocks of nested and branching structures, and their rendering."""
    found = dotbracket.with_blocks(_folds(s), ["id"], "structure")
    shown = dotbracket.structure_text(F.col("blocks"), F.length("structure"))
    flat = found.select("id", shown.alias("shown"), F.explode("blocks").alias("b"))
    return flat.select("id", "shown", *[L(f"b.{c}").alias(c) for c in dotbracket.NAMES])


@query
def pair_support(s: Source):
    """Canonical pairs of a sequence over such a structure."""
    found = dotbracket.with_blocks(_folds(s), ["id"], "structure")
    c = gapped.paired_support(F.col("sequence"), F.col("blocks"))
    return found.select("id", c.alias("c")).select("id", L("c.total").alias("total"), L("c.canonical").alias("canonical"))


# --- sources and sinks --------------------------------------------------------

def _profile_check(profiles: DataFrame) -> DataFrame:
    total = F.aggregate("reactivity", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    missing = F.size(F.filter("reactivity", lambda x: x.isNull())).cast("long")
    return profiles.select("id", "bases", F.round(total, 4).alias("total"), missing.alias("missing"))


@query
def native_codec(s: Source):
    """Profiles written to binary files and read back in small splits."""
    path = fresh_path(s.spark, "native")
    write_native(s.db, path)
    return _profile_check(read_native(s.spark, path, 4096))


@query
def profile_files(s: Source):
    """Profiles written and read back by the data source of binary files."""
    register(s.spark)
    path = fresh_path(s.spark, "profiles")
    s.db.write.format("profiles").mode("append").save(path)
    return _profile_check(s.spark.read.format("profiles").option("splitBytes", 4096).load(path))


@query
def text_source(s: Source):
    """Profiles written as query text and parsed again."""
    path = fresh_path(s.spark, "text")
    values = F.array_join(F.transform("reactivity", lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), ",")
    s.db.select(F.concat_ws("\n", F.lit(""), F.concat(F.lit("  "), "id"), "bases", values).alias("value")).write.text(path)
    return _profile_check(read_query_text(s.spark, path))


@query
def xml_source(s: Source):
    """Profiles written as XML files and loaded from the folder."""
    path = fresh_path(s.spark, "xml")
    values = F.array_join(F.transform("reactivity", lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), ",\n")
    text = F.concat(F.lit('<data><transcript id="'), "id", F.lit('" length="'), F.length("bases").cast("string"),
                    F.lit('"><sequence>\n'), F.expr("regexp_replace(bases, '(.{20})', '$1\n')"),
                    F.lit("</sequence><reactivity>"), values, F.lit("</reactivity></transcript></data>"))
    reports.write_files(s.db.select(F.col("id").alias("name"), text.alias("text")), path, "xml")
    return _profile_check(load_profiles(s.spark, path))


@query
def first_of_name(s: Source):
    """Of several records with one name, the first: each user's earliest day."""
    rows = views.events(s.spark, s.sf).select(
        F.col("user_id").cast("string").alias("id"), F.dayofmonth("ts").cast("long").alias("ord"), "value")
    days = rows.groupBy("id", "ord").agg(F.max("value").alias("top"))
    return first_by_id(days).select("id", r6("top").alias("top"))


# --- whole searches -----------------------------------------------------------

def search_result(spark: SparkSession, sf: str) -> DataFrame:
    """Search of the event-type profiles against all users."""
    s = source(spark, sf)
    hits = search.search_hits(s.queries, s.rows, CFG, db=s.tiles(), sizes=s.sizes)
    return significance.report_table(hits)


@query
def null_scores(s: Source):
    """Null fit per query from the shuffled database."""
    fits = search.null_fits(s.prepared(), s.rows, CFG, sizes=s.sizes)
    return fits.select("query_id", L("n_null").alias("n_null"), r6("location").alias("location"),
                       r6("scale").alias("scale"))


@query
def null_scores_ungapped(s: Source):
    """Null fit per query from two draws per profile and ungapped extension, up to 300 seeds each."""
    cfg = UNGAPPED.replace(db_shuffles=2, null_hsgs=300)
    fits = search.null_fits(s.prepared(cfg), s.rows, cfg, sizes=s.sizes)
    return fits.select("query_id", L("n_null").alias("n_null"), r6("location").alias("location"),
                       r6("scale").alias("scale"))


@query
def null_scores_stored(s: Source):
    """The same fit from a null database that was written to storage and is read back as it is."""
    cfg = UNGAPPED.replace(db_shuffles=2, null_hsgs=300)
    path = fresh_path(s.spark, "null-database")
    shuffled_profiles(s.db, cfg).write.parquet(path)
    fits = search.null_fits(s.prepared(cfg), load_profiles(s.spark, path), cfg, shuffled=True)
    return fits.select("query_id", L("n_null").alias("n_null"), r6("location").alias("location"),
                       r6("scale").alias("scale"))


def _whole_search(s: Source, **changes) -> DataFrame:
    cfg = UNGAPPED.replace(db_shuffles=2, null_hsgs=300, **changes)
    hits = search.search_hits(s.queries, s.rows, cfg, db=s.tiles(cfg), sizes=s.sizes)
    return _with_score(significance.report_table(hits))


@query
def search_ungapped(s: Source):
    """A whole search with its own null model, without gaps."""
    return _whole_search(s)


@query
def search_ungapped_tiled(s: Source):
    """The same search when every profile, also of the null database, spans several tiles."""
    return _whole_search(s, tile_len=24)


REGISTRY["search"] = search_result
