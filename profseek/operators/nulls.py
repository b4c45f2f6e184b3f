"""Null database: profiles drawn with replacement and shuffled in blocks.

Draws and permutations come from digests of (seed, draw, block), so a task that
is run again after a lost executor rebuilds exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import digest_number
from profseek.functions.shared import broadcast_if_small
from profseek.operators.numbering import dense_ordinals, number_positions
from profseek.operators.tiles import Sizes, is_long, wide_from_long

NULL_POSITIONS = 500_000  # the null database covers at least this many positions


def shuffle_count(total_length: Column) -> Column:
    """Draws per profile: enough to reach NULL_POSITIONS, at least one."""
    return F.greatest(F.lit(1).cast("long"),
                      F.floor(F.lit(NULL_POSITIONS) / F.when(total_length > 0, total_length)).cast("long"))


def total_draws(sizes: Sizes, cfg) -> int:
    return sizes.profiles * (cfg.db_shuffles or max(1, NULL_POSITIONS // sizes.cells))


def block_offset(length: Column, block: int, *key: Column) -> Column:
    """A start offset below the remainder of the length, 0 without remainder."""
    rest = length % block
    return F.when(rest > 0, digest_number(*key) % F.when(rest > 0, rest)).otherwise(F.lit(0)).cast("long")


def chunk_count(length: Column, offset: Column, block: int) -> Column:
    body = length - offset
    return ((offset > 0).cast("long") + F.floor(body / block).cast("long") + (body % block > 0).cast("long"))


def chunk_of(pos: Column, offset: Column, block: int) -> Column:
    """Chunk number of a position: a leading prefix of `offset` cells, then full blocks."""
    lead = (offset > 0).cast("long")
    return F.when(pos < offset, F.lit(0).cast("long")).otherwise(lead + F.floor((pos - offset) / block).cast("long"))


def numbered(profiles: DataFrame) -> DataFrame:
    """(id, ord, dense_ord) of wide or long profiles."""
    keys = profiles.select("id", "ord")
    return dense_ordinals(keys.distinct() if is_long(profiles) else keys, "id", "ord")


def draws(profiles: DataFrame, first: int, last: int, n_profiles: int, cfg, index: DataFrame | None = None) -> DataFrame:
    """Draw numbers first..last-1 joined with the profile each one picked, or with all its positions.

    The numbering touches ids only; the profiles join afterwards on (id, ord).
    """
    index = numbered(profiles) if index is None else index
    picks = profiles.sparkSession.range(first, last).select(
        F.col("id").alias("draw"),
        (digest_number(F.lit(cfg.seed), F.lit("pick"), F.col("id")) % n_profiles).alias("dense_ord"))
    chosen = picks.join(index, "dense_ord").drop("dense_ord")
    # one narrow row per draw, so the profiles are filtered where they are read
    return profiles.join(broadcast_if_small(chosen, last - first), ["id", "ord"])


def _piece(values: Column, chunk: Column, offset: Column, block: int) -> Column:
    """Cells of one chunk out of an array."""
    lead = F.when(offset > 0, 1).otherwise(0)
    start = F.when((offset > 0) & (chunk == 0), F.lit(0)).otherwise(offset + (chunk - lead) * block)
    width = F.when((offset > 0) & (chunk == 0), offset).otherwise(F.lit(block).cast("long"))
    return F.slice(values, (start + 1).cast("int"), width.cast("int"))


def _permuted(values: Column, tag: str) -> Column:
    """The cells of a chunk in digest order, for shuffles inside blocks."""
    keyed = F.transform(values, lambda x, i: F.struct(
        digest_number(F.lit(tag), F.col("draw"), F.col("_chunk_no"), i).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def shuffled_rows(drawn: DataFrame, cfg) -> DataFrame:
    """Block shuffle of wide rows with array functions; `ord` becomes the draw."""
    block = cfg.db_block_size
    n = F.size("reactivity").cast("long")
    laid = (
        drawn.withColumn("_off", block_offset(n, block, F.lit(cfg.seed), F.lit("offset"), F.col("draw")))
        .withColumn("_chunks", chunk_count(n, F.col("_off"), block))
        .withColumn("_order", F.transform(F.array_sort(F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1),
            lambda c: F.struct(digest_number(F.lit(cfg.seed), F.lit("block"), F.col("draw"), c).alias("k"),
                               c.alias("c")))), lambda s: s["c"]))
    )
    letters = F.split("bases", "")
    if not cfg.db_in_block_shuffle:
        values = F.flatten(F.transform("_order", lambda c: _piece(F.col("reactivity"), c, F.col("_off"), block)))
        bases = F.array_join(F.transform(
            "_order", lambda c: F.array_join(_piece(letters, c, F.col("_off"), block), "")), "")
        return laid.select("id", F.col("draw").alias("ord"), bases.alias("bases"), values.alias("reactivity"),
                           "molecule")
    one = laid.select("id", "draw", "molecule", "reactivity", "bases", "_off",
                      F.posexplode("_order").alias("_rank", "_chunk_no"))
    cut = one.select(
        "id", "draw", "molecule", "_rank",
        _permuted(_piece(F.col("reactivity"), F.col("_chunk_no"), F.col("_off"), block),
                  f"{cfg.seed}:values").alias("v"),
        _permuted(_piece(letters, F.col("_chunk_no"), F.col("_off"), block), f"{cfg.seed}:bases").alias("b"))
    whole = cut.groupBy("id", "draw", "molecule").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "v", "b"))).alias("p"))
    return whole.select("id", F.col("draw").alias("ord"), F.array_join(F.flatten(F.col("p.b")), "").alias("bases"),
                        F.flatten(F.col("p.v")).alias("reactivity"), "molecule")


def shuffled_positions(drawn_long: DataFrame, cfg, largest: int | None = None) -> DataFrame:
    """The same block shuffle on (id, draw, pos, group_len, base, reactivity) rows.

    A block shuffle is a renumbering of positions by (digest of the block,
    position), so a profile of any length spreads over many tasks. `largest` is
    the length of the longest profile, if known.
    """
    block = cfg.db_block_size
    offset = block_offset(F.col("group_len"), block, F.lit(cfg.seed), F.lit("offset"), F.col("draw"))
    keyed = (
        drawn_long.withColumn("_c", chunk_of(F.col("pos"), offset, block))
        .withColumn("_k", digest_number(F.lit(cfg.seed), F.lit("block"), F.col("draw"), F.col("_c")))
    )
    if not cfg.db_in_block_shuffle:
        order = keyed.withColumnRenamed("pos", "_from").drop("group_len")
        return number_positions(order, ["id", "draw"], ["_k", "_c", "_from"], largest=largest).select(
            "id", F.col("draw").alias("ord"), "pos", "group_len", "base", "reactivity")
    # bases and values are permuted independently inside each block
    sides = []
    for name, tag in (("base", "bases"), ("reactivity", "values")):
        start = F.col("pos") - F.when(F.col("pos") < offset, F.lit(0)).otherwise(offset + F.floor(
            (F.col("pos") - offset) / block) * block)
        inner = digest_number(F.lit(f"{cfg.seed}:{tag}"), F.col("draw"), F.col("_c"), start)
        side = keyed.withColumn("_i", inner).withColumnRenamed("pos", "_from").drop("group_len")
        sides.append(number_positions(side.select("id", "draw", "_k", "_c", "_i", "_from", name),
                                      ["id", "draw"], ["_k", "_c", "_i", "_from"], largest=largest).select(
            "id", "draw", "pos", "group_len", name))
    return sides[0].join(sides[1].drop("group_len"), ["id", "draw", "pos"]).select(
        "id", F.col("draw").alias("ord"), "pos", "group_len", "base", "reactivity")


def long_draws(drawn: DataFrame) -> DataFrame:
    """Positions of drawn profiles: (id, draw, pos, group_len, base, reactivity)."""
    names = ["id", "draw", "pos", "group_len", "base", "reactivity"]
    if is_long(drawn):
        return drawn.select(*names)
    cells = F.arrays_zip(F.split("bases", "").alias("base"), F.col("reactivity").alias("value"))
    flat = drawn.select("id", "draw", F.size("reactivity").cast("long").alias("group_len"),
                        F.posexplode(cells).alias("pos", "p"))
    return flat.withColumns({"pos": F.col("pos").cast("long"), "base": F.col("p.base"),
                             "reactivity": F.col("p.value")}).select(*names)


def whole_draws(drawn: DataFrame) -> DataFrame:
    """Drawn profiles as rows, for profiles of one tile."""
    if not is_long(drawn):
        return drawn
    wide = wide_from_long(drawn.withColumn("id", F.struct("id", "draw")))
    return wide.select("id.id", "id.draw", "bases", "reactivity", "molecule")


def gumbel_fit(scores: DataFrame) -> DataFrame:
    """Location and scale per query by moments; one score gives scale 0."""
    n, mean, var = F.count("score"), F.avg("score"), F.var_samp("score")
    scale = F.coalesce(F.sqrt(F.when(n > 1, var) * 6.0 / (F.pi() * F.pi())), F.lit(0.0))
    fitted = scores.groupBy("query_id").agg(n.alias("n_null"), mean.alias("null_mean"), scale.alias("scale"))
    return fitted.withColumn("location", F.col("null_mean") - F.col("scale") * F.lit(0.5772156649015329))


def normal_fit(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean and sample deviation per key; no rows give (0, 0), one row an undefined deviation."""
    return scores.groupBy(*keys).agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"),
        F.when(F.count("score") == 0, 0.0).otherwise(F.stddev_samp("score")).alias("stddev"))
