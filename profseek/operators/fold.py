"""Evaluation of the folds of significant hits: supports of the consensus structure and a column-shuffle null.

The folding itself is a function that the caller passes in:
backend(targets, queries, pseudo, cfg, structure) gets equally long gapped
sequences of many alignments and one row of column energies each, and returns
their energies and, if asked, their dot-bracket structures. Spark lays the
alignments out, spreads them, shuffles their columns and evaluates the results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import deigan
from profseek.functions.shared import broadcast_if_small, spread_rows
from profseek.operators.columns import column_permutation, gather
from profseek.operators.dotbracket import with_blocks
from profseek.operators.gapped import gapped_bases, gapped_values, paired_support
from profseek.sources.load import first_by_id


def _column_energy(values, cfg):
    """Probing pseudo-energy per column; a gap contributes nothing."""
    return F.transform(values, lambda s: F.when(s["gap"], 0.0).otherwise(
        deigan(s["value"], cfg.slope, cfg.intercept)))


def hit_alignments(hits: DataFrame, queries: DataFrame, targets: DataFrame, cfg) -> DataFrame:
    """Gapped sequences and column energies of significant hits (original, uncapped values)."""
    sides = []
    for frame, name, key in ((queries, "q", "query_id"), (targets, "d", "target_id")):
        ids = hits.where(F.col("status") == "!").select(F.col(key).alias("id")).distinct()
        frame = first_by_id(frame.join(broadcast_if_small(ids), "id", "left_semi"))
        sides.append(frame.select(F.col("id").alias(key), F.col("bases").alias(f"{name}_all_bases"),
                                  F.col("reactivity").alias(f"{name}_all_values")))
    met = hits.where(F.col("status") == "!").join(sides[0], "query_id").join(sides[1], "target_id")
    out = met
    for name, path in (("q", "q_path"), ("d", "t_path")):
        at = (F.col(f"{name}_start") + 1).cast("int")
        n = (F.col(f"{name}_end") - F.col(f"{name}_start") + 1).cast("int")
        out = out.withColumn(f"{name}_gapped", gapped_bases(F.substring(F.col(f"{name}_all_bases"), at, n),
                                                            F.col(path)))
        out = out.withColumn(f"{name}_energy", _column_energy(
            gapped_values(F.slice(f"{name}_all_values", at, n), F.col(path)), cfg))
    return out.drop("q_all_bases", "q_all_values", "d_all_bases", "d_all_values")


KEYS = ["query_id", "query_ord", "target_id", "target_ord", "q_seed_start", "d_seed_start"]


def _fold_rows(rows: DataFrame, cfg, structure: bool, backend) -> DataFrame:
    """Fold (d_gapped, q_gapped, pseudo) rows; adds mfe and structure."""
    def run(frames):
        for pdf in frames:
            mfe, text = np.zeros(len(pdf)), [None] * len(pdf)
            lengths = pdf["d_gapped"].str.len().to_numpy()
            for n in np.unique(lengths):
                for group in np.array_split(np.flatnonzero(lengths == n), max(1, (lengths == n).sum() // 128)):
                    part = pdf.iloc[group]
                    energy, found = backend(part["d_gapped"].tolist(), part["q_gapped"].tolist(),
                                            np.stack(part["pseudo"].to_numpy()).astype(float), cfg, structure)
                    mfe[group] = energy
                    for at, s in zip(group, found or []):
                        text[at] = s
            out = pdf[[*KEYS]].assign(mfe=mfe)
            yield out.assign(structure=text) if structure else out

    ddl = "query_id string, query_ord long, target_id string, target_ord long, q_seed_start long, d_seed_start long, mfe double"
    return rows.select(*KEYS, "d_gapped", "q_gapped", "pseudo").mapInPandas(
        run, ddl + (", structure string" if structure else ""))


def evaluate_folds(hits: DataFrame, queries: DataFrame, targets: DataFrame, cfg, backend) -> DataFrame:
    """Add base-pair supports, structure and folding P-value to hits; weak support lowers the status."""
    if "query_ord" not in hits.columns:
        hits = hits.withColumn("query_ord", F.lit(0).cast("long"))
    aligned = hit_alignments(hits, queries, targets, cfg)
    half = lambda x, y: F.zip_with(x, y, lambda p, q: (p + q) / 2)
    base = aligned.withColumn("pseudo", half(F.col("d_energy"), F.col("q_energy")))
    native = _fold_rows(spread_rows(base, *KEYS), cfg, True, backend)
    folded = with_blocks(base.join(native, KEYS), KEYS, "structure")
    share = lambda s: s["canonical"] / F.when(s["total"] > 0, s["total"])
    supported = (
        folded.withColumn("target_bp_support", share(paired_support(F.col("d_gapped"), F.col("blocks"))))
        .withColumn("query_bp_support", share(paired_support(F.col("q_gapped"), F.col("blocks"))))
        # no pair at all is an undefined share, which does not count as weak
        .withColumn("weak", F.coalesce(F.least("target_bp_support", "query_bp_support") < cfg.min_bp_support,
                                       F.lit(False)))
    )
    kept = supported.where(~F.col("weak"))
    order = column_permutation(F.length("d_gapped").cast("long"), cfg.block_size, cfg.in_block_shuffle,
                               F.lit(cfg.seed), *[F.col(k) for k in KEYS if k != "query_ord"], F.col("shuffle"))
    letters = lambda c: F.array_join(gather(F.split(c, ""), F.col("order")), "")
    shuffled = spread_rows(
        kept.select(*KEYS, "d_gapped", "q_gapped", "pseudo",
                    F.explode(F.sequence(F.lit(1), F.lit(cfg.shuffles))).alias("shuffle"))
        .withColumn("order", order).select(*KEYS, letters("d_gapped").alias("d_gapped"), letters("q_gapped").alias("q_gapped"),
                gather(F.col("pseudo"), F.col("order")).alias("pseudo")), *KEYS)
    null = _fold_rows(shuffled, cfg, False, backend).groupBy(*KEYS).agg(
        F.avg("mfe").alias("null_mean"), F.stddev_samp("mfe").alias("null_sd"))
    scored = supported.join(null, KEYS, "left")
    z = (F.col("mfe") - F.col("null_mean")) / F.when(F.col("null_sd") > 0, F.col("null_sd"))
    scored = scored.withColumn("z", z).select(
        *KEYS, "target_bp_support", "query_bp_support", "weak",
        F.when(~F.col("weak"), F.col("structure")).alias("dotbracket"), F.when(~F.col("weak"), F.col("z")).alias("z"))
    result = hits.join(with_normal_tail(scored), KEYS, "left")
    return result.withColumn("status", F.when(F.coalesce("weak", F.lit(False)), "?").otherwise(F.col("status"))).drop(
        "weak", "z")


def normal_tail(z):
    """Lower tail of the standard normal for z below 0, else 1."""
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0)) if x == x and x < 0 else 1.0)

    return F.pandas_udf(tail, "double")(z)


def with_normal_tail(scored: DataFrame) -> DataFrame:
    return scored.withColumn("mfe_pvalue", F.when(~F.col("weak"), normal_tail(F.col("z"))))
