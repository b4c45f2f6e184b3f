"""P-values, E-values, report filters, overlap removal and the final order."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import display_number, gumbel_p, status_of
from profseek.functions.shared import broadcast_if_small


def with_pvalue(hits: DataFrame, fits: DataFrame) -> DataFrame:
    """Join each query's null fit; a query without null scores has location and scale 0.

    `fits` is counted first, so it should be stored, as `hits` should be.
    """
    fit = fits.select("query_id", "location", "scale")
    joined = hits.join(broadcast_if_small(fit), "query_id", "left").fillna(0.0, ["location", "scale"])
    return joined.withColumn("pvalue", gumbel_p(F.col("score"), F.col("location"), F.col("scale")))


def with_evalue(hits: DataFrame) -> DataFrame:
    """p times the number of hits of the query over all targets, before any filter."""
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return hits.join(broadcast_if_small(sizes), "query_id").withColumn("evalue", F.col("pvalue") * F.col("n_hits"))


def reportable(hits: DataFrame, cfg) -> DataFrame:
    return hits.where(F.col("evalue") <= max(cfg.report_evalue, cfg.inclusion_evalue))


def with_status(hits: DataFrame, cfg) -> DataFrame:
    return hits.withColumn("status", status_of(F.col("evalue"), cfg))


def _stops(start: np.ndarray, end: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """For ranges in rank order: the next range that does not overlap each one (open end: none)."""
    stop_start, stop_end = np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), np.int64)
    # ranges are sorted by start: the first that begins at or after an end is a stop at the latest
    latest = np.searchsorted(start, end, side="left")
    for i in range(len(start) - 1):
        at, last, step = i + 1, max(int(latest[i]), i + 1), 32
        while at < last:
            b0, b1 = start[at:min(at + step, last)], end[at:min(at + step, last)]
            shared = np.minimum(end[i], b1) + 1 - b0
            shorter = np.minimum(end[i] + 1 - start[i], b1 + 1 - b0)
            bad = shared <= shorter * fraction
            if bad.any():
                last = at + int(bad.argmax())
            else:
                at, step = at + step, 4 * step
        if last < len(start):
            stop_start[i], stop_end[i] = start[last], end[last]
    return stop_start, stop_end


def range_stops(ranges: DataFrame, fraction: float) -> DataFrame:
    """Where the overlap run of each distinct query range of a (query, target) ends.

    The ranges arrive sorted, and one (query, target) at a time is held; its
    distinct ranges are bounded by the query, not by the data.
    """
    names = ["query_id", "target_id", "q_start", "q_end"]

    def run(frames):
        held = None
        for pdf in itertools.chain(frames, [None]):
            whole = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if whole is None or not len(whole):
                continue
            query, target = whole["query_id"].to_numpy(), whole["target_id"].to_numpy()
            first = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (target[1:] != target[:-1])])
            done = len(whole) if pdf is None else first[-1]  # the last group may go on in the next batch
            held = whole.iloc[done:]
            start, end = whole["q_start"].to_numpy(), whole["q_end"].to_numpy()
            bounds = [*first[first < done], done]
            parts = [_stops(start[a:b], end[a:b], fraction) for a, b in zip(bounds[:-1], bounds[1:])]
            if parts:
                yield whole.iloc[:done].assign(stop_start=np.concatenate([p[0] for p in parts]),
                                               stop_end=np.concatenate([p[1] for p in parts]))

    ordered = ranges.select(*names).repartition("query_id", "target_id").sortWithinPartitions(
        "query_id", "target_id", "q_start", F.col("q_end").desc())
    return ordered.mapInPandas(
        run, "query_id string, target_id string, q_start long, q_end long, stop_start long, stop_end long")


SEED_KEY = ["query_id", "target_id", "target_ord", "q_seed_start", "d_seed_start"]


#: Order of hits within a (query, target): query start, then longest first, then fixed tie keys.
RANK = ["q_start", "q_end", "target_ord", "d_start", "d_end", "q_seed_start", "d_seed_start"]
RISING = [name not in ("q_end", "d_end") for name in RANK]


def _beaten(pdf: pd.DataFrame, fraction: float) -> np.ndarray:
    """Which hits of one stretch, in rank order, a stronger overlapping hit removes.

    Of two hits the one with the higher score is stronger, of equals the earlier.
    A hit meets the stronger ones from the strongest on, in growing steps, and is
    done with the first that removes it. What none removes overlaps no other
    such hit, so crowded stretches have few hits that meet all.
    """
    q0, q1, d0, d1 = (pdf[c].to_numpy() for c in ("q_start", "q_end", "d_start", "d_end"))
    stop_start, stop_end, score = (pdf[c].to_numpy() for c in ("stop_start", "stop_end", "score"))
    n = len(pdf)
    # the run of a hit ends before this place
    stop = np.searchsorted(q0, stop_start, "left")
    for i in np.flatnonzero((stop < n) & (q0[np.minimum(stop, n - 1)] == stop_start)):
        same = np.searchsorted(q0, stop_start[i], "right")
        stop[i] += np.searchsorted(-q1[stop[i]:same], -stop_end[i], "left")
    order = np.lexsort((np.arange(n), -score))
    out = np.zeros(n, bool)

    def overlap(start, end, a, b):
        """Of hits and later ones."""
        shorter = np.minimum(end[a] + 1 - start[a], end[b] + 1 - start[b])
        shared = np.minimum(end[a], end[b]) + 1 - np.maximum(start[a], start[b])
        return (start[b] < end[a]) & (shared > shorter * fraction)

    for at in range(1, n):
        h, low, step = order[at], 0, 64
        while low < at:
            g = order[low:min(low + step, at)]
            a, b = np.minimum(g, h), np.maximum(g, h)
            if ((stop[a] > b) & overlap(q0, q1, a, b) & overlap(d0, d1, a, b)).any():
                out[h] = True
                break
            low, step = low + step, 4 * step
    return out


def overlap_losers(hits: DataFrame, cfg) -> DataFrame:
    """Keys of the hits that some overlapping hit removes.

    A hit is compared with the following ones up to the first whose query range
    does not overlap; a removed hit still removes others. Hits are dealt by
    stretches of the target as long as a hit can be, two at most to a hit, and each
    stretch is swept on its own: no (query, target) is sorted as a whole, and
    pairs are not written out.
    """
    keys = ["query_id", "target_id"]
    stops = range_stops(hits.select(*keys, "q_start", "q_end").distinct(), cfg.max_align_overlap)
    width = 2 * F.greatest(F.col("trim_len"), F.lit(1))
    cells = hits.select(*SEED_KEY, "q_start", "q_end", "d_start", "d_end", "score", F.explode(F.sequence(
        F.floor(F.col("d_start") / width), F.floor(F.col("d_end") / width))).alias("cell"))
    stretch = [*keys, "cell"]
    dealt = cells.join(stops, [*keys, "q_start", "q_end"]).repartition(*stretch).sortWithinPartitions(
        *stretch, *RANK, ascending=[True] * len(stretch) + RISING)

    def sweep(frames):
        held = None
        for pdf in itertools.chain(frames, [None]):
            whole = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if whole is None or not len(whole):
                continue
            new = (whole[stretch] != whole[stretch].shift()).any(axis=1).to_numpy()
            first = np.flatnonzero(new)
            done = len(whole) if pdf is None else first[-1]  # the last stretch may go on in the next batch
            bounds = [*first[first < done], done]
            lost = [whole.iloc[a:b][_beaten(whole.iloc[a:b], cfg.max_align_overlap)]
                    for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1]
            held = whole.iloc[done:]
            if lost:
                yield pd.concat(lost)[SEED_KEY]

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    return dealt.mapInPandas(sweep, ", ".join(f"{c} {kinds[c]}" for c in SEED_KEY)).distinct()


def remove_overlaps(hits: DataFrame, cfg) -> DataFrame:
    """Drop the weaker of two hits that overlap on query and target."""
    return hits.join(overlap_losers(hits, cfg), SEED_KEY, "left_anti")


FINAL_ORDER = ["evalue", "query_id", "q_start", "target_id", "d_start"]


def report_table(hits: DataFrame, with_fold: bool = False) -> DataFrame:
    """The printed columns, in report order."""
    fold = []
    if with_fold:
        fold = [F.col("target_bp_support").alias("TargetBpSupport"), F.col("query_bp_support").alias("QueryBpSupport"),
                display_number(F.col("mfe_pvalue")).alias("MfePvalue")]
    return hits.orderBy(*FINAL_ORDER).select(
        F.col("query_id").alias("Query"), F.col("target_id").alias("DB field"), F.col("q_start").alias("Qstart"),
        F.col("q_end").alias("Qend"), F.col("d_start").alias("Dstart"), F.col("d_end").alias("Dend"),
        F.concat_ws("-", F.col("q_seed_start").cast("string"), F.col("q_seed_end").cast("string")).alias("Qseed"),
        F.concat_ws("-", F.col("d_seed_start").cast("string"), F.col("d_seed_end").cast("string")).alias("Dseed"),
        F.col("score").cast("float").alias("Score"), display_number(F.col("pvalue")).alias("P-value"),
        display_number(F.col("evalue")).alias("E-value"), *fold, F.col("status").alias("status"))
