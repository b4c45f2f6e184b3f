"""Column expressions. Everything here stays inside Catalyst.

Arrays hold DOUBLE with NULL for a missing value. Denominators go through
`nullif`, so a degenerate case yields NULL and fails later comparisons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def nullif(col: Column, value) -> Column:
    return F.when(col != F.lit(value), col)


def capped(values: Column, limit: float) -> Column:
    """Clip to `limit`; missing stays missing (plain least() would not keep it)."""
    return F.transform(values, lambda x: F.when(x.isNotNull(), F.least(x, F.lit(float(limit)))))


def trim_range(values: Column) -> Column:
    """Half-open range from the first to the last present value; all missing gives the whole array."""
    present = F.transform(values, lambda x: x.isNotNull())
    first = F.array_position(present, True)
    from_end = F.array_position(F.reverse(present), True)
    n = F.size(values)
    return F.struct(
        F.when(first > 0, first - 1).otherwise(0).cast("long").alias("start"),
        F.when(first > 0, n - from_end + 1).otherwise(n).cast("long").alias("end"),
    )


def has_missing(values: Column) -> Column:
    return F.exists(values, lambda x: x.isNull())


def gini(values: Column) -> Column:
    """Sum of pairwise differences over n times the sum, from the sorted values."""
    n = F.size(values)
    ranked = F.transform(F.array_sort(values), lambda x, i: x * (2 * (i + 1) - n - 1).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x)
    return weighted / nullif(n.cast("double") * total, 0.0)


def gc_fraction(bases: Column) -> Column:
    return F.length(F.regexp_replace(bases, "[^CG]", "")) / nullif(F.length(bases).cast("double"), 0.0)


def hamming(a: Column, b: Column) -> Column:
    same_len = F.least(F.length(a), F.length(b))
    xs, ys = F.split(F.substring(a, F.lit(1), same_len), ""), F.split(F.substring(b, F.lit(1), same_len), "")
    return F.aggregate(F.zip_with(xs, ys, lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def base_score(query: Column, target: Column, cfg) -> Column:
    """Score of one aligned pair of values."""
    (m0, m1), (x0, x1) = cfg.align_match_score, cfg.align_mismatch_score
    diff = F.abs(query - target)
    return (
        F.when(query.isNull() | target.isNull(), F.lit(float(m0)))
        .when((query > 1.0) & (target > 1.0), F.lit(0.0))
        .when(diff < 0.5, (F.lit(0.5) - diff) * F.lit((m1 - m0) / 0.5) + F.lit(float(m0)))
        .otherwise((F.lit(float(cfg.max_reactivity)) - diff) * F.lit((x1 - x0) / (cfg.max_reactivity - 0.5))
                   + F.lit(float(x0)))
    )


def seq_base_score(query: Column, target: Column, cfg) -> Column:
    return F.when(query == target, F.lit(float(cfg.align_seq_match_score))).otherwise(
        F.lit(float(cfg.align_seq_mismatch_score)))


def seed_score(q_values: Column, t_values: Column, cfg, q_bases: Column | None = None,
               t_bases: Column | None = None) -> Column:
    """Sum of pair scores over two equally long slices."""
    score = F.aggregate(F.zip_with(q_values, t_values, lambda q, t: base_score(q, t, cfg)),
                        F.lit(0.0), lambda a, x: a + x)
    if cfg.align_score_seq:
        pairs = F.zip_with(F.split(q_bases, ""), F.split(t_bases, ""), lambda q, t: seq_base_score(q, t, cfg))
        score = score + F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    return score


def tolerance_span(size: Column, rate: float) -> Column:
    """`size` enlarged by the length tolerance, rounding half away from zero."""
    return (size + F.round(size.cast("double") * F.lit(float(rate)))).cast("long")


def align_tolerance(q_start, q_end, d_start, d_end, trim_start, trim_end, target_len, rate: float) -> Column:
    """How far an extension may look upstream and downstream of a seed (inclusive ranges)."""
    up = F.least(q_start - trim_start, d_start)
    down = F.least(trim_end - 1 - q_end, target_len - 1 - d_end)
    return F.struct(tolerance_span(F.greatest(up, F.lit(0)), rate).alias("up"),
                    tolerance_span(F.greatest(down, F.lit(0)), rate).alias("down"))


def overlap_len(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.least(a_end, b_end) + 1 - F.greatest(a_start, b_start), F.lit(0))


def ranges_overlap(a_start, a_end, b_start, b_end, fraction: float) -> Column:
    """b starts before a ends, and they share more than `fraction` of the shorter one."""
    shorter = F.least(a_end + 1 - a_start, b_end + 1 - b_start).cast("double")
    return (b_start < a_end) & (overlap_len(a_start, a_end, b_start, b_end).cast("double") > shorter * F.lit(fraction))


def deigan(value: Column, slope: float, intercept: float) -> Column:
    return F.when(value >= 0.0, F.lit(float(slope)) * F.ln(value + 1.0) + F.lit(float(intercept))).otherwise(0.0)


def gumbel_p(score: Column, location: Column, scale: Column) -> Column:
    """Upper tail of a Gumbel; a zero scale (under two null scores) steps at the location."""
    degenerate = F.when(score > location, 0.0).when(score < location, 1.0)
    z = (score - location) / nullif(scale, 0.0)
    return F.when(scale == 0.0, degenerate).otherwise(1.0 - F.exp(-F.exp(-z)))


def status_of(evalue: Column, cfg) -> Column:
    return (F.when(evalue > cfg.report_evalue, F.lit(""))
            .when(evalue > cfg.inclusion_evalue, F.lit("?")).otherwise(F.lit("!")))


def display_number(x: Column) -> Column:
    """Three decimals from 0.1 up, else scientific notation without exponent padding."""
    sci = F.regexp_replace(F.format_string("%.3e", x), r"e\+?(-?)0*(\d)", "e$1$2")
    return F.when(x.isNull(), F.lit("")).when(x >= 0.1, F.format_string("%.3f", x)).otherwise(sci)


def display_bases(bases: Column, molecule: Column) -> Column:
    """T shows as U for RNA; a T in a molecule of unknown kind is an error."""
    return (F.when(molecule == "RNA", F.translate(bases, "T", "U"))
            .when((molecule == "UNKNOWN") & bases.contains("T"),
                  F.raise_error(F.lit("a T/U base needs a known molecule")).cast("string"))
            .otherwise(bases))


def nibble_base(nibble: Column) -> Column:
    """Decode a 4-bit code; anything above 4 is an error."""
    letters = F.array(*[F.lit(c) for c in "ACGTN"])
    return F.when(nibble.between(0, 4), F.element_at(letters, (nibble + 1).cast("int"))).otherwise(
        F.raise_error(F.lit("encoded nibble is not a valid base")).cast("string"))


def digest_number(*parts: Column) -> Column:
    """A deterministic 48-bit number from the parts: the same in every retry of a task."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")
