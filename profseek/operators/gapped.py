"""Gapped views: values laid over an alignment path ('x' takes a value, '-' is a gap)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _laid(all_values: Column, n: Column, path: Column, end: Column) -> Column:
    """Structs (column, gap, value) of the first n values and the gaps before the column `end`, in path order.

    Values go to their columns by number: the k-th value to the k-th column that
    takes one. So a path is passed once for each kind and its cells sorted, and no
    array is copied per column.
    """
    columns = lambda mark: F.array_compact(F.transform(
        F.split(path, ""), lambda c, i: F.when(c == mark, i)))

    def cells(values: Column, takes: Column) -> Column:
        nothing = F.get(F.slice(values, 1, 1), F.lit(1))  # a null of the type of the values
        used = F.least(F.size(takes), n)
        placed = F.zip_with(F.slice(takes, F.lit(1), used), F.slice(values, F.lit(1), used), lambda c, v: F.struct(
            c.alias("column"), F.lit(False).alias("gap"), v.alias("value")))
        # without such a column every gap is before it
        gaps = _once(F.coalesce(F.get(takes, end), F.lit(2**31 - 1)), lambda stop: _once(columns("-"), lambda all_: F.filter(
            all_, lambda c: c < stop)))
        return F.array_sort(F.concat(placed, F.transform(gaps, lambda c: F.struct(
            c.alias("column"), F.lit(True).alias("gap"), nothing.alias("value")))))

    return _once(all_values, lambda values: _once(columns("x"), lambda takes: cells(values, takes)))


def gapped_bases(bases: Column, path: Column) -> Column:
    """Bases with gaps; stops at a base column without a base, appends bases left over."""
    n = F.length(bases)
    body = F.transform(_laid(F.split(bases, ""), n, path, n), lambda s: F.when(s["gap"], "-").otherwise(s["value"]))
    used = F.length(F.regexp_replace(path, "-", ""))
    rest = F.when(used < n, F.substring(bases, used + 1, n - used)).otherwise("")
    return F.concat(F.array_join(body, ""), rest)


def gapped_values(values: Column, path: Column) -> Column:
    """Structs (gap, value); columns after the last value are dropped, values left over appended."""
    n = F.size(values)
    laid = _laid(values, n, path, n - 1)
    body = F.transform(F.when(n > 0, laid).otherwise(F.slice(laid, 1, 0)),
                       lambda s: F.struct(s["gap"].alias("gap"), s["value"].alias("value")))
    used = F.length(F.regexp_replace(path, "-", ""))
    left = F.slice(values, F.least(used, n) + 1, F.greatest(n - used, F.lit(0)))
    return F.concat(body, F.transform(left, lambda v: F.struct(F.lit(False).alias("gap"), v.alias("value"))))


def gapped_json(values: Column, path: Column) -> Column:
    """JSON array: a gap is null, a missing value the text "NaN"."""
    cell = lambda s: (F.when(s["gap"], "null").when(s["value"].isNull(), '"NaN"')
                      .otherwise(s["value"].cast("float").cast("string")))
    return F.concat(F.lit("["), F.array_join(F.transform(gapped_values(values, path), cell), ","), F.lit("]"))


def paired_support(sequence: Column, blocks: Column) -> Column:
    """(total, canonical) base pairs of a gapped sequence over paired blocks.

    Block columns [l_start, l_end) pair with [r_start, r_end) read backwards.
    """
    def pairs(b):
        left = F.substring(sequence, b["l_start"] + 1, b["l_end"] - b["l_start"])
        right = F.reverse(F.substring(sequence, b["r_start"] + 1, b["r_end"] - b["r_start"]))
        return F.zip_with(F.split(left, ""), F.split(right, ""), lambda x, y: F.concat(x, y))

    fixed = F.array(*[F.lit(p) for p in ("AT", "TA", "GT", "TG", "GC", "CG")])
    flat = F.flatten(F.transform(blocks, pairs))
    return F.struct(F.size(flat).alias("total"),
                    F.size(F.filter(flat, lambda p: F.array_contains(fixed, p))).alias("canonical"))
