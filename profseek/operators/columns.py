"""Shuffles of alignment columns for the folding null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profseek.functions.scalars import digest_number


def column_blocks(length: Column, block: int, *key: Column) -> Column:
    """Blocks (start, len) of alignment columns; one odd-sized block sits at a drawn index.

    Up to block + 2 columns stay as they are.
    """
    full, odd = F.floor(length / block).cast("int"), (length % block).cast("int")
    count = full + F.when(odd > 0, 1).otherwise(0)
    at = F.when(odd > 0, (digest_number(*key, F.lit("odd")) % F.when(count > 0, count)).cast("int")).otherwise(-1)

    def one(i):
        shifted = (at >= 0) & (i > at)
        start = F.when(shifted, (i - 1) * block + odd).otherwise(i * block)
        return F.struct(start.cast("int").alias("start"), F.when(i == at, odd).otherwise(F.lit(block)).cast("int")
                        .alias("len"))

    whole = F.array(F.struct(F.lit(0).alias("start"), length.cast("int").alias("len")))
    return F.when(length <= block + 2, whole).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))


def column_permutation(length: Column, block: int, in_block: bool, *key: Column) -> Column:
    """New order of alignment columns: blocks by digest, and columns inside a block if asked."""
    blocks = column_blocks(length, block, *key)
    ranked = F.array_sort(F.transform(blocks, lambda b: F.struct(
        digest_number(*key, F.lit("block"), b["start"]).alias("k"), b.alias("b"))))

    def cells(s):
        at = F.sequence(s["b"]["start"], s["b"]["start"] + s["b"]["len"] - 1)
        if not in_block:
            return at
        keyed = F.transform(at, lambda i: F.struct(digest_number(*key, F.lit("cell"), i).alias("k"), i.alias("i")))
        return F.transform(F.array_sort(keyed), lambda x: x["i"])

    return F.when(length > 0, F.flatten(F.transform(ranked, cells))).otherwise(F.array().cast("array<int>"))


def gather(values: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(values, i + 1))
