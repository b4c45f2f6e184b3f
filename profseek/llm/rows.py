"""Small helpers that the operators share: whole rows beside derived columns."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def packed(df: DataFrame, **named: str) -> DataFrame:
    """`row` with all columns, and the given ones under fixed names, so no column of the input can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[df[c].alias(k) for k, c in named.items()])


def without_cycle_search(batches: Iterable) -> Iterator:
    """The batches, with Python's search for reference cycles off while they are worked on.

    Per-worker memories hold millions of small objects and no cycles; searching
    them again and again would cost more than the work itself.
    """
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()
