"""Small profiles for tests."""

import numpy as np

from profseek.schema import PROFILE


def random_profile(rng, n, missing=0.03):
    values = np.round(rng.exponential(0.45, n), 3)
    return [None if rng.random() < missing else float(v) for v in values]


def random_bases(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


def profiles(spark, rows):
    """rows of (id, bases, values)."""
    return spark.createDataFrame([(i, n, b, v, "DNA") for n, (i, b, v) in enumerate(rows)], PROFILE)


def make(rng, prefix, lengths):
    return [(f"{prefix}{n}", random_bases(rng, size), random_profile(rng, size)) for n, size in enumerate(lengths)]


def capped(values, limit):
    return [None if v is None else min(v, limit) for v in values]
