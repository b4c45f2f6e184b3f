import math

import pytest
from pyspark.sql import functions as F

from profseek.config import Distance, SearchConfig
from profseek.functions import scalars as S


def one(spark, column, **values):
    frame = spark.range(1)
    for name, (value, kind) in values.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind) if not isinstance(value, list) else F.array(
            *[F.lit(v).cast("double") for v in value]))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q, t, want", [
    (None, 0.5, -0.5), (0.5, None, -0.5), (1.2, 1.4, 0.0), (0.3, 0.3, 2.0), (0.0, 0.25, 0.75),
    (0.0, 0.5, -0.5), (0.0, 1.0, -6.0), (0.2, 0.95, -3.25),
])
def test_base_score(spark, q, t, want):
    got = one(spark, S.base_score(F.col("q"), F.col("t"), SearchConfig()), q=(q, "double"), t=(t, "double"))
    # the mismatch branch runs from the far score at 0.5 to the near one at the cap
    if q is not None and t is not None and not (q > 1 and t > 1) and abs(q - t) >= 0.5:
        d = abs(q - t)
        want = (1.0 - d) * (-0.5 + 6.0) / 0.5 - 6.0
    assert got == pytest.approx(want)


def test_gini_by_pairs(spark):
    data = [0.125, 3.5, 17.0, 0.75, 2.25, 11.5, 8.0, 0.5]
    pairs = sum(abs(a - b) for i, a in enumerate(data) for b in data[i + 1:])
    assert one(spark, S.gini(F.col("v")), v=(data, None)) == pytest.approx(pairs / (len(data) * sum(data)))
    assert one(spark, S.gini(F.col("v")), v=([0.0, 0.0], None)) is None


def test_cap_keeps_missing(spark):
    assert one(spark, S.capped(F.col("v"), 1.0), v=([0.5, None, 3.0], None)) == [0.5, None, 1.0]


@pytest.mark.parametrize("values, want", [
    ([1.0, 2.0], (0, 2)), ([None, 1.0, None, 2.0, None], (1, 4)), ([None, None], (0, 2)), ([None, 1.0], (1, 2))])
def test_trim_range(spark, values, want):
    got = one(spark, S.trim_range(F.col("v")), v=(values, None))
    assert (got["start"], got["end"]) == want


def test_text_scalars(spark):
    assert one(spark, S.gc_fraction(F.col("b")), b=("ACGT", "string")) == 0.5
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a=("ACGT", "string"), b=("AGGA", "string")) == 2
    assert one(spark, S.display_bases(F.col("b"), F.col("m")), b=("ATN", "string"), m=("RNA", "string")) == "AUN"
    with pytest.raises(Exception, match="known molecule"):
        one(spark, S.display_bases(F.col("b"), F.col("m")), b=("AT", "string"), m=("UNKNOWN", "string"))
    with pytest.raises(Exception, match="valid base"):
        one(spark, S.nibble_base(F.col("n")), n=(5, "int"))


@pytest.mark.parametrize("x, want", [
    (0.1234, "0.123"), (5.665e-8, "5.665e-8"), (0.0123, "1.230e-2"), (1.5e-12, "1.500e-12"), (0.0, "0.000e0"),
    (12.0, "12.000"), (None, "")])
def test_display_number(spark, x, want):
    assert one(spark, S.display_number(F.col("x")), x=(x, "double")) == want


def test_gumbel(spark):
    p = lambda x, loc, sc: one(spark, S.gumbel_p(F.col("x"), F.col("l"), F.col("s")), x=(x, "double"),
                               l=(loc, "double"), s=(sc, "double"))
    for x, at, width in ((2.2, -0.3, 0.9), (-1.1, 0.4, 2.3), (6.25, 5.0, 0.35)):
        assert 1 - p(x, at, width) == pytest.approx(math.exp(-math.exp(-(x - at) / width)))
    assert p(3.0, 0.0, 0.0) == 0.0 and p(-1.0, 0.0, 0.0) == 1.0 and p(0.0, 0.0, 0.0) is None


def test_deigan(spark):
    e = lambda v: one(spark, S.deigan(F.col("v"), 1.8, -0.6), v=(v, "double"))
    assert e(None) == 0.0 and e(-0.5) == 0.0 and e(0.5) == pytest.approx(1.8 * math.log(1.5) - 0.6)


def test_align_tolerance(spark):
    args = dict(q_start=(5, "long"), q_end=(14, "long"), d_start=(30, "long"), d_end=(39, "long"),
                trim_start=(0, "long"), trim_end=(40, "long"), target_len=(100, "long"))
    got = one(spark, S.align_tolerance(*[F.col(c) for c in args], 0.1), **args)
    assert (got["up"], got["down"]) == (5 + 1, 25 + 3)


def test_status(spark):
    cfg = SearchConfig()
    st = lambda e: one(spark, S.status_of(F.col("e"), cfg), e=(e, "double"))
    assert (st(0.2), st(0.1), st(0.05), st(0.01)) == ("", "?", "?", "!")


def test_distance_option():
    assert Distance.parse("3").absolute(10) == 3
    assert Distance.parse("0.29").absolute(10) == 2
    for bad in ("1.5", "x", "-1"):
        with pytest.raises(ValueError):
            Distance.parse(bad)


def test_config_rules():
    with pytest.raises(ValueError):
        SearchConfig(kmer_max_gc_diff=0.1)
    with pytest.raises(ValueError):
        SearchConfig(kmer_max_seq_dist=Distance(2))
    cfg = SearchConfig(match_kmer_gc_content=True)
    assert cfg.max_gc_diff == pytest.approx(0.2676 * math.exp(-0.053 * 15))
    text = cfg.to_toml()
    assert "kmer-len = 15\n" in text and "align-match-score = [-0.5, 2.0]\n" in text and "tile" not in text
