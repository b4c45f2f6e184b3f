import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import make, profiles
from profseek.config import SearchConfig
from profseek.operators import columns, dotbracket, fold, gapped, nulls, tiles
from profseek.operators.numbering import dense_ordinals, number_positions


def test_positions_of_a_hot_key(spark):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", int(x), i) for i, x in enumerate(rng.integers(0, 50, 600))]
    frame = spark.createDataFrame(rows, "k string, x long, i long")
    plain = number_positions(frame, ["k"], ["x", "i"], hot_rows=10 ** 6)
    split = number_positions(frame, ["k"], ["x", "i"], hot_rows=100)
    key = lambda d: sorted((r.k, r.pos, r.group_len, r.i) for r in d.collect())
    assert key(plain) == key(split)
    hot = [r for r in key(split) if r[0] == "hot"]
    assert [r[1] for r in hot] == list(range(200)) and hot[0][2] == 200


def test_dense_ordinals(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("id"))
    got = sorted(r.dense_ord for r in dense_ordinals(frame, "id", digits=1).collect())
    assert got == list(range(500))


@pytest.mark.parametrize("n, block, offset, want", [(48, 6, 0, 8), (50, 6, 0, 9), (50, 6, 2, 9), (50, 6, 1, 10), (5, 9, 0, 1)])
def test_chunk_count(spark, n, block, offset, want):
    got = spark.range(1).select(nulls.chunk_count(F.lit(n), F.lit(offset), block).alias("c")).first()["c"]
    assert got == want


@pytest.mark.parametrize("in_block", [False, True])
def test_shuffles_keep_cells(spark, in_block):
    rng = np.random.default_rng(1)
    frame = profiles(spark, make(rng, "t", [57, 23, 40, 10]))
    cfg = SearchConfig(db_in_block_shuffle=in_block, db_block_size=7)
    drawn = nulls.draws(frame, 0, 12, 4, cfg)
    source = {r.id: r for r in frame.collect()}
    wide = {r.ord: r for r in nulls.shuffled_rows(drawn, cfg).collect()}
    assert sorted(wide) == list(range(12))
    for r in wide.values():
        a = source[r.id]
        assert sorted(r.bases) == sorted(a.bases)
        assert sorted(map(str, r.reactivity)) == sorted(map(str, a.reactivity))
        if not in_block:  # bases and values move together
            cells = sorted(zip(r.bases, map(str, r.reactivity)))
            assert cells == sorted(zip(a.bases, map(str, a.reactivity)))
    assert sum(r.bases != source[r.id].bases for r in wide.values()) >= 6
    rows = nulls.shuffled_positions(nulls.long_draws(drawn), cfg)
    again = tiles.wide_from_long(rows.withColumn("id", F.struct("id", "ord"))).collect()
    if not in_block:
        assert {r.id.ord: (r.bases, r.reactivity) for r in again} == {
            k: (r.bases, r.reactivity) for k, r in wide.items()}
    else:
        assert {r.id.ord: sorted(r.bases) for r in again} == {k: sorted(r.bases) for k, r in wide.items()}


def test_gumbel_fit(spark):
    data = np.random.default_rng(21).gumbel(2.0, 1.7, 15).tolist()
    frame = spark.createDataFrame([("q", x) for x in data] + [("one", 3.5)], "query_id string, score double")
    got = {r.query_id: r for r in nulls.gumbel_fit(frame).collect()}
    mean, var = np.mean(data), np.var(data, ddof=1)
    scale = math.sqrt(var * 6) / math.pi
    assert got["q"].scale == pytest.approx(scale)
    assert got["q"].location == pytest.approx(mean - scale * 0.5772156649015329)
    assert (got["one"].location, got["one"].scale) == (3.5, 0.0)


@pytest.mark.parametrize("path, values, want", [
    ("xx-x", [1.0, None, 0.5], '[1.0,"NaN",null,0.5]'), ("x--", [1.0], "[1.0]"), ("-x", [1.0], "[null,1.0]"),
    ("x", [1.0, 2.0, None], '[1.0,2.0,"NaN"]'), ("x-x", [1.0], "[1.0]")])
def test_gapped_json(spark, path, values, want):
    frame = spark.createDataFrame([(path, values)], "p string, v array<double>")
    assert frame.select(gapped.gapped_json(F.col("v"), F.col("p")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("path, bases, want", [
    ("xx-x", "ACG", "AC-G"), ("x-", "ACG", "A-CG"), ("x--x", "A", "A--"), ("-x", "A", "-A")])
def test_gapped_bases(spark, path, bases, want):
    frame = spark.createDataFrame([(path, bases)], "p string, b string")
    assert frame.select(gapped.gapped_bases(F.col("b"), F.col("p")).alias("x")).first()["x"] == want


@pytest.mark.parametrize("text, want", [
    (".((...)).", [(1, 3, 6, 8)]), ("(((.)..))", [(0, 2, 7, 9), (2, 3, 4, 5)]),
    ("(..(...).(.).)", [(0, 1, 13, 14), (3, 4, 7, 8), (9, 10, 11, 12)]), (".....", []),
    ("(.)((..))", [(0, 1, 2, 3), (3, 5, 7, 9)]), ("((.((.)).(.)))", [(0, 2, 12, 14), (3, 5, 6, 8), (9, 10, 11, 12)])])
def test_paired_blocks(spark, text, want):
    frame = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "id int, t string")
    found = {r.id: r for r in dotbracket.with_blocks(frame, ["id"], "t").withColumn(
        "x", dotbracket.structure_text(F.col("blocks"), F.length("t"))).collect()}
    for k in (1, 2):
        assert [tuple(b) for b in found[k].blocks] == want and found[k].x == text
    assert found[3].blocks is None and found[4].blocks == [] and found[4].x == ""


@pytest.mark.parametrize("bad", ["((.)", "(.))", ".)(", "(x)"])
def test_bad_structures(spark, bad):
    with pytest.raises(Exception, match="dot-bracket"):
        dotbracket.paired_blocks(spark.createDataFrame([(bad,)], "t string"), [], "t").collect()


def test_gapped_views_of_long_paths(spark):
    """Twice the columns take about twice the time, to a hundred thousand of them."""
    took = {}
    for n in (1_000, 50_000, 100_000):
        frame = spark.createDataFrame([("x-" * (n // 2), "ACGT" * (n // 8), [1.0] * (n // 2))], "p string, b string, v array<double>")
        began = time.time()
        r = frame.select(gapped.gapped_bases(F.col("b"), F.col("p")).alias("b"),
                         F.size(gapped.gapped_values(F.col("v"), F.col("p"))).alias("n")).first()
        took[n] = time.time() - began
        assert r["b"] == "".join(c + "-" for c in "ACGT" * (n // 8)) and r["n"] == n - 1
    assert took[100_000] < 4 * took[50_000] + 2


@pytest.mark.parametrize("in_block", [False, True])
def test_column_permutations(spark, in_block):
    frame = spark.range(0, 40).select("id", columns.column_permutation(
        F.col("id"), 3, in_block, F.lit(1), F.col("id")).alias("o"), columns.column_blocks(
        F.col("id"), 3, F.lit(1), F.col("id")).alias("b"))
    for r in frame.collect():
        assert sorted(r.o) == list(range(r.id))
        if r.id <= 5:
            assert in_block or r.o == list(range(r.id))
            continue
        sizes = [b.len for b in r.b]
        assert sum(sizes) == r.id and sum(s != 3 for s in sizes) == (r.id % 3 > 0)
        if not in_block:
            runs = {tuple(range(b.start, b.start + b.len)) for b in r.b}
            at = 0
            while at < r.id:
                width = next(len(x) for x in runs if x[0] == r.o[at])
                assert tuple(r.o[at:at + width]) in runs
                at += width


def test_fold_evaluation(spark):
    def one_stem(targets, queries, pseudo, cfg, structure):
        """A folding function for tests: the only structure is one stem over the whole alignment."""
        energies, texts = [], []
        for t in targets:
            n = (len(t) - 4) // 2
            paired = sum(t[i] + t[-1 - i] in ("AT", "TA", "GC", "CG", "GT", "TG") for i in range(n))
            energies.append(-float(paired))
            texts.append("(" * n + "." * (len(t) - 2 * n) + ")" * n if 2 * paired > n else "." * len(t))
        return np.array(energies), texts if structure else None

    stem = "GGGCGCGACCAAAAGGTCGCGCCC"
    loose = "AAAAAACAAAAAACAAAAAACAAA"
    cfg = SearchConfig(eval_align_fold=True, shuffles=30, block_size=3)
    db = profiles(spark, [("s", stem, [0.1] * 24), ("l", loose, [0.1] * 24)])
    queries = profiles(spark, [("q", stem, [0.1] * 24), ("ql", loose, [0.1] * 24)])
    hits = spark.createDataFrame(
        [("q", "s", 0, 0, 0, 0, 23, 0, 23, "x" * 24, "x" * 24, "!"), ("ql", "l", 0, 0, 0, 0, 23, 0, 23, "x" * 24, "x" * 24, "!"),
         ("q", "s", 1, 0, 0, 0, 23, 0, 23, "x" * 24, "x" * 24, "?")],
        "query_id string, target_id string, target_ord long, q_seed_start long, d_seed_start long, q_start long, "
        "q_end long, d_start long, d_end long, q_path string, t_path string, status string")
    got = {(r.query_id, r.target_ord): r for r in fold.evaluate_folds(hits, queries, db, cfg, one_stem).collect()}
    best = got["q", 0]
    assert best.target_bp_support == 1.0 and best.status == "!" and best.mfe_pvalue < 0.05
    assert best.dotbracket == "((((((((((....))))))))))"
    assert got["ql", 0].target_bp_support is None and got["ql", 0].status == "!"  # no pair: share undefined
    assert got["ql", 0].mfe_pvalue == 1.0
    assert got["q", 1].mfe_pvalue is None and got["q", 1].status == "?"


def test_weak_support_lowers_the_status(spark):
    def one_pair(targets, queries, pseudo, cfg, structure):
        return np.zeros(len(targets)), ["((....))"] * len(targets) if structure else None

    cfg = SearchConfig(eval_align_fold=True, shuffles=5)
    side = [("a", "GAAAAAAC", [0.1] * 8)]
    hits = spark.createDataFrame(
        [("a", "a", 0, 0, 0, 0, 7, 0, 7, "x" * 8, "x" * 8, "!")],
        "query_id string, target_id string, target_ord long, q_seed_start long, d_seed_start long, q_start long, "
        "q_end long, d_start long, d_end long, q_path string, t_path string, status string")
    r = fold.evaluate_folds(hits, profiles(spark, side), profiles(spark, side), cfg, one_pair).first()
    assert r.status == "?" and r.target_bp_support == 0.5 and r.mfe_pvalue is None
