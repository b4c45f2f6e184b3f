import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from helpers import capped, make, profiles
from profseek.config import Distance, SearchConfig
from profseek.functions.shared import sliced
from profseek.operators import distance
from profseek.operators import seeds as seed_ops
from profseek.operators.distance import match_kmers
from profseek.operators.significance import remove_overlaps
from profseek.operators.tiles import stretch, tiled
from profseek.plans import search

CFG = SearchConfig(kmer_len=8, kmer_min_complexity=0.2, kmer_max_match_every_nt=20, max_kmer_dist=12)


def fixture(seed=3):
    rng = np.random.default_rng(seed)
    queries = make(rng, "q", [60, 45, 7])
    targets = make(rng, "t", [150, 900, 40, 8, 5])
    q0 = queries[0][2]
    targets[1][2][400:440] = [None if v is None else v + 0.01 for v in q0[10:50]]  # a planted relative
    return queries, targets


def expected(queries, targets, cfg):
    return sorted((q[0], t[0], i, j) for q in queries for t in targets
                  for i, j in plain.hits(capped(q[2], cfg.max_reactivity), capped(t[2], cfg.max_reactivity), cfg))


@pytest.mark.parametrize("changes", [dict(), dict(tile_len=64), dict(tile_len=64, query_block_bytes=2000),
                                     dict(query_block_bytes=2000), dict(kmer_offset=3),
                                     dict(tile_len=50, kmer_max_match_every_nt=200)])
def test_hits_equal_brute_force(spark, changes):
    cfg = CFG.replace(**changes)
    queries, targets = fixture()
    prepared = search.Queries.prepare(profiles(spark, queries), cfg)
    assert (prepared.blocks.broadcast is None) == ("query_block_bytes" in changes)
    db = tiled(profiles(spark, targets), cfg)
    assert db.has_long == ("tile_len" in changes)
    got = sorted(tuple(r) for r in match_kmers(db, prepared.blocks, cfg).select(
        "query_id", "target_id", "q_pos", "d_pos").collect())
    want = expected(queries, targets, cfg)
    assert want and got == want


def test_a_stored_block_is_read_once_for_many_batches(spark, monkeypatch):
    """Reads follow the bytes of a task; a batch that names its blocks reads no others."""
    queries = make(np.random.default_rng(4), "q", [60] * 8)
    blocks = search.Queries.prepare(profiles(spark, queries), CFG.replace(query_block_bytes=500)).blocks
    assert len(blocks) > 2
    reads, read = [], type(blocks).read
    monkeypatch.setattr(type(blocks), "read", lambda self, no: reads.append(no) or read(self, no))
    batches = [pa.RecordBatch.from_pydict({"x": [n]}) for n in range(5)]
    usable = [n for n in range(len(blocks)) if read(blocks, n) is not None]

    def met(**options):
        reads.clear()
        return sorted((b.column("x")[0].as_py(), made, no) for b, made, no, _ in blocks.meet(
            batches, lambda b: b.num_rows, **options))

    assert met() == sorted((n, 1, no) for n in range(5) for no in usable)
    assert reads == list(range(len(blocks)))
    assert met(wanted=lambda b: {usable[0]}) == [(n, 1, usable[0]) for n in range(5)]
    assert reads == [usable[0]]
    monkeypatch.setattr(distance, "HELD_BYTES", 2 * batches[0].nbytes)
    assert met() == sorted((n, 1, no) for n in range(5) for no in usable)
    assert len(reads) == 3 * len(blocks)


@pytest.mark.parametrize("tile_len", [8192, 64])
def test_base_filters(spark, tile_len):
    cfg = CFG.replace(tile_len=tile_len, match_kmer_seq=True, kmer_max_seq_dist=Distance(6),
                      match_kmer_gc_content=True, kmer_max_gc_diff=0.2)
    queries, targets = fixture()
    prepared = search.Queries.prepare(profiles(spark, queries), cfg)
    hits = match_kmers(tiled(profiles(spark, targets), cfg), prepared.blocks, cfg)
    got = sorted(tuple(r) for r in hits.select("query_id", "target_id", "q_pos", "d_pos").collect())
    q_bases, t_bases = ({r[0]: r[1] for r in side} for side in (queries, targets))
    want = []
    for q, t, i, j in expected(queries, targets, cfg):
        a, b = q_bases[q][i:i + 8], t_bases[t][j:j + 8]
        gc = [sum(c in "CG" for c in s) / 8 for s in (a, b)]
        if sum(x != y for x, y in zip(a, b)) <= 6 and abs(gc[0] - gc[1]) <= 0.2:
            want.append((q, t, i, j))
    assert got == want


@pytest.mark.parametrize("changes", [dict(), dict(tile_len=64), dict(min_kmers=1, max_kmer_dist=3),
                                     dict(query_block_bytes=2000)])
def test_seeds_and_parts(spark, changes):
    cfg = CFG.replace(**changes)
    queries, targets = fixture()
    prepared = search.Queries.prepare(profiles(spark, queries), cfg)
    found = search.seeds_of(prepared, tiled(profiles(spark, targets), cfg), cfg).collect()
    q_values, t_values = ({r[0]: capped(r[2], cfg.max_reactivity) for r in side} for side in (queries, targets))
    want = []
    for q in q_values:
        for t in t_values:
            pairs = plain.hits(q_values[q], t_values[t], cfg)
            for a, z, d0, d1, n in plain.groups(pairs, cfg):
                score = sum(plain.pair(x, y, cfg) for x, y in zip(q_values[q][a:z + 1], t_values[t][d0:d1 + 1]))
                if score > 0:
                    want.append((q, t, a, z, d0, d1, n, round(score, 9)))
    got = sorted((r.query_id, r.target_id, r.q_start, r.q_end, r.d_start, r.d_end, r.n_kmers, round(r.seed_score, 9))
                 for r in found)
    assert want and got == sorted(want)
    for r in found:  # the attached part is a stretch of the target that covers the seed
        part = t_values[r.target_id][r.t_from:r.t_from + len(r.t_values)]
        assert part == r.t_values and r.t_from <= r.d_start and r.t_from + len(part) > r.d_end


def test_native_groups_equal_plain(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (150, 2))})
    hits = spark.createDataFrame([("q", "t", 0, a, b) for a, b in pairs],
                                 "query_id string, target_id string, target_ord long, q_pos long, d_pos long")
    cfg = CFG.replace(max_kmer_dist=0, min_kmers=2)
    got = seed_ops.as_seeds(seed_ops.islands(hits, cfg), cfg).collect()
    assert sorted((r.q_start, r.q_end, r.d_start, r.d_end, r.n_kmers) for r in got) == plain.groups(pairs, cfg)


def hits_frame(spark, rows):
    return spark.createDataFrame(
        [("q", t, 0, n, n, q0, q1, d0, d1, 100, float(s)) for n, (t, q0, q1, d0, d1, s) in enumerate(rows)],
        "query_id string, target_id string, target_ord long, q_seed_start long, d_seed_start long, q_start long, "
        "q_end long, d_start long, d_end long, trim_len long, score double")


def left(spark, rows):
    kept = remove_overlaps(hits_frame(spark, rows), SearchConfig()).collect()
    return {r.q_seed_start for r in kept}


@pytest.mark.parametrize("rows, want", [
    # neighbours that share less than half
    ([("m", 20, 29, 5, 24, 3.0), ("m", 27, 41, 6, 25, 3.0), ("m", 38, 60, 7, 26, 3.0)], {0, 1, 2}),
    # most of it shared: the higher score stays, the earlier one of equals
    ([("m", 7, 30, 40, 63, 9.0), ("m", 12, 35, 41, 64, 4.0)], {0}),
    ([("m", 7, 30, 40, 63, 4.0), ("m", 12, 35, 41, 64, 9.0)], {1}),
    ([("m", 7, 30, 40, 63, 6.0), ("m", 12, 35, 41, 64, 6.0)], {0}),
    # one inside the other
    ([("m", 3, 43, 70, 110, 1.0), ("m", 11, 19, 78, 86, 2.5)], {1}),
    # a dropped hit still drops the next
    ([("m", 50, 69, 0, 19, 8.0), ("m", 57, 76, 2, 21, 7.0), ("m", 64, 83, 4, 23, 6.0)], {0}),
    # elsewhere on the target, or on another target
    ([("m", 7, 30, 40, 63, 9.0), ("m", 12, 35, 300, 323, 4.0)], {0, 1}),
    ([("m", 7, 30, 40, 63, 9.0), ("w", 12, 35, 41, 64, 4.0)], {0, 1}),
])
def test_overlap_cases(spark, rows, want):
    assert left(spark, rows) == want


def test_overlaps_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(400):
        q0, d0, n, extra = rng.integers(0, 60), rng.integers(0, 300), rng.integers(3, 30), rng.integers(0, 4)
        rows.append((str(rng.integers(0, 3)), int(q0), int(q0 + n), int(d0), int(d0 + n + extra),
                     float(rng.integers(0, 50))))
    assert left(spark, rows) == plain.survivors(rows, 0.5)


def test_search_finds_planted_relative(spark):
    queries, targets = fixture()
    cfg = CFG.replace(null_hsgs=300, inclusion_evalue=0.01, report_evalue=0.5)
    hits = search.search_hits(profiles(spark, queries), profiles(spark, targets), cfg).orderBy("evalue").collect()
    best = hits[0]
    assert (best.query_id, best.target_id, best.status) == ("q0", "t1", "!")
    assert best.d_start - best.q_start == 390 and best.evalue < 1e-4
    again = search.search_hits(profiles(spark, queries), profiles(spark, targets), cfg.replace(tile_len=64))
    key = lambda r: (r.query_id, r.target_id, r.q_start, r.q_end, r.d_start, r.d_end, r.q_path, r.t_path)
    assert sorted(map(key, again.collect())) == sorted(map(key, hits))


def test_null_rounds_do_not_change_the_seeds(spark, monkeypatch):
    queries, targets = fixture()
    cfg = CFG.replace(null_hsgs=40, db_shuffles=8)
    q, db = search.Queries.prepare(profiles(spark, queries), cfg), profiles(spark, targets)
    key = ["query_id", "target_ord", "q_start", "d_start"]
    take = lambda: sorted(tuple(r) for r in search.null_seeds(q, db, cfg).select(*key).collect())
    monkeypatch.setattr(search, "FIRST_NULL_POSITIONS", 10 ** 9)
    whole = take()
    monkeypatch.setattr(search, "FIRST_NULL_POSITIONS", 300)
    assert take() == whole and len(whole) > 40


def test_results_come_in_order(spark):
    queries, targets = fixture()
    cfg = CFG.replace(null_hsgs=100, report_evalue=1e6, inclusion_evalue=0.01)
    table = search.search(profiles(spark, queries), profiles(spark, targets), cfg)
    assert table.columns[:6] == ["Query", "DB field", "Qstart", "Qend", "Dstart", "Dend"]
    values = [float(r["E-value"]) for r in table.collect()]
    assert len(values) > 3 and values == sorted(values)
    assert table.where(F.col("status") == "!").count() >= 1


def test_tiles_of_a_stretch_stay_in_one_task(spark):
    """So that sums over the tiles of a target leave a task once, in small inputs too."""
    _, targets = fixture()
    tiles = tiled(profiles(spark, targets), CFG.replace(tile_len=16)).tiles
    places = tiles.withColumn("part", F.spark_partition_id()).groupBy("target_id").agg(
        F.count_distinct("part").alias("n"), F.count("*").alias("tiles"))
    assert {r.n for r in places.collect()} == {1} and places.agg(F.max("tiles")).first()[0] == 57
    wide = stretch(F.col("tile"), CFG.replace(tile_len=4096))
    assert [r[0] for r in spark.range(5).select(F.col("id").alias("tile")).select(wide).collect()] == [0, 0, 1, 1, 2]


def test_one_array_of_moments_a_target(spark):
    """A task adds up a target's tiles, whatever the size of what it holds."""
    cfg = CFG.replace(tile_len=16)
    queries, targets = fixture()
    blocks = search.Queries.prepare(profiles(spark, queries), cfg).blocks
    db = tiled(profiles(spark, targets), cfg)
    rows = distance.moment_arrays(db, db.tiles, blocks, cfg).collect()
    assert sorted((r.target_id, r.n) for r in rows) == [("t0", 143), ("t1", 893), ("t2", 33), ("t3", 1)]


def test_kernels_take_slices_of_large_batches():
    batch = pa.RecordBatch.from_pydict({"x": pa.array(range(10_000)), "v": pa.array([[1.0] * 9] * 10_000)})
    parts = list(sliced(iter([batch, batch.slice(0, 0), batch.slice(9_999)]), 64 << 10))
    assert max(p.nbytes for p in parts) <= 64 << 10 and len(parts) < 30
    assert pa.Table.from_batches(parts).column("x").to_pylist() == [*range(10_000), 9_999]
    assert [p.num_rows for p in sliced([batch.slice(0, 3)], 1)] == [1, 1, 1]
