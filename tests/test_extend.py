import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import plain
from profseek.config import SearchConfig
from profseek.operators import extend
from profseek.operators.extend import extend_direction

PARAMS = [
    dict(),
    dict(align_gap_open_penalty=-2.0, align_gap_ext_penalty=-0.5),
    dict(align_gap_open_penalty=-1.0, align_gap_ext_penalty=-0.25, align_score_seq=True),
    dict(align_gap_open_penalty=-0.5, align_gap_ext_penalty=-0.125, align_max_drop_off_rate=0.95,
         align_max_drop_off_bases=2),
    dict(align_len_tolerance=0.5, align_gap_open_penalty=-1.0, align_gap_ext_penalty=-0.5, max_reactivity=1.5),
    dict(align_gap_open_penalty=-1e6, align_gap_ext_penalty=-1e6, align_max_drop_off_rate=0.0),
]


def _cells(rng, n):
    x = np.round(rng.exponential(0.4, n), 3)
    return np.where(rng.random(n) < 0.08, np.nan, np.minimum(x, 1.2))


@pytest.mark.parametrize("params", PARAMS)
def test_kernel_equals_cell_by_cell(params):
    rng = np.random.default_rng(7)
    cfg = SearchConfig(**params)
    parts, start = [], []
    for n in range(120):
        nq, nt = rng.integers(0, 45, 2) if n % 10 else rng.integers(100, 150, 2)
        q, t = _cells(rng, nq), _cells(rng, nt)
        if n % 2 and nq and nt:  # a related target with an indel
            t = np.r_[q[: nq // 2], _cells(rng, int(rng.integers(0, 4))), q[nq // 2:] + 0.02]
        letters = [rng.choice(np.frombuffer(b"ACGT", np.uint8), len(x)) for x in (q, t)]
        parts.append((q, t, *letters))
        start.append(float(rng.uniform(0.5, 40)))
    best, row, col, paths = extend_direction(parts, np.array(start), True, cfg)
    for n, (q, t, qb, tb) in enumerate(parts):
        want = plain.extend(q, t, qb, tb, start[n], cfg)
        got = (best[n], row[n], col[n], *paths[n])
        assert got[0] == pytest.approx(want[0], abs=1e-9), n
        assert got[1:] == want[1:], n
    fast = extend_direction(parts, np.array(start), False, cfg)
    assert np.array_equal(fast[0], best) and np.array_equal(fast[1], row) and np.array_equal(fast[2], col)


def test_gaps_do_occur():
    rng = np.random.default_rng(1)
    q = _cells(rng, 60)
    t = np.r_[q[:20], q[22:]]
    cfg = SearchConfig(align_gap_open_penalty=-1.0, align_gap_ext_penalty=-0.5)
    letters = np.full(60, ord("A"), np.uint8)
    *_, paths = extend_direction([(q, t, letters, letters[:58])], np.array([10.0]), True, cfg)
    assert "-" in paths[0][1] and len(paths[0][0]) == len(paths[0][1])


def test_broken_paths_fail_the_job():
    extend.check_paths([3], [5], [7], [10], ["xx-x"], ["xxxx"])
    for query, target in (("xxx", "xxxx"), ("xxxx", "xxxx"), ("xx-x", "xx-x"), ("xx-x-", "xxxx-")):
        with pytest.raises(ValueError, match="broken alignment"):
            extend.check_paths([3], [5], [7], [10], [query], [target])


class _Kernel:
    """Stands for a table of seeds and keeps the function that would run in its tasks."""

    def select(self, *_):
        return self

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def _seed_batch(n, length=120):
    rng = np.random.default_rng(5)
    whole = lambda x: pa.array(np.full(n, x), pa.int64())
    lists = lambda: pa.ListArray.from_arrays(
        np.arange(0, n * length + 1, length, dtype=np.int32), pa.array(_cells(rng, n * length)))
    text = lambda x: pa.array([x] * n, pa.string())
    return pa.RecordBatch.from_pydict({
        "query_id": text("q"), "target_id": text("t"), "target_ord": whole(0), "q_start": whole(50), "q_end": whole(60),
        "d_start": whole(50), "d_end": whole(60), "n_kmers": whole(2), "seed_score": pa.array(np.full(n, 9.0)),
        "q_values": lists(), "q_bases": text("A" * length), "trim_start": whole(0), "trim_end": whole(length),
        "target_len": whole(length), "t_from": whole(0), "t_bases": text("C" * length), "t_values": lists()})


def test_memory_does_not_grow_with_the_seeds(spark):
    """Neither with the rows of a batch nor with the number of batches: findings 2, 3, 4 and 11."""
    kernel = extend.extend_seeds(_Kernel(), SearchConfig(align_gap_open_penalty=-2.0, align_gap_ext_penalty=-0.5))

    def peak(batches):
        tracemalloc.start()
        rows = sum(out.num_rows for out in kernel.run(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most

    small, large = _seed_batch(2_000), _seed_batch(4_000)
    rows, least = peak([small])
    assert rows == 2_000
    for batches in ([large], [small] * 2):
        rows, most = peak(batches)
        assert rows == 4_000 and most < 1.5 * least
