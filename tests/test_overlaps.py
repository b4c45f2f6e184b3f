"""Overlap removal on crowded stretches, and the first null seeds without a window over all of a query."""

import random
import re
import time

import pandas as pd

from profseek.config import SearchConfig
from profseek.operators import significance
from profseek.operators.seeds import first_seeds

HIT = ("query_id string, target_id string, target_ord long, q_seed_start long, d_seed_start long, q_start long, q_end long, "
       "d_start long, d_end long, score double, trim_len long")


def plain_losers(rows, limit):
    def overlap(a0, a1, b0, b1):
        return b0 < a1 and min(a1, b1) + 1 - max(a0, b0) > min(a1 + 1 - a0, b1 + 1 - b0) * limit

    lost = set()
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r[5], -r[6], r[2], r[7], -r[8], r[3], r[4]))
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                if not overlap(a[5], a[6], b[5], b[6]):
                    break
                if overlap(a[7], a[8], b[7], b[8]):
                    lost.add((b if a[9] >= b[9] else a)[:5])
    return lost


def made(rng, n, spread, targets=2):
    rows = []
    for i in range(n):
        q, d, size = rng.randrange(40), rng.randrange(spread), rng.randrange(5, 30)
        rows.append(("q", f"t{rng.randrange(targets)}", 0, i, d, q, q + size, d, d + size + rng.randrange(3),
                     float(rng.randrange(20)), 40))
    return rows


def test_losers(spark):
    rng = random.Random(3)
    for n, spread in ((150, 60), (250, 1500), (1, 5)):
        rows = made(rng, n, spread)
        cfg = SearchConfig()
        got = {tuple(r) for r in significance.overlap_losers(spark.createDataFrame(rows, HIT), cfg).collect()}
        assert got == plain_losers(rows, cfg.max_align_overlap)
    assert significance.overlap_losers(spark.createDataFrame([], HIT), SearchConfig()).count() == 0


def test_crowded_stretch():
    """10^5 hits in one stretch: no pairs are written, most hits end at the first stronger one."""
    rng = random.Random(5)
    frame = pd.DataFrame(made(rng, 100_000, 60, targets=1), columns=[f.split()[0] for f in HIT.split(", ")])
    frame = frame.sort_values(["q_start", "q_end"], ascending=[True, False])
    frame["stop_start"], frame["stop_end"] = 2**62, 0
    began = time.time()
    kept = ~significance._beaten(frame.reset_index(drop=True), 0.5)
    assert 0 < kept.sum() < 1000 and time.time() - began < 60


def test_first_seeds_needs_no_window_over_a_query(spark):
    rng = random.Random(7)
    rows = [(f"q{k}", f"t{d}", d, rng.randrange(1000), i) for k in range(3) for d in range(30)
            for i in range(rng.randrange(0, 9))]
    seeds = spark.createDataFrame(rows, "query_id string, target_id string, target_ord long, q_start long, d_start long")
    for limit in (1, 17, 100, 10_000):
        found = first_seeds(seeds, limit)
        want = set()
        for k in range(3):
            own = sorted((r for r in rows if r[0] == f"q{k}"), key=lambda r: (r[2], r[3] - r[4], r[3]))
            want |= {r for r in own[:limit]}
        got = {tuple(r[c] for c in ("query_id", "target_id", "target_ord", "q_start", "d_start")) for r in found.collect()}
        assert got == want
    plan = first_seeds(seeds, 17)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # seeds are ranked within one target; the only order over a query is that of its counts
    assert windows and all("sum(_n" in w or re.search(r"\[query_id#\d+, target_ord#\d+L?, target_id#\d+\]", w)
                           for w in windows)
