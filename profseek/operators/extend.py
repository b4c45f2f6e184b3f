"""Seed extension: a banded affine alignment to both sides, as a batch kernel.

Spark spreads the seeds; within a task the same matrix cell of many seeds is
computed at once. Seeds of similar size share a group, so that the grid of a
group is barely larger than that of its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.scalars import nullif
from profseek.functions.shared import sliced

MIN_BAND = 10
GRID_BYTES = 64 << 20
DIAGONAL, LEFT, UP = 0, 1, 2

HIT_COLUMNS = ("query_id string, target_id string, target_ord long, q_seed_start long, q_seed_end long, "
               "d_seed_start long, d_seed_end long, n_kmers long, seed_score double, raw_score double, "
               "q_start long, q_end long, d_start long, d_end long, trim_len long, target_len long, "
               "q_path string, t_path string")


def _round_half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def pair_scores(q: np.ndarray, t: np.ndarray, cfg) -> np.ndarray:
    """Score of aligned values, NaN meaning missing."""
    (m0, m1), (x0, x1) = cfg.align_match_score, cfg.align_mismatch_score
    diff = np.abs(q - t)
    close = (0.5 - diff) * ((m1 - m0) / 0.5) + m0
    apart = (cfg.max_reactivity - diff) * ((x1 - x0) / (cfg.max_reactivity - 0.5)) + x0
    score = np.where(diff < 0.5, close, apart)
    score = np.where((q > 1.0) & (t > 1.0), 0.0, score)
    return np.where(np.isnan(diff), m0, score)


class Side:
    """Slices of one direction for seeds that share a band, read outward from the seed."""

    def __init__(self, parts, band: int):
        queries, targets, q_bases, t_bases = zip(*parts)
        self.band = band
        self.nq = np.array([len(x) for x in queries], dtype=np.int64)
        self.nt = np.array([len(x) for x in targets], dtype=np.int64)
        # query cell k sits at row k + band + 2, so row i of the grid reads rows i .. i + 2 band + 1
        self.q, self.qb = _padded(queries, np.float64, np.nan, band + 2), _padded(q_bases, np.uint8, 0, band + 2)
        self.t, self.tb = _padded(targets, np.float64, np.nan, 0), _padded(t_bases, np.uint8, 1, 0)


def _padded(rows, dtype, fill, border: int) -> np.ndarray:
    """Columns of different length in one array, with extra rows on both ends."""
    width = max(len(r) for r in rows)
    out = np.full((width + 2 * border, len(rows)), fill, dtype=dtype)
    for at, row in enumerate(rows):
        out[border: border + len(row), at] = row
    return out


def band_of(nq: int, nt: int, tolerance: float) -> int:
    return max(int(np.floor((min(nq, nt) + 1) * tolerance + 0.5)), MIN_BAND)


class _Grid:
    """Running state of the seeds that are still alive."""

    def __init__(self, side: Side, start: np.ndarray):
        small = np.minimum(side.nt, side.nq) + 1
        self.seed = np.arange(len(start))
        self.rows = np.minimum(side.nt + 1, small + side.band)
        self.cols = np.minimum(side.nq + 1, small + side.band)
        self.q, self.t, self.qb, self.tb = side.q, side.t, side.qb, side.tb
        self.start, self.best = start, start.copy()
        self.best_row, self.best_at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)

    def keep(self, alive: np.ndarray) -> None:
        for name in ("seed", "rows", "cols", "start", "best", "best_row", "best_at"):
            setattr(self, name, getattr(self, name)[alive])
        for name in ("q", "t", "qb", "tb"):
            setattr(self, name, getattr(self, name)[:, alive])


def extend_side(side: Side, start: np.ndarray, cfg, with_trace: bool = True):
    """Best score and cell (row, col) of every seed, and the traceback grid.

    Rows are computed in band coordinates: column j of row i is at j - i + band + 1.
    """
    n, b = len(start), side.band
    width = 2 * b + 2
    gap_open, gap_ext = cfg.align_gap_open_penalty, cfg.align_gap_ext_penalty
    rate, max_drop = cfg.align_max_drop_off_rate, cfg.align_max_drop_off_bases
    best, best_row, best_at = start.copy(), np.zeros(n, np.int64), np.full(n, b + 1, np.int64)
    g = _Grid(side, start.astype(float))
    trace = np.zeros((int(g.rows.max(initial=1)), width, n), dtype=np.uint8) if with_trace else None

    steps = np.arange(1, b + 2)
    edge = g.start[None, :] + gap_open + steps[:, None] * gap_ext
    edge_drop = np.cumsum(edge < g.start * rate, axis=0)
    prev = np.full((width + 1, n), -np.inf)
    prev_gap, prev_drop = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int64)
    prev[b + 1], prev_gap[b + 1] = g.start, g.start + gap_ext + gap_open
    inside = steps[:b, None] < g.cols[None, :]
    prev[b + 2: width] = np.where(inside, edge[:b], -np.inf)
    prev_gap[b + 2: width], prev_drop[b + 2: width] = prev[b + 2: width] + gap_ext, edge_drop[:b]
    if with_trace:
        trace[0, b + 2: width] = LEFT
    alive = g.rows > 1
    i = 0
    while True:
        i += 1
        alive &= (i < g.rows) & (g.cols > 1)
        count = int(alive.sum())
        if count < 0.6 * len(alive) or not count:
            best[g.seed], best_row[g.seed], best_at[g.seed] = g.best, g.best_row, np.where(
                g.best_row == 0, b + 1, g.best_at)
            if not count:
                break
            g.keep(alive)
            prev, prev_gap, prev_drop = prev[:, alive], prev_gap[:, alive], prev_drop[:, alive]
            edge, edge_drop, alive = edge[:, alive], edge_drop[:, alive], alive[alive]
        m = len(g.seed)
        # scores of the whole row at once
        pair = pair_scores(g.q[i: i + width], g.t[i - 1][None, :], cfg) if i + width <= len(g.q) else pair_scores(
            _grown(g.q, i, width), g.t[i - 1][None, :], cfg)
        if cfg.align_score_seq:
            letters = g.qb[i: i + width] if i + width <= len(g.qb) else _grown(g.qb, i, width)
            pair = pair + np.where(letters == g.tb[i - 1][None, :], cfg.align_seq_match_score,
                                   cfg.align_seq_mismatch_score)
        diag, up = prev[:width] + pair, prev_gap[1:]
        from_diag = diag >= up
        stem = np.maximum(diag, up)
        stem_drop = np.where(from_diag, prev_drop[:width], prev_drop[1:])
        stem_cost = np.where(from_diag, gap_open + gap_ext, gap_ext)
        column = i - b - 1 + np.arange(width)
        within = (column[:, None] >= 1) & (column[:, None] < g.cols[None, :]) & alive[None, :]
        cur, cur_gap = np.full((width + 1, m), -np.inf), np.full((width + 1, m), -np.inf)
        cur_drop = np.zeros((width + 1, m), np.int64)
        moves = np.where(from_diag, DIAGONAL, UP).astype(np.uint8)
        positive = np.zeros(m, dtype=bool)

        def settle(o: int, score: np.ndarray, parent: np.ndarray, on: np.ndarray, from_left) -> None:
            """A new best (ties go to the later cell), or one more base below the drop-off limit."""
            better = on & (score >= g.best)
            low = on & (score > 0) & (score < g.best * rate) & ~better
            drop = np.where(low, parent + 1, 0)
            out = drop > max_drop
            np.copyto(g.best, score, where=better)
            g.best_row[better], g.best_at[better] = i, o
            kept = np.where(on & ~out, score, -np.inf)
            cur[o], cur_drop[o] = kept, np.where(out, 0, drop)
            cur_gap[o] = kept + (gap_ext if from_left is None else np.where(from_left, gap_ext, stem_cost[o]))

        first = 1
        if i <= b + 1:  # the border cell of column 0
            first = b + 2 - i
            o = b + 1 - i
            cur[o], cur_gap[o], cur_drop[o] = edge[i - 1], edge[i - 1] + gap_ext, edge_drop[i - 1]
            moves[o] = UP
        else:  # the cell left of the band comes from above only
            moves[0] = UP
            settle(0, up[0], prev_drop[1], within[0], None)
        for o in range(first, width):
            on = within[o]
            if o == width - 1:  # the cell right of the band: only in rows that stay alive, never from above
                alive &= positive
                on = on & alive
                stem[o], stem_drop[o], stem_cost[o] = diag[o], prev_drop[o], gap_open + gap_ext
                from_diag[o], moves[o] = True, DIAGONAL
            left = cur_gap[o - 1]
            from_left = np.where(from_diag[o], left > stem[o], left >= stem[o])
            score = np.maximum(left, stem[o])
            if o < width - 1:
                positive |= on & (score > 0)
            np.copyto(moves[o], LEFT, where=from_left)
            settle(o, score, np.where(from_left, cur_drop[o - 1], stem_drop[o]), on, from_left)
        if with_trace:
            trace[i][:, g.seed] = moves
        prev, prev_gap, prev_drop = cur, cur_gap, cur_drop
    return best, best_row, best_row + best_at - b - 1, trace


def _grown(rows: np.ndarray, at: int, width: int) -> np.ndarray:
    """A row window that runs past the end, filled with missing."""
    out = np.full((width, rows.shape[1]), np.nan if rows.dtype == np.float64 else 0, dtype=rows.dtype)
    part = rows[at: at + width]
    out[: len(part)] = part
    return out


def walk_back(trace: np.ndarray, band: int, row: np.ndarray, col: np.ndarray) -> list[tuple[str, str]]:
    """Query and target paths outward from the seed edge; 'x' is a base, '-' a gap."""
    row, col, at = row.copy(), col.copy(), np.arange(len(row))
    query, target = [], []
    length = np.zeros(len(row), dtype=np.int64)
    while True:
        on = (row > 0) | (col > 0)
        if not on.any():
            break
        move = trace[row, np.where(on, col - row + band + 1, 0), at]
        query.append(np.where(move == UP, ord("-"), ord("x")).astype(np.uint8))
        target.append(np.where(move == LEFT, ord("-"), ord("x")).astype(np.uint8))
        length += on
        row = np.where(on & (move != LEFT), row - 1, row)
        col = np.where(on & (move != UP), col - 1, col)
    if not query:
        return [("x", "x")] * len(row)
    q, t = np.stack(query, 1), np.stack(target, 1)
    return [("x" + q[k, :m][::-1].tobytes().decode(), "x" + t[k, :m][::-1].tobytes().decode())
            for k, m in enumerate(length)]


def _clip(x: int, lo: int, hi: int) -> int:
    return max(lo, min(x, hi))


class _Seed:
    """Slices of one seed, with the query side limited to its trimmed range."""

    def __init__(self, row: dict, tolerance: float):
        q, t, off = row["q_values"], row["t_values"], row["t_from"]
        qb, tb = row["q_bases"], row["t_bases"]
        lo, hi = row["trim_start"], row["trim_end"]
        q0, q1 = max(row["q_start"], lo), min(row["q_end"], hi - 1)
        d0, d1, n = row["d_start"], row["d_end"], row["target_len"]
        up, down = min(q0 - lo, d0), min(hi - 1 - q1, n - 1 - d1)
        up, down = (x + int(np.floor(x * tolerance + 0.5)) for x in (up, down))
        qa, qz = _clip(q0 - up, lo, hi), _clip(q0, lo, hi)
        ta, tz = max(d0 - up, 0), d0
        self.up = (q[qa:qz][::-1], t[ta - off:tz - off][::-1], qb[qa:qz][::-1], tb[ta - off:tz - off][::-1])
        self.up_from = (qz, tz)
        qa, qz = _clip(q1 + 1, lo, hi), _clip(q1 + 1 + down, lo, hi)
        ta, tz = min(d1 + 1, n), min(d1 + 1 + down, n)
        self.down = (q[qa:qz], t[ta - off:tz - off], qb[qa:qz], tb[ta - off:tz - off])
        self.down_from = (q1, d1)
        self.length = d1 - d0 + 1


def _groups(parts, cfg, with_path: bool) -> list[tuple[int, np.ndarray]]:
    """(band, seed numbers) of seeds with one band and similar size, bounded in memory."""
    sizes = np.array([(len(p[0]), len(p[1])) for p in parts])
    bands = np.array([band_of(q, t, cfg.align_len_tolerance) for q, t in sizes])
    order = np.lexsort((sizes.max(axis=1), bands))
    out, held = [], []
    for at in order:
        band, size = int(bands[at]), int(sizes[at].max()) + 1
        bytes_each = (2 * band + 2) * (size if with_path else 64)
        if held and (band != bands[held[0]] or (len(held) + 1) * bytes_each > GRID_BYTES
                     or size > 2 * (sizes[held[0]].max() + 16)):
            out.append((int(bands[held[0]]), np.array(held)))
            held = []
        held.append(at)
    if held:
        out.append((int(bands[held[0]]), np.array(held)))
    return out


def extend_direction(parts, start: np.ndarray, with_path: bool, cfg):
    """Best score, row, column and paths of every seed in one direction."""
    n = len(parts)
    best, row, col = start.astype(float), np.zeros(n, np.int64), np.zeros(n, np.int64)
    paths = [("x", "x")] * n
    for band, group in _groups(parts, cfg, with_path):
        some = group[[len(parts[k][0]) > 0 and len(parts[k][1]) > 0 for k in group]]
        if not len(some):
            continue
        best[some], row[some], col[some], trace = extend_side(Side([parts[k] for k in some], band), start[some], cfg,
                                                              with_path)
        if with_path:
            for k, found in zip(some, walk_back(trace, band, row[some], col[some])):
                paths[k] = found
    return best, row, col, paths


def extend_batch(seeds: list[_Seed], scores: np.ndarray, with_path: bool, cfg):
    """Upstream first; downstream continues from the upstream score."""
    up, up_row, up_col, up_path = extend_direction([s.up for s in seeds], scores, with_path, cfg)
    best, row, col, path = extend_direction([s.down for s in seeds], up, with_path, cfg)
    q0 = np.array([s.up_from[0] for s in seeds]) - up_col
    d0 = np.array([s.up_from[1] for s in seeds]) - up_row
    q1 = np.array([s.down_from[0] for s in seeds]) + col
    d1 = np.array([s.down_from[1] for s in seeds]) + row
    paths = [[None] * len(seeds)] * 2
    if with_path:
        paths = [[a[side][::-1] + "x" * (s.length - 1) + z[side][1:] for a, z, s in zip(up_path, path, seeds)]
                 for side in (0, 1)]
        check_paths(q0, q1, d0, d1, *paths)
    return best, q0, q1, d0, d1, paths[0], paths[1]


def check_paths(q0, q1, d0, d1, q_paths: list[str], t_paths: list[str]) -> None:
    """Fail unless both paths of every alignment are equally long and take as many values as their ranges have."""
    for at, (query, target) in enumerate(zip(q_paths, t_paths)):
        spans = query.count("x"), target.count("x")
        if len(query) != len(target) or spans != (q1[at] - q0[at] + 1, d1[at] - d0[at] + 1) or any(
                a == b == "-" for a, b in zip(query, target)):
            raise ValueError(f"broken alignment of query {q0[at]}-{q1[at]} and target {d0[at]}-{d1[at]}: {query} {target}")


def _rows(batch: pa.RecordBatch) -> list[dict]:
    """Rows with values as numpy slices (NaN for missing) and bases as bytes."""
    small = ["q_start", "q_end", "d_start", "d_end", "t_from", "target_len", "trim_start", "trim_end"]
    columns = {name: batch.column(name).to_numpy() for name in small}
    wide = {}
    for name in ("q_values", "t_values"):
        lists = batch.column(name)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        wide[name] = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    for name in ("q_bases", "t_bases"):
        wide[name] = [np.frombuffer(s.encode(), dtype=np.uint8) for s in batch.column(name).to_pylist()]
    return [{**{c: int(v[i]) for c, v in columns.items()}, **{c: v[i] for c, v in wide.items()}}
            for i in range(batch.num_rows)]


def extend_seeds(seeds: DataFrame, cfg, with_path: bool = True) -> DataFrame:
    """Extend every seed; `raw_score` becomes `score` by the length rule."""

    def run(batches):
        for batch in sliced(batches):
            rows = [_Seed(row, cfg.align_len_tolerance) for row in _rows(batch)]
            scores = batch.column("seed_score").to_numpy()
            if not rows:
                continue
            score, q0, q1, d0, d1, q_path, t_path = extend_batch(rows, scores, with_path, cfg)
            keep = {c: batch.column(c) for c in ("query_id", "target_id", "target_ord")}
            seed = {"q_seed_start": "q_start", "q_seed_end": "q_end", "d_seed_start": "d_start", "d_seed_end": "d_end"}
            keep.update({new: batch.column(old) for new, old in seed.items()})
            trim = batch.column("trim_end").to_numpy() - batch.column("trim_start").to_numpy()
            yield pa.RecordBatch.from_pydict({
                **keep, "n_kmers": batch.column("n_kmers"), "seed_score": batch.column("seed_score"),
                "raw_score": pa.array(score, pa.float64()), "q_start": pa.array(q0, pa.int64()),
                "q_end": pa.array(q1, pa.int64()), "d_start": pa.array(d0, pa.int64()),
                "d_end": pa.array(d1, pa.int64()), "trim_len": pa.array(trim),
                "target_len": batch.column("target_len"),
                "q_path": pa.array(q_path, pa.string()), "t_path": pa.array(t_path, pa.string())})

    needed = ["query_id", "target_id", "target_ord", "q_start", "q_end", "d_start", "d_end", "n_kmers", "seed_score",
              "q_values", "q_bases", "trim_start", "trim_end", "target_len", "t_from", "t_bases", "t_values"]
    hits = seeds.select(*needed).mapInArrow(run, HIT_COLUMNS)
    aligned = (F.col("q_end") - F.col("q_start") + 1).cast("double")
    ratio = F.ln(aligned) / nullif(F.ln(F.col("trim_len").cast("double")), 0.0)
    # single precision, as scores are compared for ties
    return hits.withColumn("score", (F.col("raw_score") * ratio).cast("float").cast("double"))
