"""Slow, cell-by-cell versions of the operators, to test against."""

import math

import numpy as np

D, L, U = 0, 1, 2


def pair(q, t, cfg):
    (m0, m1), (x0, x1) = cfg.align_match_score, cfg.align_mismatch_score
    if q is None or t is None or q != q or t != t:
        return m0
    if q > 1 and t > 1:
        return 0.0
    d = abs(q - t)
    if d < 0.5:
        return (0.5 - d) * ((m1 - m0) / 0.5) + m0
    return (cfg.max_reactivity - d) * ((x1 - x0) / (cfg.max_reactivity - 0.5)) + x0


def half_up(x):
    return int(math.floor(x + 0.5))


def extend(q, t, qb, tb, start, cfg):
    """Best score and path of one direction."""
    if not len(q) or not len(t):
        return start, 0, 0, "x", "x"
    rows, cols = len(t) + 1, len(q) + 1
    small = min(rows, cols)
    band = max(half_up(small * cfg.align_len_tolerance), 10)
    nr, nc = min(rows, small + band), min(cols, small + band)
    score, tb_, drop = {(0, 0): start}, {(0, 0): D}, {(0, 0): 0}
    o, e, rate = cfg.align_gap_open_penalty, cfg.align_gap_ext_penalty, cfg.align_max_drop_off_rate
    below = 0
    for i in range(1, band + 2):
        s = start + o + i * e
        below += s < start * rate
        if i < nc:
            score[0, i], tb_[0, i], drop[0, i] = s, L, below
        if i < nr:
            score[i, 0], tb_[i, 0], drop[i, 0] = s, U, below
    best, cell = start, (0, 0)

    def gap(c):
        return score[c] + e + (o if tb_[c] == D else 0.0)

    def settle(c, s, move, parent):
        nonlocal best, cell
        score[c], tb_[c], drop[c] = s, move, 0
        if s >= best:
            best, cell = s, c
        elif 0 < s < best * rate:
            if drop[parent] + 1 > cfg.align_max_drop_off_bases:
                score[c] = -math.inf
            else:
                drop[c] = drop[parent] + 1

    for i in range(1, nr):
        lo, hi = max(1, i - band), min(i + band, nc)
        if lo > 1:
            settle((i, lo - 1), gap((i - 1, lo - 1)), U, (i - 1, lo - 1))
        alive = False
        for j in range(lo, hi):
            step = pair(q[j - 1], t[i - 1], cfg)
            if cfg.align_score_seq:
                step += cfg.align_seq_match_score if qb[j - 1] == tb[i - 1] else cfg.align_seq_mismatch_score
            d, left, up = score[i - 1, j - 1] + step, gap((i, j - 1)), gap((i - 1, j))
            if d >= left and d >= up:
                choice = (d, D, (i - 1, j - 1))
            elif left >= up:
                choice = (left, L, (i, j - 1))
            else:
                choice = (up, U, (i - 1, j))
            alive |= choice[0] > 0
            settle((i, j), *choice)
        if not alive:
            break
        if hi < cols:
            step = pair(q[hi - 1], t[i - 1], cfg)
            if cfg.align_score_seq:
                step += cfg.align_seq_match_score if qb[hi - 1] == tb[i - 1] else cfg.align_seq_mismatch_score
            d, left = score[i - 1, hi - 1] + step, gap((i, hi - 1))
            choice = (d, D, (i - 1, hi - 1)) if d >= left else (left, L, (i, hi - 1))
            settle((i, hi), *choice)
    r, c = cell
    qp, tp = "", ""
    while r or c:
        move = tb_[r, c]
        qp, tp = ("-" if move == U else "x") + qp, ("-" if move == L else "x") + tp
        r, c = r - (move != L), c - (move != U)
    return best, cell[0], cell[1], "x" + qp, "x" + tp


def hits(query, target, cfg):
    """Window hits of one capped query and target (None for missing), without base filters."""
    k = cfg.kmer_len
    present = [i for i, x in enumerate(query) if x is not None]
    lo, hi = (present[0], present[-1] + 1) if present else (0, len(query))
    filled = np.array([-999.0 if x is None else x for x in target])
    out = []
    for i in range(0, len(query) - k + 1, cfg.kmer_offset):
        w = query[i:i + k]
        if i < lo or i > max(hi - k, 0) or any(x is None for x in w):
            continue
        w = np.array(w)
        diffs = sum(abs(a - b) for n, a in enumerate(w) for b in w[n + 1:])
        if w.sum() == 0 or diffs / (k * w.sum()) < cfg.kmer_min_complexity:
            continue
        dist = []
        for j in range(len(filled) - k + 1):
            x = filled[j:j + k]
            if x.std() == 0 or w.std() == 0:
                dist.append(math.nan)
                continue
            dist.append(math.sqrt(abs(2 * (k - (x @ w - k * x.mean() * w.mean()) / (x.std() * w.std())))))
        dist = np.array(dist)
        fine = dist[np.isfinite(dist)]
        if len(fine) < 2:
            continue
        found = np.flatnonzero(dist <= fine.mean() - 3 * fine.std(ddof=1))
        if len(found) and len(target) // len(found) >= min(cfg.kmer_max_match_every_nt, len(target)):
            out += [(i, int(j)) for j in found]
    return out


def groups(found, cfg):
    """Inclusive (q_start, q_end, d_start, d_end, n) per diagonal run."""
    lines = {}
    for q, d in found:
        lines.setdefault(q - d, []).append(q)
    out = []
    for diag, qs in lines.items():
        qs.sort()
        run = [qs[0]]
        for q in qs[1:] + [None]:
            if q is None or q > run[-1] + cfg.max_kmer_dist + cfg.kmer_len:
                if len(run) >= cfg.min_kmers:
                    a, z = run[0], run[-1] + cfg.kmer_len - 1
                    out.append((a, z, a - diag, z - diag, len(run)))
                run = []
            run.append(q)
    return sorted(out)


def survivors(rows, fraction):
    """Indexes left by the overlap rule; rows are (target, q0, q1, d0, d1, score)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], -rows[i][2], rows[i][3], -rows[i][4]))

    def over(a0, a1, b0, b1):
        return b0 < a1 and max(min(a1, b1) + 1 - max(a0, b0), 0) > min(a1 + 1 - a0, b1 + 1 - b0) * fraction

    lost = set()
    for at, i in enumerate(order):
        a = rows[i]
        for j in order[at + 1:]:
            b = rows[j]
            if b[0] != a[0] or not over(a[1], a[2], b[1], b[2]):
                break
            if over(a[3], a[4], b[3], b[4]):
                lost.add(j if a[5] >= b[5] else i)
    return set(range(len(rows))) - lost
