"""DuckDB SQL of the gapped extension: one recursion step per row of the band, one per step of the way back."""

from __future__ import annotations

NONE = "{'s': '-infinity'::DOUBLE, 'g': '-infinity'::DOUBLE, 'd': 0}"
RATE, MAX_DROP = 0.8, 8


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def side(name: str, seeds: str, slices: str, start: str, opened: float, extended: float, pair) -> dict[str, str]:
    """Table expressions that end in `{name}_way`: score, row, column and both ways of every seed's side.

    `seeds` numbers seeds by `sid`; `slices` gives qv and tv, the values outward from the seed. The list `cells` holds
    a row of the band: s is the score of a cell, g the score of a gap that leaves it, d its bases below the drop-off.
    """
    edge = f"(start + {opened} + k * {extended})"
    # the border has a gap of k bases from the seed; d counts how many of its cells are below the drop-off
    border = (f"{{'s': {edge}, 'g': {edge} + {extended}, "
              f"'d': len(list_filter(range(1, k + 1), lambda x: start + {opened} + x * {extended} < start * {RATE}))}}")
    made = {f"{name}_in": f"""SELECT *, CAST(least(nt, small + b) AS BIGINT) AS nr, CAST(least(nq, small + b) AS BIGINT) AS nc
 FROM (SELECT *, least(nt, nq) AS small, CAST(greatest(floor(least(nt, nq) * 0.1::DOUBLE + 0.5::DOUBLE), 10) AS BIGINT) AS b
 FROM (SELECT sid, {start} AS start, qv, tv, len(qv) + 1 AS nq, len(tv) + 1 AS nt FROM ({slices}) x) WHERE nq > 1 AND nt > 1)"""}
    first = border.replace("k", "(o - b - 1)").replace("'(o - b - 1)'", "'k'")
    top = (f"list_transform(range(0, 2 * b + 2), lambda o: CASE WHEN o = b + 1 THEN {{'s': start, 'g': start + {opened + extended}, "
           f"'d': 0}} WHEN o > b + 1 AND o - b - 1 < nc THEN {first} ELSE {NONE} END)")
    side_border = border.replace("k", "w.i").replace("'w.i'", "'k'")
    # what each cell of row i would be without its left neighbour; kinds: 0 outside, 1 border, 2 left of the band, 3 inside, 4 right of it
    t = "w.tv[w.i]"
    cand = f"""list_transform(range(0, 2 * w.b + 2), lambda o: {{'j': w.i - w.b - 1 + o,
 'kind': CASE WHEN w.i - w.b - 1 + o < 0 OR w.i - w.b - 1 + o >= w.nc THEN 0 WHEN w.i - w.b - 1 + o = 0 THEN 1 WHEN o = 0 THEN 2
 WHEN o <= 2 * w.b THEN 3 ELSE 4 END,
 'dg': w.cells[o + 1].s + {pair('w.qv[w.i - w.b - 1 + o]', t)}, 'up': coalesce(w.cells[o + 2].g, '-infinity'::DOUBLE),
 'dd': w.cells[o + 1].d, 'du': coalesce(w.cells[o + 2].d, 0)}})"""
    flow = f"""list_transform({cand}, lambda c: CASE WHEN c.kind = 2 OR (c.kind = 3 AND c.up > c.dg)
 THEN {{'j': c.j, 'kind': c.kind, 's': c.up, 'd': c.du, 'm': 'U', 'cost': {extended}::DOUBLE}}
 ELSE {{'j': c.j, 'kind': c.kind, 's': c.dg, 'd': c.dd, 'm': 'D', 'cost': {opened + extended}::DOUBLE}} END)"""
    # the chosen step of a cell, then whether it is a new best or falls below the drop-off
    chosen = f"""CASE WHEN c.kind >= 3 AND (a.g > c.s OR (c.m = 'U' AND a.g >= c.s))
 THEN {{'s': a.g, 'd': a.d, 'm': 'L', 'cost': {extended}::DOUBLE}} ELSE {{'s': c.s, 'd': c.d, 'm': c.m, 'cost': c.cost}} END"""
    low = f"x.s > 0 AND x.s < a.best * {RATE} AND x.s < a.best"
    gone = f"({low} AND x.d + 1 > {MAX_DROP})"
    cell = (f"CASE WHEN {gone} THEN {NONE} ELSE {{'s': x.s, 'g': x.s + x.cost, 'd': CASE WHEN {low} THEN x.d + 1 ELSE 0 END}} END")
    better = "x.s >= a.best"

    def state(y: str, move: str, best: str, at_i: str, at_j: str, alive: str) -> str:
        return (f"{{'cells': list_append(a.cells, {y}), 'g': {y}.g, 'd': {y}.d, 'best': {best}, 'bi': {at_i}, 'bj': {at_j}, "
                f"'alive': {alive}, 'moves': a.moves || {move}}}")

    def same(y: str, move: str) -> str:
        return state(y, move, "a.best", "a.bi", "a.bj", "a.alive")

    settled = _let(cell, "y", state("y", "x.m", f"CASE WHEN {better} THEN x.s ELSE a.best END", f"CASE WHEN {better} THEN w.i ELSE a.bi END",
                                    f"CASE WHEN {better} THEN c.j ELSE a.bj END", "a.alive OR (c.kind = 3 AND x.s > 0)"))
    step = f"""list_reduce({flow}, lambda a, c: CASE WHEN c.kind = 0 OR (c.kind = 4 AND NOT a.alive)
 THEN {_let(NONE, 'y', same('y', "'-'"))} WHEN c.kind = 1 THEN {_let(side_border, 'y', same('y', "'U'"))}
 ELSE {_let(chosen, 'x', settled)} END,
 {{'cells': []::STRUCT(s DOUBLE, g DOUBLE, d BIGINT)[], 'g': '-infinity'::DOUBLE, 'd': 0::BIGINT, 'best': w.best, 'bi': w.bi, 'bj': w.bj,
 'alive': false, 'moves': ''}})"""
    made[f"{name}_band"] = f"""SELECT sid, 0::BIGINT AS i, {top}::STRUCT(s DOUBLE, g DOUBLE, d BIGINT)[] AS cells,
 start::DOUBLE AS best, 0::BIGINT AS bi, 0::BIGINT AS bj, true AS alive, repeat('L', CAST(2 * b + 2 AS INT)) AS moves FROM {name}_in
 UNION ALL SELECT sid, i, n.cells, n.best, n.bi, n.bj, n.alive, n.moves FROM (SELECT w.sid, w.i, {step} AS n FROM (
 SELECT v.sid, v.i + 1 AS i, v.cells, v.best, v.bi, v.bj, m.start, m.qv, m.tv, m.b, m.nc FROM {name}_band v JOIN {name}_in m ON m.sid = v.sid
 WHERE v.alive AND v.i + 1 < m.nr) w)"""
    made[f"{name}_end"] = f"""SELECT e.*, m.b FROM (SELECT sid, arg_max(best, i) AS best, arg_max(bi, i) AS bi, arg_max(bj, i) AS bj,
 list(moves ORDER BY i) AS moves FROM {name}_band GROUP BY sid) e JOIN {name}_in m ON m.sid = e.sid"""
    made[f"{name}_back"] = f"""SELECT sid, bi AS i, bj AS j, '' AS qp, '' AS tp FROM {name}_end
 UNION ALL SELECT sid, CASE WHEN m = 'L' THEN i ELSE i - 1 END, CASE WHEN m = 'U' THEN j ELSE j - 1 END,
 qp || CASE WHEN m = 'U' THEN '-' ELSE 'x' END, tp || CASE WHEN m = 'L' THEN '-' ELSE 'x' END FROM (
 SELECT v.sid, v.i, v.j, v.qp, v.tp, substr(e.moves[v.i + 1], v.j - v.i + e.b + 2, 1) AS m FROM {name}_back v JOIN {name}_end e ON e.sid = v.sid
 WHERE v.i > 0 OR v.j > 0)"""
    made[f"{name}_way"] = f"""SELECT s.*, coalesce(e.best, {start}) AS {name}_score, coalesce(e.bi, 0) AS {name}_i, coalesce(e.bj, 0) AS {name}_j,
 coalesce(r.qp, '') AS {name}_q, coalesce(r.tp, '') AS {name}_t FROM {seeds} s LEFT JOIN {name}_end e ON e.sid = s.sid
 LEFT JOIN (SELECT sid, qp, tp FROM {name}_back WHERE i = 0 AND j = 0) r ON r.sid = s.sid"""
    return made


def extension(seeds: str, opened: float, extended: float, reach, pair) -> dict[str, str]:
    """Table expressions that end in `gapped`: every seed extended to both sides."""
    made = {"qcap": "SELECT id, list(c ORDER BY pos) AS v FROM q GROUP BY id",
            "pcap": "SELECT id, list(c ORDER BY pos) AS v FROM p GROUP BY id"}
    made["numbered_seed"] = f"""SELECT *, row_number() OVER (ORDER BY query_id, target_id, q_start, d_start) AS sid, {reach('up0')} AS up_most,
 {reach('down0')} AS down_most FROM {seeds}"""
    up = """SELECT s.sid, s.seed_score, list_reverse(k.v[s.q_start - least(s.up_most, s.q_start - s.a) + 1:s.q_start]) AS qv,
 list_reverse(t.v[s.d_start - least(s.up_most, s.d_start) + 1:s.d_start]) AS tv
 FROM numbered_seed s JOIN qcap k ON k.id = s.query_id JOIN pcap t ON t.id = s.target_id"""
    made |= side("gup", "numbered_seed", up, "round(seed_score, 6)", opened, extended, pair)
    down = """SELECT s.sid, s.gup_score, k.v[s.q_end + 2:s.q_end + 1 + least(s.down_most, s.z - 1 - s.q_end)] AS qv,
 t.v[s.d_end + 2:s.d_end + 1 + least(s.down_most, s.target_len - 1 - s.d_end)] AS tv
 FROM gup_way s JOIN qcap k ON k.id = s.query_id JOIN pcap t ON t.id = s.target_id"""
    made |= side("gdown", "gup_way", down, "gup_score", opened, extended, pair)
    middle = "repeat('x', CAST(q_end - q_start + 1 AS INT))"
    made["gapped"] = f"""SELECT query_id, target_id, q_start AS q_seed_start, q_end AS q_seed_end, d_start AS d_seed_start, d_end AS d_seed_end,
 seed_score, target_len, q_start - gup_j AS q_start, q_end + gdown_j AS q_end, d_start - gup_i AS d_start, d_end + gdown_i AS d_end,
 gdown_score AS raw_score, CAST(CAST(gdown_score * (ln(q_end + gdown_j - (q_start - gup_j) + 1) / ln(z - a)) AS FLOAT) AS DOUBLE) AS score,
 gup_q || {middle} || reverse(gdown_q) AS q_path, gup_t || {middle} || reverse(gdown_t) AS t_path FROM gdown_way"""
    return made
