"""DuckDB SQL for the registered queries, built from shared table expressions."""

from __future__ import annotations

import re

from catalog import gapped_sql

K, GAP, SEED = 8, 28, 42


def num(text: str) -> str:
    """48-bit number of a digest, as in the Spark expression."""
    return f"(('0x' || md5({text})[1:12])::BIGINT)"


# --- profiles ---------------------------------------------------------------

CTES: dict[str, str] = {}
CTES["event"] = """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at_user FROM events"""
CTES["p"] = """SELECT CAST(user_id AS VARCHAR) AS id, at_user AS pos,
 CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END AS base,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE value / 100.0 END AS r,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE least(value / 100.0, 1.0) END AS c,
 count(*) OVER (PARTITION BY user_id) AS n FROM event"""
CTES["opened"] = """SELECT event_type, slot, CAST((total % 15013 + 15013) % 15013 AS DOUBLE) / 100.07::DOUBLE AS value FROM (SELECT event_type,
 epoch_us(ts) // 21600000000 AS slot, sum(CAST(floor(value * 100.0::DOUBLE) AS BIGINT)) AS total FROM events GROUP BY 1, 2)"""
CTES["grid"] = """SELECT t.event_type, u.slot, s.lo FROM (SELECT min(slot) AS lo, max(slot) AS hi FROM opened) s,
 (SELECT DISTINCT event_type FROM opened) t, unnest(range(s.lo, s.hi + 1)) AS u(slot)"""
CTES["q"] = """SELECT g.event_type AS id, g.slot - g.lo AS pos, substr('ACGT', CAST(g.slot % 4 + 1 AS INT), 1) AS base,
 o.value / 100.0 AS r, CASE WHEN o.value IS NULL THEN NULL ELSE least(o.value / 100.0, 1.0) END AS c,
 count(*) OVER (PARTITION BY g.event_type) AS n
 FROM grid g LEFT JOIN opened o ON g.event_type = o.event_type AND g.slot = o.slot"""
for side in "pq":
    CTES[f"{side}trim"] = f"""SELECT id, coalesce(min(pos) FILTER (WHERE r IS NOT NULL), 0) AS a,
 coalesce(max(pos) FILTER (WHERE r IS NOT NULL) + 1, count(*)) AS z, count(*) AS n FROM {side} GROUP BY id"""
    CTES[f"{side}wide"] = f"""SELECT id, count(*) AS n, list(r ORDER BY pos) AS v, string_agg(base, '' ORDER BY pos) AS b
 FROM {side} GROUP BY id"""
    CTES[f"{side}win"] = f"""SELECT id, pos, n, list(c) OVER f AS v, list(r) OVER f AS raw, string_agg(base, '') OVER f AS wb,
 count(*) OVER f AS k, count(*) FILTER (WHERE r IS NULL) OVER f AS miss, list(coalesce(c, -999.0)) OVER f AS filled FROM {side}
 WINDOW f AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING)"""
    CTES[f"{side}in"] = f"""SELECT w.* FROM {side}win w JOIN {side}trim t ON w.id = t.id
 WHERE w.k = {K} AND w.pos >= t.a AND w.pos <= greatest(t.z - {K}, 0)"""
GINI = f"""list_sum(list_transform(list_sort(v), lambda x, i: x * (2 * i - {K + 1}))) / nullif({K} * list_sum(v), 0)"""
CTES["kmer"] = f"""SELECT id, pos, wb, n, list_transform(v, lambda x: (x - list_avg(v)) / list_aggregate(v, 'stddev_pop')) AS z
 FROM qin WHERE miss = 0 AND {GINI} >= 0.2 AND list_aggregate(v, 'stddev_pop') > 0"""
CTES["dwin"] = f"""SELECT id, pos, wb, n, list_transform(filled, lambda x: (x - list_avg(filled)) / list_aggregate(filled, 'stddev_pop')) AS z
 FROM pwin WHERE k = {K} AND list_aggregate(filled, 'stddev_pop') > 0"""

# --- distance join ------------------------------------------------------------

CTES["dist"] = f"""SELECT k.id AS query_id, k.pos AS q_pos, k.wb AS q_wb, d.id AS target_id, d.pos AS d_pos, d.wb AS d_wb, d.n AS target_len,
 sqrt(abs({2 * K}.0 - 2.0 * list_inner_product(k.z, d.z))) AS dist FROM kmer k, dwin d"""
CTES["stat"] = """SELECT query_id, q_pos, target_id, count(*) AS n, avg(dist) AS m, stddev_samp(dist) AS sd,
 avg(dist) - 3.0 * stddev_samp(dist) AS lim FROM dist GROUP BY ALL"""
CTES["near"] = """SELECT d.*, count(*) OVER (PARTITION BY d.query_id, d.q_pos, d.target_id) AS n_hits
 FROM dist d JOIN stat s ON d.query_id = s.query_id AND d.q_pos = s.q_pos AND d.target_id = s.target_id WHERE d.dist <= s.lim"""
CTES["hit"] = "SELECT * FROM near WHERE target_len // n_hits >= least(5, target_len)"
CTES["isle"] = f"""SELECT query_id, target_id, q_pos - d_pos AS diag, q_pos,
 sum(fresh) OVER (PARTITION BY query_id, target_id, q_pos - d_pos ORDER BY q_pos) AS grp FROM (SELECT *,
 CASE WHEN q_pos - lag(q_pos) OVER (PARTITION BY query_id, target_id, q_pos - d_pos ORDER BY q_pos) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM hit)"""
CTES["groups"] = f"""SELECT query_id, target_id, min(q_pos) AS q_start, max(q_pos) + {K - 1} AS q_end, min(q_pos) - diag AS d_start,
 max(q_pos) - diag + {K - 1} AS d_end, count(*) AS n_kmers FROM isle GROUP BY query_id, target_id, diag, grp"""
CTES["seed"] = "SELECT * FROM groups WHERE n_kmers >= 2"


def pair(q: str, t: str, limit: float = 1.0) -> str:
    slope = 5.5 / (limit - 0.5)
    return (f"CASE WHEN {q} IS NULL OR {t} IS NULL THEN -0.5 WHEN {q} > 1 AND {t} > 1 THEN 0.0 "
            f"WHEN abs({q} - {t}) < 0.5 THEN (0.5 - abs({q} - {t})) * 5.0 - 0.5 "
            f"ELSE ({limit} - abs({q} - {t})) * {slope} - 6.0 END::DOUBLE")


_CELLS = """FROM seed s, unnest(range(s.q_end - s.q_start + 1)) AS u(i)
 JOIN q ON q.id = s.query_id AND q.pos = s.q_start + u.i JOIN p ON p.id = s.target_id AND p.pos = s.d_start + u.i"""
CTES["scored"] = f"""SELECT s.*, x.seed_score FROM seed s JOIN (SELECT s.query_id, s.target_id, s.q_start, s.d_start,
 sum({pair('q.c', 'p.c')}) AS seed_score {_CELLS} GROUP BY 1, 2, 3, 4) x
 ON s.query_id = x.query_id AND s.target_id = x.target_id AND s.q_start = x.q_start AND s.d_start = x.d_start"""
CTES["pos_seed"] = """SELECT s.*, t.a, t.z, d.n AS target_len FROM scored s JOIN qtrim t ON s.query_id = t.id
 JOIN ptrim d ON s.target_id = d.id WHERE seed_score > 0"""
_TOL = """least(q_start - a, d_start) AS up0, least(z - 1 - q_end, target_len - 1 - d_end) AS down0"""


def reach(x: str) -> str:
    return f"CAST({x} + round({x} * 0.1) AS BIGINT)"


CTES["sides"] = f"SELECT *, {_TOL} FROM pos_seed"


def _walk(name: str, seeds: str, start: str, steps: str, q_at: str, d_at: str) -> None:
    """Prefix sums outward from a seed edge, up to the first that is not positive."""
    CTES[f"{name}_sum"] = f"""SELECT s.query_id, s.target_id, s.q_start, s.d_start, u.i, {start} +
 sum({pair('q.c', 'p.c')}) OVER (PARTITION BY s.query_id, s.target_id, s.q_start, s.d_start ORDER BY u.i) AS total
 FROM {seeds} s, unnest(range(1, {steps} + 1)) AS u(i)
 JOIN q ON q.id = s.query_id AND q.pos = {q_at} JOIN p ON p.id = s.target_id AND p.pos = {d_at}"""
    CTES[f"{name}_best"] = f"""SELECT query_id, target_id, q_start, d_start, max(total) AS total, arg_max(i, total) AS i0 FROM (
 SELECT *, max(CASE WHEN total <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, target_id, q_start, d_start ORDER BY i) AS dead
 FROM {name}_sum) WHERE dead = 0 GROUP BY 1, 2, 3, 4"""


_KEY = "query_id, target_id, q_start, d_start"
_walk("up", "sides", "s.seed_score", f"least({reach('s.up0')}, s.q_start - s.a, s.d_start)", "s.q_start - u.i", "s.d_start - u.i")
CTES["upped"] = f"""SELECT s.*, CASE WHEN u.total >= s.seed_score THEN u.total ELSE s.seed_score END AS up_score,
 CASE WHEN u.total >= s.seed_score THEN u.i0 ELSE 0 END AS up_n FROM sides s LEFT JOIN up_best u USING ({_KEY})"""
_walk("down", "upped", "s.up_score", f"least({reach('s.down0')}, s.z - 1 - s.q_end, s.target_len - 1 - s.d_end)", "s.q_end + u.i",
      "s.d_end + u.i")
CTES["ext"] = f"""SELECT query_id, target_id, q_start AS q_seed_start, q_end AS q_seed_end, d_start AS d_seed_start, d_end AS d_seed_end,
 seed_score, q_start - up_n AS q_start, q_end + down_n AS q_end, d_start - up_n AS d_start, d_end + down_n AS d_end, raw_score,
 CAST(CAST(raw_score * (ln(q_end + down_n - (q_start - up_n) + 1) / ln(z - a)) AS FLOAT) AS DOUBLE) AS score FROM (
 SELECT s.*, CASE WHEN u.total >= s.up_score THEN u.total ELSE s.up_score END AS raw_score,
 CASE WHEN u.total >= s.up_score THEN u.i0 ELSE 0 END AS down_n FROM upped s LEFT JOIN down_best u USING ({_KEY}))"""

CTES |= gapped_sql.extension("sides", -2.0, -0.5, reach, pair)

# --- significance -------------------------------------------------------------

CTES["fit"] = """SELECT query_id, n_null, mean - 0.5772156649015329 * scale AS location, scale FROM (SELECT query_id, count(*) AS n_null,
 avg(seed_score) AS mean, coalesce(sqrt(var_samp(seed_score) * 6.0 / (pi() * pi())), 0.0) AS scale FROM pos_seed GROUP BY query_id)"""
CTES["sig"] = """SELECT *, pvalue * n_hits AS evalue FROM (SELECT e.*, CASE WHEN f.scale = 0 THEN CASE WHEN e.score > f.location THEN 0.0
 WHEN e.score < f.location THEN 1.0 END ELSE 1.0 - exp(-exp(-(e.score - f.location) / f.scale)) END AS pvalue,
 count(*) OVER (PARTITION BY e.query_id) AS n_hits FROM ext e JOIN fit f ON e.query_id = f.query_id)"""


def _overlap(axis: str) -> str:
    a0, a1, b0, b1 = (f"{s}.{axis}_{e}" for s in "ab" for e in ("start", "end"))
    return (f"({b0} < {a1} AND greatest(least({a1}, {b1}) + 1 - greatest({a0}, {b0}), 0) > "
            f"least({a1} + 1 - {a0}, {b1} + 1 - {b0}) * 0.5)")


def _survivors(source: str, name: str) -> None:
    CTES[f"{name}_rank"] = f"""SELECT *, row_number() OVER (PARTITION BY query_id, target_id
 ORDER BY q_start, q_end DESC, d_start, d_end DESC, q_seed_start, d_seed_start) AS rn FROM {source}"""
    CTES[f"{name}_pair"] = f"""SELECT a.query_id, a.target_id, a.rn AS a_rn, b.rn AS b_rn, a.score AS a_score, b.score AS b_score,
 {_overlap('q')} AS qov, {_overlap('d')} AS dov FROM {name}_rank a JOIN {name}_rank b
 ON a.query_id = b.query_id AND a.target_id = b.target_id AND a.rn < b.rn"""
    CTES[f"{name}_stop"] = f"""SELECT query_id, target_id, a_rn, min(b_rn) FILTER (WHERE NOT qov) AS stop FROM {name}_pair GROUP BY 1, 2, 3"""
    CTES[f"{name}_lost"] = f"""SELECT DISTINCT p.query_id, p.target_id, CASE WHEN a_score >= b_score THEN b_rn ELSE p.a_rn END AS rn
 FROM {name}_pair p JOIN {name}_stop s USING (query_id, target_id, a_rn) WHERE dov AND qov AND (stop IS NULL OR b_rn < stop)"""
    CTES[f"{name}_kept"] = f"SELECT r.* FROM {name}_rank r ANTI JOIN {name}_lost l USING (query_id, target_id, rn)"


_survivors("sig", "all")
CTES["rep"] = "SELECT * FROM sig WHERE evalue <= 10.0"
_survivors("rep", "rep")
CTES["final"] = """SELECT *, CASE WHEN evalue > 10.0 THEN '' WHEN evalue > 1.0 THEN '?' ELSE '!' END AS status,
 target_id || '_' || d_start || '-' || d_end || '_' || query_id || '_' || q_start || '-' || q_end AS name FROM rep_kept"""
CTES["shown"] = """SELECT f.*, (SELECT string_agg(base, '' ORDER BY pos) FROM q WHERE q.id = f.query_id AND q.pos BETWEEN f.q_start AND f.q_end) AS qb,
 (SELECT string_agg(base, '' ORDER BY pos) FROM p WHERE p.id = f.target_id AND p.pos BETWEEN f.d_start AND f.d_end) AS db
 FROM final f WHERE status = '!'"""

# the same chain for gapped hits
_TAIL = "sig rep rep_rank rep_pair rep_stop rep_lost rep_kept final shown".split()
for _name in _TAIL:
    CTES[f"gap_{_name}"] = re.sub(r"\b(" + "|".join(_TAIL) + r")\b", r"gap_\1", CTES[_name]).replace("FROM ext e", "FROM gapped e")


def laid(values: str, path: str, gap: str, cell: str) -> str:
    """Cells of a path: `gap` where it has one, else `cell` of the next value x."""
    at = f"{values}[length(replace({path}[1:i], '-', ''))]"
    return (f"list_transform(range(1, length({path}) + 1), lambda i: CASE WHEN {path}[i] = '-' THEN {gap} "
            f"ELSE {cell.replace('@', at)} END)")


def shown_number(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.1 THEN printf('%.3f', {x}) ELSE regexp_replace(printf('%.3e', {x}), "
            "'e\\+?(-?)0*(\\d)', 'e\\1\\2') END")


# --- null database --------------------------------------------------------------

CTES["ord"] = "SELECT id, n, v, b, row_number() OVER (ORDER BY md5(concat_ws(':', id, 0)), id) - 1 AS dense_ord FROM pwide"
CTES["total"] = "SELECT count(*) AS np FROM pwide"
CTES["pick"] = f"""SELECT u.draw, {num(f"concat_ws(':', {SEED}, 'pick', u.draw)")} % t.np AS dense_ord
 FROM total t, unnest(range(2 * t.np)) AS u(draw)"""
CTES["drawn"] = f"""SELECT draw, id, n, v, b, CASE WHEN n % 10 > 0 THEN {num(f"concat_ws(':', {SEED}, 'offset', draw)")} % (n % 10) ELSE 0 END AS off
 FROM pick JOIN ord USING (dense_ord)"""
CTES["cell"] = """SELECT draw, id, u.i AS pos, v[u.i + 1] AS r, b[u.i + 1] AS base, CASE WHEN u.i < off THEN 0
 ELSE CASE WHEN off > 0 THEN 1 ELSE 0 END + (u.i - off) // 10 END AS chunk,
 CASE WHEN u.i < off THEN u.i ELSE (u.i - off) % 10 END AS inner_pos FROM drawn, unnest(range(n)) AS u(i)"""
_BLOCK = num(f"concat_ws(':', {SEED}, 'block', draw, chunk)")
CTES["moved"] = f"""SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {_BLOCK}, chunk, pos) AS spot FROM cell"""
_SHUFFLED = """SELECT id, draw, string_agg(base, '' ORDER BY spot) AS bases, round(sum(coalesce(r, -1.0) * spot), 6) AS checksum
 FROM moved GROUP BY id, draw"""


def _inner(tag: str) -> str:
    return num(f"concat_ws(':', '{SEED}:{tag}', draw, chunk, inner_pos)")


CTES["moved_v"] = f"""SELECT id, draw, r, row_number() OVER (PARTITION BY draw ORDER BY {_BLOCK}, chunk, {_inner('values')}, inner_pos) AS spot FROM cell"""
CTES["moved_b"] = f"""SELECT id, draw, base, row_number() OVER (PARTITION BY draw ORDER BY {_BLOCK}, chunk, {_inner('bases')}, inner_pos) AS spot FROM cell"""

# the search chain once more with the null draws as targets
CTES["null_p"] = """SELECT CAST(draw AS VARCHAR) AS id, spot - 1 AS pos, base, r, CASE WHEN r IS NULL THEN NULL ELSE least(r, 1.0) END AS c,
 count(*) OVER (PARTITION BY draw) AS n FROM moved"""
_CHAIN = ("ptrim pwin dwin dist stat near hit isle groups seed scored pos_seed sides up_sum up_best upped down_sum down_best "
          "ext").split()
_NAMES = re.compile(r"\b(p|" + "|".join(_CHAIN) + r")\b")
for _name in _CHAIN:
    CTES[f"null_{_name}"] = _NAMES.sub(r"null_\1", CTES[_name])
CTES["null_first"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(target_id AS BIGINT),
 q_seed_start - d_seed_start, q_seed_start) AS rn FROM null_ext) WHERE rn <= 300"""

CTES["full_fit"] = """SELECT query_id, n_null, mean - 0.5772156649015329 * scale AS location, scale FROM (SELECT query_id, count(*) AS n_null,
 avg(score) AS mean, coalesce(sqrt(var_samp(score) * 6.0 / (pi() * pi())), 0.0) AS scale FROM null_first GROUP BY query_id)"""
_FULL = "fit sig rep rep_rank rep_pair rep_stop rep_lost rep_kept final".split()
for _name in _FULL[1:]:
    CTES[f"full_{_name}"] = re.sub(r"\b(" + "|".join(_FULL) + r")\b", r"full_\1", CTES[_name])

_ODD = num(f"concat_ws(':', {SEED}, id, 'odd')")
CTES["colsize"] = f"""SELECT id, b, n, n % 3 AS odd, CASE WHEN n % 3 > 0 THEN {_ODD} % (n // 3 + 1) ELSE -1 END AS odd_at FROM pwide"""
CTES["colstart"] = """SELECT id, b, n, odd, odd_at, u.i AS blk, CASE WHEN odd_at >= 0 AND u.i > odd_at THEN (u.i - 1) * 3 + odd ELSE u.i * 3 END AS s0,
 CASE WHEN u.i = odd_at THEN odd ELSE 3 END AS w FROM colsize, unnest(range(n // 3 + CASE WHEN odd > 0 THEN 1 ELSE 0 END)) AS u(i) WHERE n > 5
 UNION ALL SELECT id, b, n, odd, odd_at, 0, 0, n FROM colsize WHERE n <= 5"""
CTES["colcell"] = f"""SELECT id, b, s0 + u.i AS col, {num(f"concat_ws(':', {SEED}, id, 'block', s0)")} AS bk,
 {num(f"concat_ws(':', {SEED}, id, 'cell', s0 + u.i)")} AS ck FROM colstart, unnest(range(w)) AS u(i)"""

DEPENDS = {name: [other for other in CTES if other != name and f" {other} " in f" {text} ".translate(
    str.maketrans({c: " " for c in ",().\n"}))] for name, text in CTES.items()}


def sql(body: str) -> str:
    """The body with the table expressions it needs, in definition order."""
    flat = f" {body} ".translate(str.maketrans({c: " " for c in ",().\n"}))
    need, todo = set(), [n for n in CTES if f" {n} " in flat]
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += DEPENDS[name]
    chain = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need)
    return f"WITH RECURSIVE {chain} {body}" if chain else body


_SEED = "query_id, target_id, q_start, q_end, d_start, d_end"
_HIT = "query_id, target_id, q_seed_start, d_seed_start, q_start, q_end, d_start, d_end"
_HITS = "SELECT query_id, target_id, q_pos, d_pos FROM"
_PATH = "repeat('x', CAST(q_end - q_start + 1 AS INT))"
_CHECK = """SELECT id, b AS bases, round(list_sum(list_transform(v, lambda x: coalesce(x, 0.0))), 4) AS total,
 len(list_filter(v, lambda x: x IS NULL)) AS missing FROM pwide"""
_HALF = "CAST((n - 3) // 2 AS BIGINT)"

_FOLDS = """SELECT id, '((.' || l || '...' || reverse(replace(replace(l, '.', ''), '(', ')')) || r || '...'
 || reverse(replace(replace(r, '.', ''), '(', ')')) || '..))..' AS text FROM (
 SELECT id, translate(b[1:n // 4], 'ACGTN', '(.((.') AS l, translate(b[n // 4 + 1:2 * (n // 4)], 'ACGTN', '(.((.') AS r FROM pwide)"""
#: Pairs by a stack of open brackets, and the stems that they form.
_STEMS = f"""SELECT *, sum(CASE WHEN ix = pi + 1 AND j = pj - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY ix) AS stem FROM (
 SELECT *, lag(ix) OVER (PARTITION BY id ORDER BY ix) AS pi, lag(j) OVER (PARTITION BY id ORDER BY ix) AS pj FROM (
 SELECT o.id, o.ix, min(c.ix) AS j FROM ({{cells}}) o JOIN ({{cells}}) c ON c.id = o.id AND c.ix > o.ix AND c.mark = ')'
 AND c.after = o.after - 1 WHERE o.mark = '(' GROUP BY o.id, o.ix))""".replace("{cells}", f"""SELECT id, ix, text[ix + 1] AS mark,
 sum(CASE text[ix + 1] WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ix) AS after
 FROM ({_FOLDS}) f, unnest(range(0, length(text))) AS u(ix)""")

_BODIES = {
    "cap": "SELECT id, pos, round(c, 6) AS capped FROM p",
    "trim_range": 'SELECT id, a AS "start", z AS "end" FROM ptrim UNION ALL SELECT id, a, z FROM qtrim',
    "kmer_windows": """SELECT id AS query_id, pos AS q_pos, wb AS window_bases, miss AS n_missing,
 round(list_sum(list_transform(raw, lambda x: coalesce(x, 0.0))), 6) AS total FROM pin WHERE pos % 3 = 0""",
    "missing_filter": "SELECT id AS query_id, count(*) AS n_windows FROM pin WHERE miss = 0 GROUP BY id",
    "gini_complexity": f"SELECT id AS query_id, pos AS q_pos, round({GINI}, 6) AS gini FROM pin WHERE miss = 0",
    "query_kmers": f"SELECT id AS query_id, pos AS q_pos, wb AS window_bases, n AS q_len FROM qin WHERE miss = 0 AND {GINI} >= 0.2",
    "gc_fraction": "SELECT doc_id, round(length(regexp_replace(text, '[^CG]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 6) AS gc FROM documents",
    "hamming": """SELECT a.id, (SELECT count(*) FROM unnest(range(least(a.n, x.n))) AS u(i)
 WHERE a.b[u.i + 1] <> x.b[u.i + 1]) AS distance FROM pwide a JOIN pwide x
 ON CAST(a.id AS BIGINT) = CAST(x.id AS BIGINT) - 1""",
    "base_score": f"""SELECT id, pos, round({pair('r', 'r2', 1.5)}, 6) AS score FROM (SELECT id, pos, n, r, lead(r) OVER (PARTITION BY id ORDER BY pos) AS r2 FROM p)
 WHERE pos < n - 1""",
    "seq_base_score": """SELECT id, pos, CASE WHEN base = b2 THEN 0.5 ELSE -2.0 END::DOUBLE AS score FROM (SELECT id, pos, n, base, lead(base) OVER (PARTITION BY id ORDER BY pos) AS b2 FROM p)
 WHERE pos < n - 1""",
    "deigan": """SELECT event_id, round(CASE WHEN event_id % 97 <> 0 AND value / 100.0 - 0.2 >= 0 THEN 1.8 * ln(value / 100.0 - 0.2 + 1.0) - 0.6 ELSE 0.0 END, 6) AS energy FROM events""",
    "nibble_decode": "SELECT event_id, substr('ACGTN', CAST(event_id % 5 + 1 AS INT), 1) AS base FROM events",
    "display_bases": "SELECT id, CASE WHEN n % 2 = 0 THEN replace(b, 'T', 'U') ELSE b END AS shown FROM pwide",
    "display_number": f"SELECT event_id, {shown_number('x')} AS shown FROM (SELECT event_id, value / 7000.0 / pow(10.0, event_id % 12) AS x FROM events)",
    "rolling_stats": f"""SELECT id AS target_id, pos AS d_pos, round(list_avg(filled), 8) AS mean, round(list_aggregate(filled, 'stddev_pop'), 6) AS sigma FROM pwin WHERE k = {K}""",
    "window_distances": """SELECT query_id, q_pos, target_id, count(*) AS n, round(min(dist), 6) AS nearest, round(max(dist), 6) AS farthest,
 round(sum(dist * (d_pos + 1)), 4) AS weighted FROM dist GROUP BY ALL""",
    "distance_threshold": """SELECT query_id, q_pos, target_id, n, round(m, 6) AS mean_dist, round(sd, 6) AS sd_dist, round(lim, 6) AS max_dist FROM stat""",
    "match_kmers_all": f"{_HITS} hit",
    "match_kmers_tiled": f"{_HITS} hit",
    "promiscuity_cut": f"{_HITS} near WHERE target_len // n_hits >= least(40, target_len)",
    "seq_dist_filter": f"""{_HITS} hit WHERE (SELECT count(*) FROM unnest(range({K})) AS u(i) WHERE q_wb[u.i + 1] <> d_wb[u.i + 1]) <= 6""",
    "gc_diff_filter": f"""{_HITS} hit WHERE abs(length(regexp_replace(q_wb, '[^CG]', '', 'g')) - length(regexp_replace(d_wb, '[^CG]', '', 'g'))) / {K}.0
 <= 0.2676 * exp(-0.053 * {K})""",
    "diagonals": "SELECT query_id, target_id, q_pos - d_pos AS diag, count(*) AS n FROM hit GROUP BY 1, 2, 3",
    "hsg_groups": f"SELECT {_SEED}, n_kmers FROM groups",
    "min_kmers_having": f"SELECT {_SEED}, n_kmers FROM groups WHERE n_kmers >= 3",
    "seed_score": f"SELECT {_SEED}, round(seed_score, 6) AS seed_score FROM scored",
    "seed_score_with_bases": f"""SELECT {_SEED}, round(seed_score + extra, 6) AS seed_score FROM scored JOIN (SELECT s.query_id, s.target_id, s.q_start, s.d_start,
 sum(CASE WHEN q.base = p.base THEN 0.5 ELSE -2.0 END::DOUBLE) AS extra {_CELLS} GROUP BY 1, 2, 3, 4) USING ({_KEY})""",
    "positive_seeds": f"SELECT {_SEED}, round(seed_score, 6) AS seed_score FROM pos_seed",
    "positive_seeds_tiled": f"SELECT {_SEED}, round(seed_score, 6) AS seed_score FROM pos_seed",
    "duplicate_names": """SELECT CAST(length(query_id) % 2 AS VARCHAR) AS query_id, CAST(CAST(target_id AS BIGINT) % 7 AS VARCHAR) AS target_id,
 q_start, q_end, d_start, d_end, CAST('0x' || substr(md5(pos_seed.query_id), 1, 12) AS BIGINT) AS query_ord,
 CAST(target_id AS BIGINT) AS target_ord, round(seed_score, 6) AS seed_score FROM pos_seed""",
    "align_tolerance": f"""SELECT {_SEED}, {reach('up0')} AS up, {reach('down0')} AS down FROM (SELECT s.*, {_TOL} FROM (
 SELECT s.*, t.a, t.z, d.n AS target_len FROM seed s JOIN qtrim t ON s.query_id = t.id JOIN ptrim d ON s.target_id = d.id) s)""",
    "first_null_seeds": f"""SELECT {_SEED} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY target_id, q_start - d_start, q_start) AS rn
 FROM pos_seed) WHERE rn <= 20""",
    "ungapped_extend": f"SELECT {_HIT}, round(raw_score, 6) AS raw_score, {_PATH} AS q_path, {_PATH} AS t_path FROM ext",
    "norm_score": f"SELECT {_HIT}, round(score, 6) AS score FROM ext",
    "banded_extend": f"SELECT {_HIT}, round(score, 6) AS score, q_path, t_path FROM gapped",
    "shuffle_count": "SELECT count(*) AS cells, greatest(1, 500000 // count(*)) AS per_profile FROM p",
    "chunk_layout": f"""SELECT id, n, block_offset, CASE WHEN block_offset > 0 THEN 1 ELSE 0 END + (n - block_offset) // 10 + CASE WHEN (n - block_offset) % 10 > 0 THEN 1 ELSE 0 END AS chunks
 FROM (SELECT id, n, CASE WHEN n % 10 > 0 THEN {num(f"concat_ws(':', {SEED}, 'offset', id)")} % (n % 10) ELSE 0 END AS block_offset FROM pwide)""",
    "ordinals": "SELECT id, dense_ord FROM ord",
    "draws": "SELECT draw, id, n FROM drawn",
    "shuffled_db": _SHUFFLED,
    "shuffled_db_long": _SHUFFLED,
    "shuffled_in_blocks": """SELECT id, draw, string_agg(base, '' ORDER BY spot) AS bases, round(sum(coalesce(r, -1.0) * spot), 6) AS checksum
 FROM moved_v JOIN moved_b USING (id, draw, spot) GROUP BY id, draw""",
    "null_fit": "SELECT query_id, n_null, round(location, 6) AS location, round(scale, 6) AS scale FROM fit",
    "null_scores_ungapped": "SELECT query_id, n_null, round(location, 6) AS location, round(scale, 6) AS scale FROM full_fit",
    "normal_fit_z": """SELECT target_id, round(mean, 10) AS mean, round(stddev, 6) AS stddev, round((best - mean) / CASE WHEN stddev > 0 THEN stddev END, 6) AS z
 FROM (SELECT target_id, avg(seed_score) AS mean, stddev_samp(seed_score) AS stddev, max(seed_score) AS best FROM pos_seed GROUP BY target_id)""",
    "column_shuffle": "SELECT id, string_agg(b[col + 1], '' ORDER BY bk, col) AS bases FROM colcell GROUP BY id",
    "column_shuffle_in_block": "SELECT id, string_agg(b[col + 1], '' ORDER BY bk, ck, col) AS bases FROM colcell GROUP BY id",
    "gumbel_pvalue": f"SELECT {_HIT}, round(pvalue, 6) AS pvalue FROM sig",
    "evalue": f"SELECT {_HIT}, n_hits, round(evalue, 6) AS evalue FROM sig",
    "status": f"SELECT {_HIT}, CASE WHEN evalue > 10.0 THEN '' WHEN evalue > 1.0 THEN '?' ELSE '!' END AS status FROM rep",
    "overlap_removal": f"SELECT {_HIT}, round(score, 6) AS score FROM all_kept",
    "result_table": f"""SELECT query_id AS "Query", target_id AS "DB field", q_start AS "Qstart", q_end AS "Qend", d_start AS "Dstart", d_end AS "Dend",
 q_seed_start || '-' || q_seed_end AS "Qseed", d_seed_start || '-' || d_seed_end AS "Dseed", round(score, 4) AS "Score",
 {shown_number('pvalue')} AS "P-value",
 {shown_number('evalue')} AS "E-value", status FROM final""",
    "fasta_text": "SELECT name, '>' || target_id || chr(10) || db || chr(10) || '>' || query_id || chr(10) || qb || chr(10) AS text FROM shown",
    "stockholm_text": """SELECT name, '# STOCKHOLM 1.0' || chr(10) || '#=GF ID ' || name || chr(10) || '#=GF AU profseek' || chr(10) || chr(10)
 || rpad(target_id, w, ' ') || db || chr(10) || rpad(query_id, w, ' ') || qb || chr(10) || '//' || chr(10) AS text
 FROM (SELECT *, CAST(greatest(length(target_id), length(query_id), 12) + 1 AS INT) AS w FROM shown)""",
    "reactivity_json": """SELECT name, query_id, d_end, q_end - q_start + 1 AS n_query, CASE WHEN p.r IS NULL THEN 'NaN' ELSE CAST(CAST(p.r AS FLOAT) AS VARCHAR) END AS first_target
 FROM shown JOIN p ON p.id = target_id AND p.pos = d_start""",
    "gapped_render": "SELECT id, replace(b, 'N', '-') AS text FROM pwide",
    "gapped_values": """SELECT p.id, pos, base = 'N' AS gap, round(CASE WHEN base <> 'N' THEN r END, 6) AS value FROM p
 JOIN (SELECT id, max(pos) AS last FROM p WHERE base <> 'N' GROUP BY id) x ON p.id = x.id WHERE pos <= last""",
    "dotbracket_blocks": f"""SELECT x.id, any_value(text) AS shown, min(x.ix)::BIGINT AS l_start, (max(x.ix) + 1)::BIGINT AS l_end,
 min(x.j)::BIGINT AS r_start, (max(x.j) + 1)::BIGINT AS r_end FROM ({_STEMS}) x JOIN ({_FOLDS}) f ON f.id = x.id
 GROUP BY x.id, stem""",
    "pair_support": f"""SELECT x.id, count(*) AS total, count(*) FILTER (WHERE (b || b)[ix + 1] || (b || b)[j + 1]
 IN ('AT', 'TA', 'GT', 'TG', 'GC', 'CG')) AS canonical FROM ({_STEMS}) x JOIN pwide f ON f.id = x.id GROUP BY x.id""",
    "native_codec": _CHECK,
    "profile_files": _CHECK,
    "text_source": _CHECK,
    "xml_source": _CHECK,
    "first_of_name": """SELECT CAST(user_id AS VARCHAR) AS id, round(arg_min(top, d), 6) AS top FROM (SELECT user_id, day(ts) AS d, max(value) AS top FROM events GROUP BY 1, 2)
 GROUP BY user_id""",
}

_BODIES["ungapped_extend_tiled"] = _BODIES["ungapped_extend"]
_BODIES["null_scores_stored"] = _BODIES["null_scores_ungapped"]
_BODIES["result_table_gapped"] = _BODIES["result_table"].replace("FROM final", "FROM gap_final")
for _kind in ("fasta", "stockholm"):
    _BODIES[f"{_kind}_text_gapped"] = _BODIES[f"{_kind}_text"].replace("FROM shown", """FROM (SELECT * REPLACE (
 """ + ", ".join(f"array_to_string({laid(b, t, chr(39) + '-' + chr(39), '@')}, '') AS {b}" for b, t in (("qb", "q_path"), ("db", "t_path")))
        + ") FROM gap_shown)")


def _json(values: str, path: str) -> str:
    # numbers below 0.001 have an exponent, and always a digit after the point
    text = "CAST(CAST(@ AS FLOAT) AS VARCHAR)"
    tiny = f"regexp_replace(regexp_replace({text}, '^0[.]000([1-9])', '\\1.'), '[.]$', '.0') || 'E-4'"
    tinier = f"regexp_replace(regexp_replace({text}, 'e-0?', 'E-'), '^([0-9])E', '\\1.0E')"
    cell = f"""CASE WHEN @ IS NULL THEN '"NaN"' WHEN @ = 0 OR @ >= 0.001 THEN {text} WHEN @ >= 0.0001 THEN {tiny} ELSE {tinier} END"""
    return f"'[' || array_to_string({laid(values, path, chr(39) + 'null' + chr(39), cell)}, ',') || ']'"


_BODIES["reactivity_json_gapped"] = f"""SELECT name, '{{"query":' || {_json('qr', 'q_path')} || ',"queryId":"' || query_id || '","queryFrom":'
 || q_start || ',"queryTo":' || q_end || ',"target":' || {_json('dr', 't_path')} || ',"targetId":"' || target_id || '","targetFrom":'
 || d_start || ',"targetTo":' || d_end || '}}' AS text FROM (SELECT s.*, k.v[q_start + 1:q_end + 1] AS qr, t.v[d_start + 1:d_end + 1] AS dr
 FROM gap_shown s JOIN qwide k ON k.id = s.query_id JOIN pwide t ON t.id = s.target_id)"""
_BODIES["search_ungapped"] = _BODIES["result_table"].replace("FROM final", "FROM full_final")
_BODIES["search_ungapped_tiled"] = _BODIES["search_ungapped"]

ORACLES = {name: sql(body) for name, body in _BODIES.items()}
