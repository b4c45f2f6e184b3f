"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from profseek.llm.quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS) | {w.capitalize() for w in STOP_WORDS}))

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (
  SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
n AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    len(list_distinct(list_filter(words, lambda x: x IN ({_STOP}))))::BIGINT AS n_stop_words
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN n ON d.doc_id = n.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
   AND word_chars >= 2.0::DOUBLE * n_words AND word_chars <= 15.0::DOUBLE * n_words
   AND n_symbols::DOUBLE / n_words <= 0.3::DOUBLE AND n_capitals::DOUBLE / word_chars <= 0.5::DOUBLE
   AND n_stop_words >= 2 AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5::DOUBLE)) AS kept
FROM m"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
e AS (
  SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 15 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_DEDUPED = r"""
WITH s AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM {docs} WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, source, i, lines[i] AS line, regexp_matches(lines[i], '[^\x20\x09-\x0D]') AS word
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s)),
g AS (
  SELECT line, min(doc_id) AS first FROM l WHERE word GROUP BY line HAVING count(DISTINCT source) >= 6),
k AS (
  SELECT l.*, (g.line IS NOT NULL AND word AND l.doc_id <> g.first) AS gone FROM l LEFT JOIN g ON l.line = g.line),
t AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
    count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM k GROUP BY doc_id)"""
LINES = _DEDUPED.format(docs="documents") + """
SELECT d.doc_id, t.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""

def _crc32(value: str) -> str:
    """Unsigned CRC-32 of an ASCII string."""
    step = "list_reduce(range(8), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    return (f"xor(list_reduce(list_transform(range(1, length({value}) + 1), lambda i: ascii(({value})[i])::BIGINT), "
            f"lambda c, b: {step}, 4294967295::BIGINT), 4294967295)")


def _hashed(columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
                                   for c in columns.split(", ")) + ")"


MANIFEST = f"""
WITH RECURSIVE
l AS (
  SELECT doc_id, lang, {_hashed("doc_id, source, lang, n_chars, text")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 7 = 0
      THEN {_hashed("doc_id, source, lang, n_chars + 1, text")}
      ELSE {_hashed("doc_id, source, lang, n_chars, text")} END AS claimed
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT lang, 0 AS level, i, leaf AS h, n FROM r
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1
  GROUP BY lang, level, i // 2, n),
s AS (
  SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, i, h, n FROM s
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1
  GROUP BY level, i // 2, n),
top AS (SELECT h AS root, level AS height FROM u WHERE n = 1),
p AS (
  SELECT r.doc_id, r.leaf, r.lang, r.i, k, x.h, CASE WHEN x.i IS NULL THEN 0 WHEN (r.i >> k) % 2 = 1 THEN -1 ELSE 1 END AS side
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, unnest(range(0, s.height)) AS z(k)
  LEFT JOIN t AS x ON x.lang IS NOT DISTINCT FROM r.lang AND x.level = k AND x.i = xor(r.i >> k, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, r.lang, r.i, s.height + k, x.h,
    CASE WHEN x.i IS NULL THEN 0 WHEN (s.i >> k) % 2 = 1 THEN -1 ELSE 1 END
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang, top, unnest(range(0, top.height)) AS z(k)
  LEFT JOIN u AS x ON x.level = k AND x.i = xor(s.i >> k, 1)),
q AS (
  SELECT lang, i, array_agg({{'side': side, 'h': coalesce(h, '')}} ORDER BY k) AS steps FROM p GROUP BY lang, i),
f AS (
  SELECT r.*, coalesce(q.steps, []) AS steps FROM r LEFT JOIN q ON q.lang IS NOT DISTINCT FROM r.lang AND q.i = r.i),
w AS (
  SELECT lang, i, steps, 1 AS k, claimed AS v FROM f
  UNION ALL
  SELECT lang, i, steps, k + 1, sha256(CASE WHEN steps[k].side = -1 THEN steps[k].h ELSE '' END || v
    || CASE WHEN steps[k].side = 1 THEN steps[k].h ELSE '' END) FROM w WHERE k <= len(steps))
SELECT f.doc_id, f.leaf, s.h AS subroot, top.root,
  sha256(array_to_string(list_transform(f.steps, lambda x: x.h), '')) AS proof_sha256, w.v AS folded_root,
  w.v = top.root AS verified
FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang JOIN w ON w.lang IS NOT DISTINCT FROM f.lang AND w.i = f.i
  AND w.k = len(f.steps) + 1, top"""

_STATES = ("n", "s", "u", "a")
_NEXT = {"n": "u", "s": "u", "u": "a", "a": "u"}


def _row_costs(state: str) -> str:
    """Least (cost, edits, lines) from a state on over a row of `r` and what follows it in `g`."""
    to = _NEXT[state]
    kept = {"n": "CASE c WHEN 's' THEN g.s WHEN 'u' THEN g.u END", "u": "CASE c WHEN 'a' THEN g.a END"}.get(
        state, "CASE c WHEN 'u' THEN g.u END")
    role = "assistant" if state == "u" else "user"
    edit = "{{'c': {c} + ({g}).c, 'e': '{e}' || ({g}).e, 't': {t}}}".format
    none = "{'c': 1000000000::BIGINT, 'e': '', 't': ['']}"
    dropped = edit(c=2, g=f"g.{state}", e="D", t=f"g.{state}.t")
    kept = (f"CASE WHEN doomed OR ({kept}) IS NULL THEN {none} ELSE "
            + edit(c="extra", g=kept, e="K", t=f"list_prepend(line, ({kept}).t)") + " END")
    named = (f"CASE WHEN doomed THEN {none} ELSE "
             + edit(c="1 + extra", g=f"g.{to}", e="R", t=f"list_prepend('{role}:' || text, g.{to}.t)") + " END")
    return f"least({dropped}, {kept}, {named}) AS {state}"


def _insert_costs(state: str, over: str = "b") -> str:
    one, two = _NEXT[state], _NEXT[_NEXT[state]]
    role = {"u": "user", "a": "assistant"}
    step = (f"{{'c': 5 + {over}.{one}.c, 'e': 'I' || {over}.{one}.e, "
            f"'t': list_prepend('{role[one]}:', {over}.{one}.t)}}")
    more = (f"{{'c': 10 + {over}.{two}.c, 'e': 'II' || {over}.{two}.e, "
            f"'t': list_prepend('{role[one]}:', list_prepend('{role[two]}:', {over}.{two}.t))}}")
    return f"least({over}.{state}, {step}, {more}) AS {state}"


REPAIR = rf"""
WITH RECURSIVE
z AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, {_crc32("key")} % 20 AS kind FROM z),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS x(copy) WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(length(role)::VARCHAR || ':' || role || text)) AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS c, role || ':' || text AS line,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM o),
r AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS doomed,
    CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM f),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
g AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS n,
    {{'c': 10::BIGINT, 'e': 'II', 't': ['user:', 'assistant:']}} AS s, {{'c': 5::BIGINT, 'e': 'I', 't': ['assistant:']}} AS u,
    {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS a FROM n
  UNION ALL
  SELECT conv_id, i, {", ".join(_insert_costs(s) for s in _STATES)} FROM (
    SELECT r.conv_id, r.i - 1 AS i, {", ".join(_row_costs(s) for s in _STATES)}
    FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i) AS b),
e AS (SELECT conv_id, g.n AS best FROM g WHERE i = 0)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit,
  sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS v LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id"""

#: What the field has to find in the layout of these tables: the blocks of the article element.
EXTRACTION = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS article FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(article, '</?(h1|p)>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'),
      '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'))) AS blocks FROM a),
c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x:
    trim(regexp_replace(x, '[\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))),
    lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c"""

ORACLES = {"op1_quality_rules": QUALITY, "op2_line_dedup": LINES, "op5_chat_format": CHAT,
           "op11_conversation_repair": REPAIR, "op12_html_extraction": EXTRACTION,
           "op13_merkle_manifest": MANIFEST}
