"""Manifests, conversation repair and page extraction against brute force, planted cases and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profseek.llm import extract, manifest, queries, repair
from profseek.llm.dom import leaf_blocks


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels of a tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def plain_proof(levels, i):
    proof = []
    for low in levels[:-1]:
        proof.append((0, "") if i ^ 1 >= len(low) else (-1 if i & 1 else 1, low[i ^ 1]))
        i >>= 1
    return proof


def plain_manifest(rows, columns):
    """rows: (key, group, values)."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(k, g, h(*[text(v) for v in values])) for k, g, values in rows]
    first_null = lambda x: (x is not None, x)
    groups = {}
    for g in sorted({g for _, g, _ in leaves}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted([(k, d) for k, x, d in leaves if x == g], key=lambda x: (first_null(x[0]), x[1]))
        groups[g] = own, plain_tree([d for _, d in own])
    top = plain_tree([levels[-1][0] for _, levels in groups.values()])
    out = []
    for j, (g, (own, levels)) in enumerate(groups.items()):
        for i, (k, d) in enumerate(own):
            out.append((k, g, d, levels[-1][0], top[-1][0], tuple(plain_proof(levels, i) + plain_proof(top, j))))
    return out


@pytest.mark.parametrize("stratum", [2, 8])
def test_manifest(docs, stratum, monkeypatch):
    monkeypatch.setattr(manifest, "STRATUM", stratum)
    rng = random.Random(stratum)
    langs = ["en"] * 30 + ["de", "ü", "\U0001f600", "￮", None]
    rows = [(rng.randrange(40), f"t{i}", rng.choice(langs)) for i in range(70)] + [(None, t, "x") for t in ODD_TEXTS]
    rows += [(5, "same", "en")] * 3 + [(1, None, None)]
    table = docs(*rows)
    narrow = manifest.manifest(table, ["doc_id", "source", "text"], "source", "doc_id", {"n": F.length("text")}).withColumn(
        "back", manifest.folded(F.col("leaf"), F.col("proof")))
    got = [(r.key, r.group, r.leaf, r.subroot, r.root, tuple((s.side, s.digest) for s in r.proof)) for r in narrow.collect()]
    want = plain_manifest([(i, s, (i, s, t)) for i, t, s in rows], None)
    assert collections.Counter(got) == collections.Counter(want)
    assert narrow.filter("back <> root").isEmpty()


def test_manifest_of_nothing_and_of_one(docs):
    assert manifest.manifest(docs(), ["doc_id"], "source", "doc_id").count() == 0
    one = manifest.manifest(docs((1, "a", "en")), ["doc_id"], "source", "doc_id").first()
    assert one.leaf == one.subroot == one.root == h("1:1") and one.proof == []


def plain_repair(rows):
    """Faults, least cost and edits, and repaired rows of one conversation of (turn, role, text), by search over all edits."""
    nonspace = re.compile(r"[^\x20\x09-\x0D]")
    seen, coded, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        fault = ("blank" if not nonspace.search(text) else "duplicate" if (role, text) in seen
                 else "truncated" if nonspace.findall(text)[-1] not in ".!?" else None)
        seen.add((role, text))
        counts[fault] += 1
        coded.append((role, text, fault))
    best = {s: (c, a, ls) for s, c, a, ls in [
        ("", 0, "", ()), ("s", 10, "II", ("user:", "assistant:")), ("u", 5, "I", ("assistant:",)), ("a", 0, "", ())]}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    for role, text, fault in reversed(coded):
        now = {}
        for s in best:
            options = [(2 + best[s][0], "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                c = role[:1]
                if c and (c == after[s] or s == "" and c == "s"):
                    b = best[c]
                    options.append((more + b[0], "K" + b[1], (f"{role}:{text}", *b[2])))
                b = best[after[s]]
                options.append((more + 1 + b[0], "R" + b[1], (f"{full[after[s]]}:{text}", *b[2])))
            now[s] = min(options)
        best = {s: min(now[s], (5 + now[after[s]][0], "I" + now[after[s]][1], (full[after[s]] + ":", *now[after[s]][2])),
                       (10 + now[after[after[s]]][0], "II" + now[after[after[s]]][1],
                        (full[after[s]] + ":", full[after[after[s]]] + ":", *now[after[after[s]]][2]))) for s in best}
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), best[""][0], best[""][1], list(best[""][2]))


CHATS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("chat", T.StringType()), T.StructField("ordinal", T.StringType())])


def in_order(rows):
    said = lambda r, t: h(f"{len(r)}:", r, t)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, said(r[1], r[2])))


@pytest.mark.parametrize("chunk", [2, 4096])
def test_repair(spark, chunk, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    texts = ["One.", "Two!", "Three", "", " \t", "Four? ", "Five. ", "é́ \U0001f600.", "x" * 5000, "Six.", "Seven!"]
    chats = {i: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 14))] for i in range(40)}
    chats[50] = [(t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"Legal {t}.") for t in range(30)]
    chats[51] = [(t, ("assistant", "user")[t % 2], f"Shifted {t}.") for t in range(31)]
    chats[52] = [(None, "user", "A."), (3, "user", "A."), (3, "user", "A."), (9, "assistant", "B.")]
    chats[53] = [(1, "user", "same.")] * 9
    chats[54] = [(None, "system", "")]
    chats[None] = [(0, "user", "Q?"), (1, "assistant", "A.")]
    rows = [(c, t, r, x, "clash", "clash") for c, own in chats.items() for t, r, x in own]
    rng.shuffle(rows)
    done = repair.Repair(spark.createDataFrame(rows, CHATS))
    report = {r.id: tuple(r)[1:] for r in done.report().collect()}
    lines = collections.defaultdict(list)
    for r in sorted(done.rows().collect(), key=lambda r: (str(r.id), r.place)):
        lines[r.id].append(f"{r.role}:{r.text}")
    hashed = {r.id: r.digest for r in repair.digests(done.rows()).collect()}
    for c, own in chats.items():
        want = plain_repair(in_order(own))
        assert report[c] == want[:-1], c
        assert lines[c] == want[-1]
        assert hashed.get(c, h("")) == h("\n".join(want[-1]))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines[c]))
    assert set(report) == set(chats)


def test_repair_costs_are_least():
    """Edits of short role strings against an exhaustive search."""
    legal = re.compile("(s?(ua)+)?")

    def least(letters):
        best = (10**9,)
        for edits in itertools.product("KRD", repeat=len(letters)):
            for gaps in itertools.product(range(3), repeat=len(letters) + 1):
                audit, shown, cost = "", "", 0
                for k, g in enumerate(gaps):
                    audit, shown, cost = audit + "I" * g, shown + "?" * g, cost + 5 * g
                    if k < len(letters):
                        audit += edits[k]
                        cost += "KRD".index(edits[k])
                        shown += {"K": letters[k], "R": "?", "D": ""}[edits[k]]
                if (cost, audit) < best:
                    for start in ("s", ""):
                        want = start + "ua" * ((len(shown) - len(start)) // 2)
                        if len(want) == len(shown) and legal.fullmatch(want) and all(
                                a == b or a == "?" and b != "s" for a, b in zip(shown, want)):
                            best = (cost, audit)
        return best

    for n in range(4):
        for letters in itertools.product("suax", repeat=n):
            codes = "".join(repair.LETTERS["suax".index(c)] for c in letters)
            before, cost = repair._backwards(codes, repair.END)
            audit = repair._edits(codes, repair.END, 0, True)[0]
            assert (cost + ord(before[0]) - 48, audit) == least(letters), letters


def test_damage(spark):
    rows = [(i, t, None if t == 5 else "assistant", None if t == 6 else "Ab. c!", "x", "y") for i in range(60)
            for t in range(7)] + [(None, None, "user", "Q?", "x", "y")]
    got = collections.Counter(tuple(r) for r in repair.damaged(spark.createDataFrame(rows, CHATS)).collect())
    want = collections.Counter()
    for c, t, r, x, _, _ in rows:
        r, x = r or " ", x or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            want[(c, t, "user" if kind == 4 else r, x)] += 2 if kind == 3 else 1
    assert got == want


def test_repair_query(spark, tmp_path):
    """Conversations that lose every row are reported, and an empty table gives nothing."""
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "A.", "", "")], CHATS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    row = queries.op11_conversation_repair(spark, f"{tmp_path}/a").first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", h(""))
    spark.createDataFrame([], CHATS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op11_conversation_repair(spark, f"{tmp_path}/b").count() == 0


@pytest.fixture(scope="module")
def model():
    return extract.field()


def test_extraction_on_held_out_pages(model):
    right = total = 0
    for blocks, labels in extract.labelled_chains(300, seed=12345):
        right += sum(a == b for a, b in zip(model.decoded(blocks), labels))
        total += len(labels)
    assert right / total > 0.985


PAGES = {
    '<div id="cookie-consent"><p>We use cookies to improve your visit.</p></div><header class="site-header"><ul class=menu>'
    '<li><a href=/a>World</a><li><a href=/b>Sport</a></ul></header><div class="post"><h1>A great day</h1><p>Sun &amp; wind.'
    '</p><div class="ad-slot">Buy now!</div><p>Then it rained.</p><aside><h3>Related</h3><ul><li><a href=x>Other</a></li>'
    '</ul></aside><p>End&nbsp;of it.</p></div><div id="comments"><h3>3 comments</h3><div class="comment"><p>I liked this '
    'story a lot.</p></div><form><label>Your name</label><textarea>t</textarea></form></div><div class="sidebar"><p>Read '
    'more here.</p></div><footer><p>&copy; 2020 Daily.</p></footer>':
        "A great day\n\nSun & wind.\n\nThen it rained.\n\nEnd of it.",
    '<nav><a href=1>Home</a></nav><main><h1>T</h1><p>One two three four five.</p><ul><li>First<li>Second</ul><table><tr><td>1'
    '<td>2</table></main>': "T\n\nOne two three four five.\n\nFirst\n\nSecond\n\n1\n\n2",
    '<article><h1>X</h1><p>He<b>ll</b>o<br>you<section class="reader-comments"><article><p>A reader says hello.</p></article>'
    '</section></article>': "X\n\nHello you",
    '<p>Just a page with text.</p><p>And more of it here.': "Just a page with text.\n\nAnd more of it here.",
    '<script>var t="</p>";</script><nav>a</nav><article><h1>A&am</h1><p><b>1 &lt; 2 &amp3<br><p>§</article><footer>&copy;':
        "A&am\n\n1 < 2 &3\n\n§",
}


def test_extraction_of_given_pages(model):
    for page, text in PAGES.items():
        assert extract.main_text(page, model) == text


def test_blocks_of_broken_pages():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("") == texts("<!-- <p>a</p>") == texts("<script>a") == texts("<p></p>") == []
    assert texts("a < b <i>c</i>d<br>e") == ["a < b cd e"]
    assert texts("<p>a<div>b</p>c</div>d") == ["a", "b", "c", "d"]
    assert texts("<head><title>t</title><body>x<style>y</style>z") == ["xz"]
    assert texts("<p title='a>b'>c</p><p title=\"x>d") == ["c", "d"]
    assert texts("<select><option>a</select>b<template><p>c</template>") == ["b"]
    assert texts("&#65;&am<b>p;</b>  x") == ["A&amp; x"] or texts("&am<b>p;</b>") == ["&amp;"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert texts(deep) == ["x"]


def test_extracted_table(spark, model):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    page = "<article><h1>X</h1><p>Words of it.</p></article>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None), (2, "u", "", "t"),
            (3, None, f"<nav><a href=x>m</a></nav><article>{'<p>word word.</p>' * 20_000}</article>", "t")]
    got = extract.extracted(spark.createDataFrame(rows, schema)).collect()
    want = "X\n\nWords of it."
    assert [tuple(r)[:2] for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got[:4]] == [want, want, "", ""] and got[4].text == "\n\n".join(["word word."] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extracted(spark.createDataFrame([], schema)).count() == 0
