"""Line dedup, near duplicates, personal data, vector search, archives and the pipeline against brute force."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import ODD_TEXTS

from profseek.llm import components, line_dedup, near_dedup, personal_data, vector_search, warc


def plain_line_dedup(rows, min_sites):
    sites, first = collections.defaultdict(set), {}
    word = re.compile(r"[^\x20\x09-\x0D]")
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if word.search(line):
                if site is not None:
                    sites[line].add(site)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    drop = {x for x, s in sites.items() if len(s) >= min_sites}
    return [None if text is None else "\n".join(x for x in text.split("\n") if x not in drop or first[x] == i)
            for i, text, _ in rows]


def test_line_dedup(docs):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(12)] + ["", " ", "\tx"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))), f"s{rng.randrange(7)}") for i in range(60)]
    rows += [(100 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(7, "line 1\nline 1\nown", "s1")]
    rows += [(200 + i, "one common line\nline 0", f"s{i % 9}") for i in range(300)]
    for sites in (3, 6, 8):
        found = line_dedup.drop_widespread_lines(docs(*rows), sites)
        assert found.columns == docs().columns
        got = collections.Counter((r["doc_id"], r["text"]) for r in found.collect())
        assert got == collections.Counter(zip((r[0] for r in rows), plain_line_dedup(rows, sites)))
    assert line_dedup.drop_widespread_lines(docs()).count() == 0


def shingle_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    width = min(words, len(found))
    return frozenset(tuple(found[i:i + width]) for i in range(len(found) - width + 1))


def plain_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # many blocks
    rng = random.Random(words)
    vocabulary = [f"W{k}é" for k in range(400)]
    texts = list(ODD_TEXTS)
    for _ in range(5):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 150))]
        for _ in range(28):  # copies of copies around the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).lower() if rng.random() < 0.3 else "\n".join(copy))
    texts += [texts[20]] * 3 + ["one", "one", "ONE two", "one two", "one two three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts))
    sets = {i: shingle_set(t, words) for i, t in rows}
    want = plain_components(sets)
    got = near_dedup.near_duplicates(docs(*rows), words).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    kept = near_dedup.keep_one(docs(*rows, (None, "one"), (None, None)), words)
    assert kept.columns == docs().columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert kept.filter("doc_id IS NULL").count() == 2


def test_near_duplicates_of_nothing_and_repeated_rows(docs):
    assert near_dedup.near_duplicates(docs()).count() == 0
    rows = near_dedup.near_duplicates(docs((3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"))).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(2, 2), (3, 2), (3, 2)]


def test_sketches_tell_similarity_apart():
    rng = np.random.default_rng(1)
    limit = near_dedup.most_different_bits(0.8)
    for similarity, near in ((0.9, True), (0.82, True), (0.1, False)):
        for _ in range(20):
            n = 600
            common = round(2 * n * similarity / (1 + similarity))
            every = rng.integers(0, 2 ** 63, 2 * n - common, dtype=np.uint64)
            a, b = every[:n], every[n - common:]
            x = near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))
            assert (int(np.unpackbits(x).sum()) <= limit) == near


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 95), (7, 7), (200, 100)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 90 for k in (90, 95, 100, 200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(digits):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_seed_spans(docs):
    rng = random.Random(2)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (234) 555-0199", "+123", "é", "\n", " ", "_", ".", "-", "+", "4111111111111111",
             "😀", "12", "%", "z"]
    texts = [*ODD_TEXTS, "7" * 30_000, "a@" * 9_000, "+1 " * 5_000,
             *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]]
    found = personal_data.found_spans(docs(*enumerate(texts)), doc_id="doc_id").collect()
    assert len(found) == len(texts)
    for r in found:
        assert [tuple(s) for s in r["seeds"]] == plain_spans(texts[r["doc_id"]])
        assert set(r["seeds"]) <= set(r["spans"])


def test_patterns_discover_identifiers(docs):
    rows = [(i, f"some words here\nemployee number: alice{i}@mail.example.com and more") for i in range(9)]
    rows += [(20, "quiet employee number: AB-7731-XK left"), (21, "badge AB-7731-XK again"), (22, "order 12345678 shipped"),
             (23, "order 22345678 shipped"), (24, "employee number: 4111111111111112 no card")]
    found = {r["doc_id"]: r["spans"] for r in personal_data.found_spans(docs(*rows), doc_id="doc_id").collect()}
    text = dict(rows)
    assert [text[20][s["start"]:s["end"]] for s in found[20]] == ["AB-7731-XK"]
    assert [text[21][s["start"]:s["end"]] for s in found[21]] == ["AB-7731-XK"]  # known by now, whatever stands before
    assert all(found[i] == [] for i in (22, 23, 24))
    clean = personal_data.redacted(docs(*rows, (30, None), (31, "")))
    assert clean.columns == docs().columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[20] == "quiet employee number: [KEY] left" and texts[22] == text[22]
    assert texts[3] == "some words here\nemployee number: [EMAIL] and more" and texts[30] is None and texts[31] == ""
    assert personal_data.redacted(docs()).count() == 0


def brute_nearest(rows, query, k):
    own = [(np.linalg.norm(np.asarray(v) - np.asarray(query[1])), i) for i, v in rows if i != query[0]]
    return [(i, d) for d, i in sorted(own)[:k]]


def test_vector_search(spark):
    rng = np.random.default_rng(8)
    good = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 24)))]
    good += [(5000 + i, good[100][1]) for i in range(300)]  # one vector very often
    odd = [(90_000, None), (90_100, [0.0] * 24), (90_200, [1.0] * 23 + [None]), (90_300, [1.0] * 23 + [float("nan")]),
           (90_400, [1.0] * 23 + [float("inf")]), (90_500, [1.0] * 3), (None, [1.0] * 24)]
    frame = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, region string")
    params = vector_search.Params(region_rows=128)
    got = collections.defaultdict(list)
    for r in vector_search.nearest_neighbours(frame, params=params).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    queries = [r for r in good if r[0] % 100 == 0]
    assert set(got) == {q[0] for q in queries}
    hits = []
    vectors = dict(good)
    for q in queries:
        mine, want = sorted(got[q[0]]), brute_nearest(good, q, 10)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - np.linalg.norm(np.asarray(vectors[i]) - np.asarray(q[1]))) < 1e-12 for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits.append(len({i for _, i, _ in mine} & {i for i, _ in want}) / 10)
    assert np.mean(hits) >= 0.9
    assert [i for _, i, _ in sorted(got[100])] == list(range(5000, 5010))
    few = spark.createDataFrame(good[:4], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vector_search.nearest_neighbours(few).orderBy("rank").collect()] == [
        i for i, _ in brute_nearest(good[:4], good[0], 10)]
    assert vector_search.nearest_neighbours(few.limit(0)).count() == 0


@pytest.mark.parametrize("scale, offset", [(1.0, 1e8), (1e20, 0.0), (1e-25, 0.0), (1.0, -1e12)])
def test_vector_search_shifted_and_scaled(spark, scale, offset):
    rng = np.random.default_rng(4)
    rows = [(n, (v * scale + offset).tolist()) for n, v in enumerate(rng.normal(size=(900, 32)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = vector_search.Params(region_rows=256, probe=1.0)
    got = collections.defaultdict(set)
    for r in vector_search.nearest_neighbours(frame, params=whole).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[q[0]] & {i for i, _ in brute_nearest(rows, q, 10)}) for q in rows[::100]]
    assert sum(hits) >= 0.97 * 90


PAGES = [(i, f"https://user@H{i % 3}.Example.com:80/p/{i % 7}?q={i % 5}#f", f"<p>page {i % 11} é</p>" * (i % 4))
         for i in range(90)]
PAGES += [(500, None, None), (501, "", ""), (502, "http://bad host/\r\nX: y\t", "a\r\n\r\nb"), (None, "http://x/", "alone"),
          (None, None, "<p>twice</p>"), (503, "http://x/", "<p>twice</p>"), (503, "http://x/", "<p>twice</p>")]


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 4)
    frame = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string")
    got = warc.archive_round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    groups = collections.defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        holder = max((x for x in groups[html or ""] if x is not None), default=None)
        revisit = len(groups[html or ""]) > 1 and holder is not None and i != holder
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", holder if revisit else None))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert warc.archive_round_trip(frame.limit(0)).count() == 0


def test_lookup_reads_single_captures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 4)
    frame = spark.createDataFrame(PAGES[:90], "page_id long, url string, html string")
    folder = str(tmp_path)
    records = warc.write_archive(frame, folder)
    directory = warc.build_index(records, folder)
    assert directory.count() >= 90 / 4
    wanted = records.filter("page_id IN (3, 44, 89)").select("surt", "page_id")
    absent = spark.createDataFrame([("zz,nowhere)/", 3), ("", 1)], "surt string, page_id long")
    found = warc.lookup(directory, wanted.unionByName(absent), folder)
    read = {r["page_id"]: (r["url"], r["payload"]) for r in warc.read_records(found, folder, with_payload=True).collect()}
    assert set(read) == {3, 44, 89}
    assert read[89][1].decode() == PAGES[89][2] and read[89][0] == PAGES[89][1]
    assert warc.surt("https://user@A.B.com:80/x?y#z") == "com,b,a)/x?y"
    assert warc.surt("http://A.com") == "com,a)/"


def test_pipeline_stages(spark, docs, word_bpe):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "personal_data",
                                                      "best_fit_packing"]
    rng = random.Random(6)

    def prose(n=90):
        return " ".join(rng.choice(["the", "and", "of", "in"]) if rng.random() < 0.3 else f"w{rng.randrange(5000)}"
                        for _ in range(n))

    base = [prose() for _ in range(12)]
    rows = [(i, f"shared menu line\n{t}\nmail me.{i}@mail.example.com now", f"s{i % 8}") for i, t in enumerate(base)]
    rows += [(50, rows[3][1] + " end", "s3"), (51, "too short", "s1"), (52, None, "s2")]
    frame = docs(*rows)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = components.stored(stage(spark, frame, ""), "test-stage")
        if name != "best_fit_packing":
            assert frame.columns == docs().columns
        seen.append({r["doc_id"]: r["text"] for r in frame.collect()} if "text" in frame.columns else frame.collect())
    assert set(seen[0]) == {*range(12), 50}
    assert [i for i, t in seen[1].items() if "shared menu line" in t] == [0]
    assert set(seen[2]) == set(range(12))
    assert all("[EMAIL]" in t and "@" not in t for t in seen[3].values())
    assert {r["doc_id"] for r in seen[4]} == set(range(12))


def test_pipeline_odd_rows(spark, docs):
    """Null, empty and very long texts, null ids and sources, repeated rows, an empty table, clashing columns."""
    import corpus_pipeline

    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.3 else f"k{rng.randrange(9000)}"
                     for _ in range(80)) for _ in range(4)]
    rows = [(1, good[0], "s"), (1, good[0], "s"), (2, good[1], None), (3, good[0], "t"), (None, good[2], "s"), (4, good[3])]
    rows += [(100 + n, text) for n, text in enumerate(ODD_TEXTS)]
    left = []
    for frame in (docs(*rows), docs()):
        for name, stage in corpus_pipeline.STAGES:
            frame = components.stored(stage(spark, frame, ""), "test-odd")
            if name != "best_fit_packing":
                assert frame.columns == docs().columns
        left.append(frame)
    found = collections.Counter(r["doc_id"] for r in left[0].collect())
    assert found == {1: 2, 2: 1, None: 1, 4: 1}
    assert left[1].count() == 0 and left[1].columns == left[0].columns


def test_registered_queries_have_names():
    from profseek.llm.oracles import ORACLES
    from profseek.llm.queries import REGISTRY

    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert set(ORACLES) <= set(REGISTRY)


def test_personal_data_goes_on_until_nothing_is_new(docs):
    """A chain of five contexts, each trusted once the identifier of the one before is known; and keys without support."""
    keys = [f"{k:031x}a" for k in range(10 ** 9, 10 ** 9 + 8)]
    rows, last = [], keys[7]
    for level in "abcde":
        fresh = f"ident-{level}-777"
        rows += [f"word{level} token{level} {v}" for v in (*keys[:7], last, fresh)]
        last = fresh
    lone = "0123456789abcdef0123456789abcdef"
    rows += [lone, "an unheard of " + lone[::-1]]
    found = {r["doc_id"]: r["spans"] for r in personal_data.found_spans(docs(*enumerate(rows)), doc_id="doc_id").collect()}
    assert [k for k in range(len(rows)) if not found[k]] == []


def test_queries_meet_regions_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(n, [float(x) for x in rng.normal(size=16)]) for n in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(tuple(r) for r in vector_search.nearest_neighbours(
        frame, every=10, params=vector_search.Params(region_rows=128, query_rows=size)).collect()) for size in (8, 8192)]
    assert found[0] == found[1] and len(found[0]) == 300
