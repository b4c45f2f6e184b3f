"""Quality rules, token counts, byte BPE, packing and chats against the libraries and plain Python."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import ODD_TEXTS

from profseek.llm import byte_bpe, chat, packing, quality, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_metrics(docs, sample_texts):
    texts = [*ODD_TEXTS, "a b c a b c d", "x\nx\n\n \nx y z", "# $ <>", *[t for _, t, _ in sample_texts[:60]]]
    rows = quality.judged(docs(*enumerate(texts))).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    for r in rows:
        want = plain_quality(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_keeps_columns_and_good_rows(docs):
    good = " ".join(f"the word{i} and x{i} of" for i in range(30))
    kept = quality.keep_good(docs((1, good), (1, good), (2, None), (3, "junk### " * 80), (4, good.upper())))
    assert kept.columns == docs().columns
    assert [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert quality.keep_good(docs()).count() == 0


def test_rules_compile_to_their_bounds(spark):
    rule = (quality.Rule("r", "m", low=1, high=2),)
    frame = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (2.5,)], "m double")
    assert [r[0] for r in frame.select(quality.passes(rule)).collect()] == [False, True, True, False]
    assert [r[0] for r in frame.select(quality.failed_rules(rule)).collect()] == [["r"], [], [], ["r"]]


def library_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, word_bpe, sample_texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe)
    texts = [*ODD_TEXTS, *[t for _, t, _ in sample_texts[:40]]]
    for r in token_counts.token_counts(docs(*enumerate(texts)), word_bpe, limit=50).collect():
        text = texts[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 50)
        assert r["n_whole"] <= n
    assert token_counts.token_counts(docs(), word_bpe).count() == 0


def test_whole_tokens_are_proved(word_bpe):
    from profseek.llm.word_tokens import word_tokens

    tokens = word_tokens(word_bpe)
    assert len(tokens.whole) > 30_000
    for text in list(tokens.whole)[::997]:
        assert struct.pack("<I", *library_ids(word_bpe, text)) == tokens.whole[text]


@pytest.fixture(scope="module")
def multi():
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN,
            tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def test_byte_bpe_round_trip(docs, multi, sample_texts):
    path, pattern, library = multi
    texts = [*ODD_TEXTS, *[t for _, t, _ in sample_texts[:40]]]
    frame = docs(*enumerate(texts))
    for r in byte_bpe.round_trip(frame, path, pattern).collect():
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    few = frame.filter("doc_id < 12")
    back = byte_bpe.decoded(byte_bpe.encoded(few, path, pattern), path, pattern)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: texts[i] or "" for i in range(12)}


def test_transducer_equals_merging(multi):
    path, pattern, _ = multi
    bpe = byte_bpe.byte_bpe(path, pattern)
    rng = np.random.default_rng(3)
    alphabet = [b"a", b"n", b"t", b"h", b"e", b" ", "é".encode(), "ß".encode(), b"\xff", b"1", b"ing"]
    for _ in range(400):
        text = b"".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(1, 40)))
        if text not in bpe.transducer.ranks:
            assert list(bpe.transducer.encode(text)) == byte_bpe.merge(text, bpe.transducer.ranks)


def test_utf8_machine_equals_incremental_decoder():
    import codecs

    data = "aé日😀".encode() + b"\xe6\x97x" + b"\xff\xc0" + b"\xed\xa0\x80" + "z".encode() + b"\xf0\x9f"
    for step in (1, 2, 3, 5):
        machine, plain = byte_bpe.Utf8Machine(), codecs.getincrementaldecoder("utf-8")("replace")
        parts = [data[k:k + step] for k in range(0, len(data), step)]
        got = "".join(map(machine.feed, parts)) + machine.finish()
        assert got == "".join(map(plain.decode, parts)) + plain.decode(b"", True)


def check_packing(rows, texts, limit, path):
    want = {}
    for i, text in enumerate(texts):
        ids = library_ids(path, text) + [1]
        for k in range(0, len(ids), limit):
            part = ids[k:k + limit]
            want[i, k // limit] = (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def best_fit(lengths, limit):
    """Sequences of plain best-fit decreasing, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - length)
        else:
            rooms.append(limit - length)
    return len(rooms)


@pytest.mark.parametrize("bucket", [2, packing.BUCKET])
def test_packing(docs, word_bpe, sample_texts, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    texts = [*ODD_TEXTS, *[t for _, t, _ in sample_texts]]
    rows = packing.packed_documents(docs(*enumerate(texts)), word_bpe, limit=512, with_ids=True).collect()
    n = check_packing(rows, texts, 512, word_bpe)
    assert n <= 1.01 * best_fit([r["length"] for r in rows], 512) + 1
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.packed_documents(docs(), word_bpe).count() == 0


def test_repeated_rows_are_packed_each(docs, word_bpe):
    rows = packing.packed_documents(docs((None, "a b"), (1, "a b"), (1, "a b")), word_bpe, limit=4).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.choice([7, 64, 400]))
    lengths = rng.integers(1, limit + 1, 3000 if seed else 5)
    histogram = dict(collections.Counter(lengths.tolist()))
    types = packing.plan(histogram, limit)
    used = collections.Counter()
    for n, runs in types:
        assert n > 0 and sum(a * k for a, k in runs) <= limit
        for a, k in runs:
            used[a] += n * k
    assert used == histogram
    assert sum(n for n, _ in types) <= 1.01 * best_fit(lengths.tolist(), limit) + 1


NASTY = ["", "a", "\\", "### user: x </turn>\n### y", "\\### z", "</turn>", " </turn>\n", "####", "\\\\</turn>", "é😀\n"]


def test_chat_reads_back(spark):
    rows = [(c, t, ["user", "assistant", "we:ird\\###"][(c + t) % 3], NASTY[(3 * c + t) % len(NASTY)])
            for c in range(7) for t in range(1 + 5 * c)]
    rows += [(None, 0, None, None), (None, None, "assistant", "n"), (99, 1, "assistant", "b"), (99, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.formatted(chat.linear_trees(frame))
    got = chats.select("tree.id", chat.read_back(chats["conversation"]).alias("turns"),
                       chat.masked_text(chats["conversation"], chats["loss_spans"]).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert {r["id"]: [tuple(t) for t in r["turns"]] for r in got} == dict(want)
    for r in got:
        assert r["loss"] == "".join(x for role, x in want[r["id"]] if role == "assistant")


def test_branches_of_trees(spark):
    rng = np.random.default_rng(5)
    rows, parent_of, score_of = [], {}, {}
    for tree in range(5):
        for node in range(40):
            parent = None if node == 0 else int(rng.integers(max(0, node - 4), node))
            parent_of[tree, node], score_of[tree, node] = parent, float(rng.integers(0, 9))
            rows.append((tree, node, parent, score_of[tree, node]))
    rows += [(9, 1, 2, 0.0), (9, 2, 1, 0.0), (9, 3, 77, None), (9, 4, 2, 1.0)]  # a cycle, a lost parent, one below the cycle
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.branches(frame, keep=3).collect():
        got[r["tree"], r["branch"]].append((r["place"], r["node"]))
    want = {}
    for tree in range(5):
        inner = {parent_of[tree, n] for n in range(40)}
        paths = []
        for leaf in set(range(40)) - inner:
            path, node = [], leaf
            while node is not None:
                path.append(node)
                node = parent_of[tree, node]
            paths.append((-sum(score_of[tree, n] for n in path), leaf, path[::-1]))
        for k, (_, _, path) in enumerate(sorted(paths)[:3], 1):
            want[tree, k] = list(enumerate(path))
    want[9, 1] = [(0, 3)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert chat.branches(frame.limit(0)).count() == 0
