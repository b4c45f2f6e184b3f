"""Byte-level BPE as a transducer built while it runs, and streamed decoding.

Encoding rests on one fact: a sequence of tokens is the BPE encoding of its text
exactly if every two neighbours are the encoding of theirs. So the tokens that
may follow one another form a nondeterministic transducer over bytes: a path is
at a token already complete and at a place inside the next one. Subsets of such
paths are made states when text first reaches them. A state emits what all of
its paths have in common, so tokens leave it after a lookahead that the longest
token bounds; at the end of a pre-token exactly one path is complete.

Decoding turns ids into bytes and bytes into characters with a UTF-8 state
machine that keeps unfinished characters between calls.

Null and empty texts give no tokens and the digest of nothing. Texts of any
length are encoded whole. Repeated rows give repeated results; an empty table
gives an empty one. Columns of the input beyond the id and the text are not
carried.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.llm.rows import without_cycle_search

#: Entries of the per-worker memories; a full one starts anew, which changes no result.
MEMO = 300_000
STRETCHES = 700_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: the leftmost pair of the lowest rank is merged until none is left."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _derivation(text: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes a token; None if merges never make it."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class _State:
    """Paths that text can be on; each is (complete token, place in the trie), with the tokens not yet emitted."""

    __slots__ = ("paths", "complete", "next")

    def __init__(self, paths):
        self.paths = paths
        self.complete = next((emitted for last, place, emitted in paths if place == 0), None)
        self.next: dict[int, tuple[_State, tuple[int, ...]] | None] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], states: int = MEMO):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.limit = states
        #: By token, outermost last: the parts at its left and right edge, each with the rank of the merge that ends it.
        self.left: dict[int, list[tuple[bytes, float]]] = {}
        self.right: dict[int, list[tuple[bytes, float]]] = {}
        self.uneven: set[int] = set()
        for text, rank in sorted(ranks.items(), key=lambda x: len(x[0])):
            if len(text) == 1:
                self.left[rank] = self.right[rank] = [(text, math.inf)]
            elif parts := _derivation(text, ranks):  # others are never the outcome of merges
                first, second = (ranks[x] for x in parts)
                self.left[rank] = [*self.left[first][:-1], (parts[0], rank), (text, math.inf)]
                self.right[rank] = [*self.right[second][:-1], (parts[1], rank), (text, math.inf)]
                if any(a[1] > b[1] for edge in (self.left[rank], self.right[rank]) for a, b in zip(edge, edge[1:])):
                    self.uneven.add(rank)
            else:
                continue
            self._add(text, rank)
        self.pairs: dict[tuple[int, int], bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((-1, 0, ()),))

    def _add(self, text: bytes, rank: int) -> None:
        place = 0
        for byte in text:
            nxt = self.children[place].get(byte)
            if nxt is None:
                nxt = self.children[place][byte] = len(self.children)
                self.children.append({})
                self.token_at.append(-1)
            place = nxt
        self.token_at[place] = rank

    def _state(self, paths: tuple) -> _State:
        state = self.states.get(paths)
        if state is None:
            state = self.states[paths] = _State(paths)
        return state

    def follows(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their text."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            if left in self.uneven or right in self.uneven:
                known = merge(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
            else:
                known = self._stay_apart(self.right[left], self.left[right])
            self.pairs[left, right] = known
        return known

    def _stay_apart(self, ends: list, starts: list) -> bool:
        """Whether no merge joins the edges while both sides merge on their own; of equal ranks the leftmost goes first."""
        i = j = 0
        while True:
            (a, ends_a), (b, ends_b) = ends[i], starts[j]
            across = self.ranks.get(a + b)
            if across is not None and across < ends_a and across <= ends_b:
                return False
            if ends_a == ends_b == math.inf:
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        moved, done = [], None
        for last, place, emitted in state.paths:
            nxt = self.children[place].get(byte)
            if nxt is None:
                continue
            if self.children[nxt]:
                moved.append((last, nxt, emitted))
            token = self.token_at[nxt]
            if token >= 0 and done is None and (last < 0 or self.follows(last, token)):
                done = (token, 0, (*emitted, token))
        if done is not None:
            moved.append(done)
        if not moved:
            raise ValueError("the ranks lack a byte")
        common = moved[0][2]
        for _, _, emitted in moved[1:]:
            k = 0
            while k < len(common) and k < len(emitted) and common[k] == emitted[k]:
                k += 1
            common = common[:k]
        n = len(common)
        out = self._state(tuple((last, place, emitted[n:]) for last, place, emitted in moved)), common
        state.next[byte] = out
        return out

    def encode(self, text: bytes) -> tuple[int, ...]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return (whole,)
        if len(self.states) >= self.limit:
            self._begin()
        state, out = self.start, []
        for byte in text:
            found = state.next.get(byte)
            state, emitted = found if found is not None else self._step(state, byte)
            out += emitted
        out += state.complete or ()
        return tuple(out)


#: Ranges of a second byte by first byte where not 80-BF; other continuation bytes are always 80-BF.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get characters; the state is the unfinished character."""

    def __init__(self) -> None:
        self.held = b""
        self.seen: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    def feed(self, data: bytes) -> str:
        key = (self.held, data)
        found = self.seen.get(key)
        if found is None:
            found = self._run(self.held, data)
            if len(self.seen) < MEMO and len(data) < 64:
                self.seen[key] = found
        text, self.held = found
        return text

    @staticmethod
    def _run(held: bytes, data: bytes) -> tuple[str, bytes]:
        out, pending = [], bytearray(held)
        for byte in data:
            if pending:
                low, high = _SECOND.get(pending[0], (0x80, 0xBF)) if len(pending) == 1 else (0x80, 0xBF)
                if low <= byte <= high:
                    pending.append(byte)
                    if len(pending) == 2 + (pending[0] >= 0xE0) + (pending[0] >= 0xF0):
                        out.append(pending.decode())
                        pending.clear()
                    continue
                out.append("�")
                pending.clear()
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                pending.append(byte)
            else:
                out.append("�")
        return "".join(out), bytes(pending)

    def finish(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


def _newer_characters() -> str:
    """Ranges of letters and numbers of this splitter that the reference library does not know yet."""
    from tiktoken import Encoding

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    single = {bytes([b]): b for b in range(256)}
    library = Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=single, special_tokens={})
    known = set(library.decode(library.encode_ordinary("".join(new))))
    ranges: list[list[int]] = []
    for code in sorted(ord(c) for c in new if c not in known):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: Stretches with at most one space before them; pieces of the splitting pattern lie inside one of these.
_STRETCHES = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: Separators that only _STRETCHES takes for white space.
_ODD_SPACE = "\x1c-\x1f"


class ByteBpe:
    """Encoder and decoder of one vocabulary; one per worker process.

    The pattern must be of the kind whose pieces are an optional space and
    characters other than white space, or white space alone.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        newer = _newer_characters()
        self.odd = re.compile(f"[{_ODD_SPACE}{newer}]").search
        self.split = regex.compile(pattern).findall
        known = [(rf"\p{{{k}}}", rf"[\p{{{k}}}--[{newer}]]") for k in "LN"]
        self.old_split = regex.compile(functools.reduce(lambda s, x: s.replace(*x), known, pattern),
                                       regex.V1).findall if newer else self.split
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.machine = Utf8Machine()
        size = max(self.transducer.bytes_of) + 1
        self.names = [str(i) for i in range(size)]
        self.text_of: list[str | None] = [None] * size
        for i, data in self.transducer.bytes_of.items():
            try:
                self.text_of[i] = data.decode()
            except UnicodeDecodeError:
                pass

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            ids = self.transducer.encode(piece.encode())
            if len(piece) < 64:
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.odd(text):
            for piece in self.old_split(text):
                out += self._piece(piece)
            return out
        memo = self.stretches
        for stretch in _STRETCHES(text):
            ids = memo.get(stretch)
            if ids is None:
                if len(memo) >= STRETCHES:
                    memo.clear()
                ids = tuple(i for piece in self.split(stretch) for i in self._piece(piece))
                if len(stretch) < 64:
                    memo[stretch] = ids
            out += ids
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Characters as they become complete, token by token; bytes that are no UTF-8 become U+FFFD."""
        bytes_of, text_of, machine = self.transducer.bytes_of, self.text_of, self.machine
        machine.held = b""
        for i in ids:
            text = None if machine.held else text_of[i]
            yield machine.feed(bytes_of[i]) if text is None else text
        yield machine.finish()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def encoded(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the tokens of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in without_cycle_search(batches):
            ids = [bpe.encode(v.as_py() or "") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decoded(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): texts of token sequences, through the streaming decoder."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in without_cycle_search(batches):
            texts = ["".join(bpe.decode_stream(v.as_py() or ())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.large_string()).cast(pa.string())],
                                             ["id", "text"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again in one pass."""

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in without_cycle_search(batches):
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256("".join(bpe.decode_stream(ids)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(trip, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("id", id_col)
