"""Tokens of a word BPE, one pre-token at a time.

A text is normalised and split as the vocabulary file says; each distinct
pre-token is settled once per worker. Vocabulary strings that were shown to
encode alone as one token are known beforehand, the library merges the rest.
Texts with characters on which Unicode versions differ go to the library whole.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata

import regex

# The splitting pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose case or class changed in recent Unicode versions, all beyond the first plane, and separators
#: that only Python takes for white space.
_UNSETTLED = re.compile(r"[\x1c-\x1f\u1c89-\u1c8f\ua7cb-\ua7df\U00010000-\U0010ffff]")
#: Entries of the per-worker memories; what comes later is computed each time, which changes no result.
MEMO = 600_000


class Memo(dict):
    """Results of a function by key, bounded; frequent keys come early and stay."""

    def __init__(self, compute, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        out = self.compute(key)
        if len(self) < self.limit and len(key) < 64:
            self[key] = out
        return out


class WordTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(PATTERN).findall
        self.byte_names = {b: c for c, b in _byte_characters().items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.whole = {s: struct.pack("<I", i) for s, i in self._whole_tokens().items()}
        self.ids = Memo(self._ids)
        self.counts = Memo(self._count)

    def _whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings that, standing as a pre-token, encode as exactly their one token."""
        characters = _byte_characters()
        suffix = "</w>"
        strings = []
        for token in self.library.get_vocab(with_added_tokens=False):
            if not token.endswith(suffix):
                continue
            try:
                text = bytes(characters[c] for c in token[:-len(suffix)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and not _UNSETTLED.search(text) and self.split(normal(text)) == [text]:
                strings.append(text)
        found = self.library.encode_batch(strings, add_special_tokens=False)
        return {s: e.ids[0] for s, e in zip(strings, found, strict=True) if len(e.ids) == 1}

    def _merge(self, piece: str) -> bytes:
        """Ids of a pre-token that is no whole token: the library's merges."""
        found = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.byte_names))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _ids(self, word: str) -> bytes:
        """Ids of a run without white space; pre-tokens never cross white space."""
        if word.isalpha():  # one pre-token
            return self.whole.get(word) or self._merge(word)
        pieces = self.split(word)
        if len(pieces) == 1:
            return self.whole.get(word) or self._merge(word)
        return b"".join([self.whole.get(p) or self.ids[p] for p in pieces])

    def _count(self, word: str) -> int:
        """Tokens of a run without white space; in the upper half those that needed no merging."""
        pieces = [word] if word.isalpha() else self.split(word)
        if len(pieces) == 1:
            return 1 << 32 | 1 if word in self.whole else len(self._merge(word)) // 4
        return sum(map(self.counts.__getitem__, pieces))

    def _parts(self, text: str) -> list[str] | None:
        """Texts and, at odd places, special strings between them; None if the library must read the text itself."""
        if _UNSETTLED.search(text):
            return None
        return self.special_at.split(text) if any(s in text for s in self.special) else [text]

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; special strings in it are their token, as the library does by default."""
        parts = self._parts(text)
        if parts is None:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out.extend(map(self.ids.__getitem__, normal(part).split()))
        return b"".join(out)

    def count(self, text: str) -> tuple[int, int]:
        """Tokens of a whole text, and how many of them are pre-tokens that needed no merging."""
        parts = self._parts(text)
        if parts is None:
            return len(self.library.encode(text, add_special_tokens=False).ids), 0
        total = sum(sum(map(self.counts.__getitem__, normal(part).split())) for part in parts[::2])
        return (total & 0xFFFFFFFF) + len(parts) // 2, total >> 32


def normal(text: str) -> str:
    """Normalised text but for its white space."""
    # lower() looks at the neighbours of a capital sigma only; the library maps each character alone
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker process and vocabulary."""
    return WordTokens(path)
