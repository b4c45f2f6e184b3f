"""Search parameters. Defaults are fixed values that results depend on."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Distance:
    """A limit given either as a count or as a fraction of the window length."""

    value: float
    fractional: bool = False

    @classmethod
    def parse(cls, text: str) -> "Distance":
        if "." in text:
            value = float(text)
            if value > 1.0:
                raise ValueError("invalid fractional distance greater than 1")
            return cls(value, True)
        if not text.lstrip("+").isdigit():
            raise ValueError("invalid integral distance")
        return cls(int(text), False)

    def absolute(self, total: int) -> int:
        return int(total * self.value) if self.fractional else int(self.value)

    def __str__(self) -> str:
        return repr(float(self.value)) if self.fractional else str(int(self.value))


@dataclass(frozen=True)
class SearchConfig:
    # null database
    db_shuffles: int | None = None
    db_block_size: int = 10
    db_in_block_shuffle: bool = False
    null_hsgs: int = 10_000
    seed: int = 42
    # profile values and reporting
    max_reactivity: float = 1.0
    max_align_overlap: float = 0.5
    inclusion_evalue: float = 0.01
    report_evalue: float = 0.1
    report_alignment: str | None = None  # "fasta" or "stockholm"
    report_reactivity: bool = False
    # window lookup
    min_kmers: int = 2
    max_kmer_dist: int = 30
    kmer_len: int = 15
    kmer_offset: int = 1
    match_kmer_gc_content: bool = False
    kmer_max_gc_diff: float | None = None
    match_kmer_seq: bool = False
    kmer_max_seq_dist: Distance | None = None
    kmer_min_complexity: float = 0.3
    kmer_max_match_every_nt: int = 200
    # alignment scores
    align_match_score: tuple[float, float] = (-0.5, 2.0)
    align_mismatch_score: tuple[float, float] = (-6.0, -0.5)
    align_gap_open_penalty: float = -14.0
    align_gap_ext_penalty: float = -5.0
    align_max_drop_off_rate: float = 0.8
    align_max_drop_off_bases: int = 8
    align_len_tolerance: float = 0.1
    align_score_seq: bool = False
    align_seq_match_score: float = 0.5
    align_seq_mismatch_score: float = -2.0
    # consensus folding of significant hits
    eval_align_fold: bool = False
    shuffles: int = 100
    block_size: int = 3
    in_block_shuffle: bool = False
    min_bp_support: float = 0.75
    ribosum_scoring: bool = False
    slope: float = 1.8
    intercept: float = -0.6
    max_bp_span: int = 600
    no_lonely_pairs: bool = False
    no_closing_gu: bool = False
    temperature: float = 37.0
    # physical design (no influence on results)
    tile_len: int = 8192
    query_block_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        if self.kmer_len < 1 or self.kmer_offset < 1 or self.db_block_size < 1 or self.block_size < 1:
            raise ValueError("kmer_len, kmer_offset and block sizes must be positive")
        if self.kmer_max_gc_diff is not None and not self.match_kmer_gc_content:
            raise ValueError("kmer_max_gc_diff requires match_kmer_gc_content")
        if self.kmer_max_seq_dist is not None and not self.match_kmer_seq:
            raise ValueError("kmer_max_seq_dist requires match_kmer_seq")
        if self.report_alignment not in (None, "fasta", "stockholm"):
            raise ValueError("report_alignment must be fasta or stockholm")
        if not 0.0 <= self.max_align_overlap <= 1.0:
            raise ValueError("max_align_overlap must lie in [0, 1]")

    @property
    def max_gc_diff(self) -> float | None:
        if not self.match_kmer_gc_content:
            return None
        if self.kmer_max_gc_diff is not None:
            return self.kmer_max_gc_diff
        return 0.2676 * math.exp(-0.053 * self.kmer_len)

    @property
    def max_seq_dist(self) -> int | None:
        return None if self.kmer_max_seq_dist is None else self.kmer_max_seq_dist.absolute(self.kmer_len)

    @property
    def group_gap(self) -> int:
        """Largest start-to-start distance of window hits that share a group."""
        return self.max_kmer_dist + self.kmer_len

    def replace(self, **changes) -> "SearchConfig":
        return dataclasses.replace(self, **changes)

    def to_toml(self) -> str:
        """Parameters as TOML with kebab-case keys; unset options are left out."""
        lines = []
        for field in dataclasses.fields(self):
            if field.name in ("tile_len", "query_block_bytes"):
                continue
            value = getattr(self, field.name)
            if value is None:
                continue
            if isinstance(value, bool):
                text = str(value).lower()
            elif isinstance(value, tuple):
                text = "[" + ", ".join(repr(float(v)) for v in value) + "]"
            elif isinstance(value, str):
                text = f'"{value}"'
            else:
                text = str(value)
            lines.append(f"{field.name.replace('_', '-')} = {text}")
        return "\n".join(lines) + "\n"
