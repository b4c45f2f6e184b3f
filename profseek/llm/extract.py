"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

The blocks of a page (dom.leaf_blocks) form a chain. Features of a block are the
elements around it by tag and by the parts of their class, id and role, and the
shape of its text: length, share of links, end, signs. A field with two labels is
fitted on labelled pages by gradient ascent on its likelihood, and Viterbi
decoding marks the blocks of the article, which are joined in page order.

The labelled pages are drawn from a seed (labelled_pages); their number is the
bound of the fit. The pages to extract are read whole, row by row, in the tasks.

A null or empty page has the empty text. Pages of any length are read whole, in
time in proportion to it. Repeated rows give repeated results; an empty table
gives an empty result. White space includes no-break spaces. A page without an
article, such as a list of links, has the empty text unless its blocks look like
one. Input columns beyond those named are not carried.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.llm.dom import Block, Element, leaf_blocks
from profseek.llm.labelled_pages import labelled_pages

#: Labelled pages of the fit, rounds and pull towards zero.
PAGES, ROUNDS, PULL = 900, 100, 2e-6
_PARTS_OF_PAGE = frozenset("article main section nav aside header footer form table ul ol div body".split())
_SENTENCE = re.compile(r"[.!?…:;)\"'»]")


def _around(element: Element) -> set[str]:
    """Features of the elements around a block, and of the part of the page that it is in."""
    found, part, at, named = {f"at {element.tag}", *(f"at .{n}" for n in element.names)}, None, element, False
    while at:
        found.add(f"in {at.tag}")
        if at.names and not named:
            found.update(f"near .{n}" for n in at.names)
            named = True
        found.update(f"in .{n}" for n in at.names)
        if part is None and at.tag in _PARTS_OF_PAGE:
            part = at
            found.update((f"part {at.tag}", *(f"part .{n}" for n in at.names)))
        at = at.parent
    if not named:
        found.add(f"plain {part.tag}")
    return found


def _shape(block: Block) -> list[str]:
    """Features of the text of a block."""
    size = min(7, (block.text.count(" ") + 1).bit_length() - 1)
    linked = block.linked / len(block.text)
    share = 0 if linked == 0 else 1 if linked < 0.5 else 2 if linked < 0.95 else 3
    found = [f"words {size}", f"links {share}", f"words {size} links {share}"]
    if _SENTENCE.search(block.text[-4:]):
        found.append("ends")
    if "©" in block.text:
        found.append("rights")
    if "|" in block.text or "»" in block.text:
        found.append("bars")
    return found


class Field:
    """Weights of a fitted field: one per feature for 'article' against 'other', and of the steps between labels."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.start, self.steps = weights, start.tolist(), steps.tolist()

    def decoded(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels of a chain."""
        weights, around = self.weights, {}

        def score(block: Block) -> float:
            if block.element not in around:
                around[block.element] = sum(weights.get(f, 0.0) for f in sorted(_around(block.element)))
            return around[block.element] + sum(weights.get(f, 0.0) for f in _shape(block))

        if not blocks:
            return []
        (oo, oa), (ao, aa) = self.steps
        other, article, back = self.start[0], self.start[1] + score(blocks[0]), []
        for block in blocks[1:]:
            gain = score(block)
            back.append((article + ao > other + oo, article + aa > other + oa))
            other, article = max(other + oo, article + ao), max(other + oa, article + aa) + gain
        label = article > other
        labels = [label]
        for from_other, from_article in reversed(back):
            label = from_article if label else from_other
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS, pull: float = PULL) -> Field:
    """Fit by Adam on the mean log-likelihood of whole chains, with all chains advanced at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    index, owner = [], []
    length = max(len(blocks) for blocks, _ in pages)
    truth = np.zeros((len(pages), length), int)
    real = np.zeros((len(pages), length), bool)
    for i, (blocks, labels) in enumerate(pages):
        for t, block in enumerate(blocks):
            found = [names.setdefault(f, len(names)) for f in sorted(_around(block.element)) + _shape(block)]
            index += found
            owner += [i * length + t] * len(found)
            truth[i, t], real[i, t] = labels[t], True
    index, owner = np.array(index), np.array(owner)
    total, pairs = real.sum(), real[:, 1:]
    params = np.zeros(len(names) + 6)  # weights, then start, then steps
    observed = np.bincount(index, truth.ravel()[owner], len(names))
    first = np.bincount(truth[:, 0], minlength=2)
    between = np.bincount((2 * truth[:, :-1] + truth[:, 1:])[pairs], minlength=4)
    target = np.concatenate([observed, first, between])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for round_ in range(1, rounds + 1):
        emission = np.zeros((len(pages), length, 2))
        emission[:, :, 1] = np.bincount(owner, params[index], len(pages) * length).reshape(len(pages), length)
        start, steps = params[-6:-4], params[-4:].reshape(2, 2)
        forward, backward = np.empty_like(emission), np.zeros_like(emission)
        forward[:, 0] = start + emission[:, 0]
        for t in range(1, length):
            over = forward[:, t - 1, :, None] + steps
            forward[:, t] = np.logaddexp(over[:, 0], over[:, 1]) + emission[:, t]
        for t in range(length - 2, -1, -1):
            over = steps + (emission[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(real[:, t + 1, None], np.logaddexp(over[:, :, 0], over[:, :, 1]), 0)
        last = real.sum(1) - 1
        ends = forward[np.arange(len(pages)), last]
        z = np.logaddexp(ends[:, 0], ends[:, 1])
        chance = np.exp(forward + backward - z[:, None, None]) * real[:, :, None]
        joint = np.exp(forward[:, :-1, :, None] + steps + (emission + backward)[:, 1:, None, :] - z[:, None, None, None])
        joint = (joint * pairs[:, :, None, None]).sum((0, 1)).ravel()
        expected = np.concatenate([np.bincount(index, chance[:, :, 1].ravel()[owner], len(names)),
                                   chance[:, 0].sum(0), joint])
        slope = (target - expected) / total - pull * params
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        params += 0.15 * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-8)
    return Field({f: float(params[k]) for f, k in names.items()}, params[-6:-4], params[-4:].reshape(2, 2))


def labelled_chains(count: int, seed: int) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of drawn pages; the serial words that carry the labels are taken out of the texts."""
    chains = []
    for page, truth in labelled_pages(count, seed):
        blocks, labels = [], []
        for block in leaf_blocks(page):
            marks = re.findall(r"\bb\d+b\b", block.text)
            if marks:
                text = " ".join(re.sub(r"\bb\d+b\b", " ", block.text).split())
                blocks.append(block._replace(text=text, linked=min(block.linked, len(text))))
                labels.append(truth[marks[0]])
        chains.append((blocks, labels))
    return chains


@functools.cache
def field(pages: int = PAGES, seed: int = 0) -> Field:
    """The field fitted on that many labelled pages, once per process."""
    return fit(labelled_chains(pages, seed))


def main_text(page: str, model: Field) -> str:
    blocks = list(leaf_blocks(page))
    return "\n\n".join(b.text for b, wanted in zip(blocks, model.decoded(blocks)) if wanted)


def extracted(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
              model: Field | None = None) -> DataFrame:
    """The kept columns, the main text and its code points."""
    model = model or field()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", model) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[1:], "main_text", "text_chars"])

    names = [f"kept_{k}" for k in range(len(keep))]
    narrow = df.select(F.col(html).alias("page"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    kinds = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)
    done = narrow.mapInArrow(work, f"{kinds}, main_text string, text_chars long")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("main_text").alias("text"),
                       F.col("text_chars").alias("n_chars"))
