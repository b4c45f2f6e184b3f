"""Nearest neighbours by adaptive dimension scans over an inverted list index.

Fitting, on a bounded sample (`Params.fit_rows` vectors, chosen by a hash of
their ids): a mean, a random rotation and the centroids of the lists. Indexing, of every
vector: its list, and per list column blocks of the rotated vectors, as seen from
the centroid and in single precision, beside the original ones. Lists are put together to regions of bounded size; a list that
holds more, because vectors repeat, is split over several regions.

A query probes the same part of the lists at every size, those of the nearest
centroids. In each it adds up squared
differences one column block at a time. After a block, the partial distance of a
random rotation estimates the whole; a candidate is abandoned when a hypothesis
test says that it lies beyond the k-th best so far, by more than what rounding
can hide; sums that overflow decide nothing. Survivors are measured in double
precision on the original vectors. Queries meet a region in blocks of
bounded size, for which the index is sent once each. The k best of every region are merged
per query.

Vectors that are null, zero, hold null or non-finite components, have no id or
another length than the most frequent one take no part. A query is compared with
every row but those of its own id; a repeated id may be found more than once.
Ties go to the smaller id. Empty tables give empty results; other columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profseek.llm.components import stored


@dataclass(frozen=True)
class Params:
    fit_rows: int = 20_000
    #: Lists are as many as the square root of the rows times this, and no more than a tenth of the sample.
    lists: float = 4.0
    #: Part of the lists that a query probes; data without clusters need many.
    probe: float = 0.5
    column_block: int = 16
    #: Width of the hypothesis test; larger abandons later.
    epsilon: float = 2.1
    region_rows: int = 2048
    #: Queries that meet a region at once, about; the index is sent once for each such block.
    query_rows: int = 65_536
    seed: int = 11


@dataclass
class Index:
    blocks: DataFrame
    mean: np.ndarray
    rotation: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    first_region: np.ndarray
    parts: np.ndarray


def usable(vector: Column) -> Column:
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(inf)))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): usable vectors of the most frequent length, in double precision."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def _centroids(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    sample = np.unique(sample, axis=0)
    n = min(n, len(sample))
    centres = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)]
    for _ in range(8):
        at = ((centres ** 2).sum(1) - 2 * sample @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        count = np.bincount(at, minlength=n)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, params: Params = Params()) -> Index | None:
    """Index of all `vectors`; None if there are none."""
    total = rows.count()
    if not total:
        return None
    sample = np.asarray([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(params.fit_rows).collect()])
    dims = sample.shape[1]
    mean = (sample / len(sample)).sum(axis=0)
    rotation = np.linalg.qr(np.random.default_rng(params.seed).normal(size=(dims, dims)))[0]
    n = int(min(max(1, params.lists * total ** 0.5), max(1, params.fit_rows // 10)))
    centres = _centroids(sample - mean, n, params.seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) - mean
            at = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())],
                                             ["id", "v", "list"])

    assigned = stored(rows.mapInArrow(assign, "id long, v array<double>, list long"), "assigned")
    sizes = np.zeros(len(centres), np.int64)
    for r in assigned.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, parts, region, room = np.zeros_like(sizes), np.ones_like(sizes), 0, params.region_rows
    for k, size in enumerate(sizes):
        parts[k] = -(-size // params.region_rows) or 1
        if parts[k] > 1 or size > room:
            region, room = region + 1, params.region_rows
        first[k] = region
        room -= size
        if parts[k] > 1:
            region, room = region + parts[k] - 1, 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy()
            spread = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            region = first[lists] + (spread % parts[lists].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region, pa.int64())],
                                             [*batch.schema.names, "region"])

    def blocks(table: pa.Table) -> pa.Table:
        lists = table.column("list").to_numpy()
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        order = np.lexsort((ids, lists))
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
            seen = (x[rows] - mean - centres[lists[rows[0]]]) @ rotation
            with np.errstate(over="ignore"):
                turned = seen.astype(np.float32).T
            out.append((int(table.column("region")[0].as_py()), int(lists[rows[0]]),
                        float(np.linalg.norm(seen, axis=1).max()), ids[rows].tobytes(),
                        [np.ascontiguousarray(turned[k:k + params.column_block]).tobytes()
                         for k in range(0, dims, params.column_block)], x[rows].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(
            (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.binary()))],
            ["region", "list", "reach", "ids", "columns", "originals"])

    dealt = assigned.mapInArrow(place, "id long, v array<double>, list long, region long")
    built = dealt.groupBy("region").applyInArrow(
        blocks, "region long, list long, reach double, ids binary, columns array<binary>, originals binary")
    return Index(stored(built, "vector-index"), mean, rotation, centres, sizes, first, parts)


class _Best:
    """The k nearest so far, by distance and id."""

    def __init__(self, k: int):
        self.k, self.ids, self.squares = k, np.empty(0, np.int64), np.empty(0)

    def bound(self) -> float:
        return float(self.squares[self.k - 1]) if len(self.ids) >= self.k else float("inf")

    def add(self, ids: np.ndarray, squares: np.ndarray) -> None:
        ids, squares = np.concatenate((self.ids, ids)), np.concatenate((self.squares, squares))
        order = np.lexsort((ids, squares))[:self.k]
        self.ids, self.squares = ids[order], squares[order]


def scan(best: _Best, own: int, query: np.ndarray, turned: np.ndarray, ids: np.ndarray, columns: list[np.ndarray],
         originals: np.ndarray, rounding: float, epsilon: float) -> int:
    """Add a list's candidates to `best`; returns how many had to be measured whole.

    `turned` and `columns` are seen from the list's centroid; `rounding` bounds
    what single precision adds to or takes from one of their distances.
    """
    dims, seen = len(query), 0
    alive = np.flatnonzero(ids != own)
    partial = np.zeros(len(alive), np.float32)
    for k, block in enumerate(columns):
        own_part = turned[seen:seen + len(block), None]
        part = block if len(alive) == block.shape[1] else block[:, alive]
        partial += ((part - own_part) ** 2).sum(axis=0)
        seen += len(block)
        if k == 0 and len(best.ids) < best.k and len(alive) > 4 * best.k:
            # no bound yet: measure those that begin nearest
            first = np.argpartition(partial, 2 * best.k)[:2 * best.k]
            rows = alive[first]
            best.add(ids[rows], ((originals[rows] - query) ** 2).sum(axis=1))
            rest = np.ones(len(alive), bool)
            rest[first] = False
            alive, partial = alive[rest], partial[rest]
        bound = best.bound()
        if seen < dims and bound < float("inf"):
            reach = bound ** 0.5 * (1 + epsilon / seen ** 0.5) * (seen / dims) ** 0.5 * (1 + 1e-5) + rounding
            stay = (partial <= reach * reach) | ~np.isfinite(partial)
            alive, partial = alive[stay], partial[stay]
        if not len(alive):
            return 0
    reach = best.bound() ** 0.5 * (1 + 1e-5) + rounding
    near = alive[(partial <= reach * reach) | ~np.isfinite(partial)]
    best.add(ids[near], ((originals[near] - query) ** 2).sum(axis=1))
    return len(near)


def search(index: Index, queries: DataFrame, k: int = 10, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; `queries` has id and v like `vectors`."""
    centres, sizes, mean, rotation = index.centroids, index.sizes, index.mean, index.rotation
    dims = len(rotation)
    n_probe = int(np.ceil(params.probe * len(centres)))
    turned_centres, far = centres @ rotation, np.linalg.norm(centres, axis=1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) - mean
            order = np.argsort((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1, kind="stable")
            row, region, lists = [], [], []
            for i in range(len(x)):
                # more lists where these hold fewer than k others
                enough = int(np.searchsorted(np.cumsum(sizes[order[i]]), k + 1)) + 1
                by_region: dict[int, list[int]] = {}
                for at in order[i][:max(n_probe, enough)]:
                    for r in range(index_first[at], index_first[at] + index_parts[at]):
                        by_region.setdefault(r, []).append(int(at))
                row += [i] * len(by_region)
                region += by_region.keys()
                lists += by_region.values()
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(region, pa.int64()),
                 pa.array(lists, pa.list_(pa.int64()))], ["query_id", "v", "region", "lists"])

    index_first, index_parts = index.first_region, index.parts

    def nearest(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        there = {}
        for r in blocks.select(["list", "reach", "ids", "columns", "originals"]).to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            there[r["list"]] = (ids, [np.frombuffer(c, np.float32).reshape(-1, len(ids)) for c in r["columns"]],
                                np.frombuffer(r["originals"], float).reshape(len(ids), dims), r["reach"])
        query_id, vec_id, score = [], [], []
        if not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        lists = asked.column("lists").combine_chunks()
        ends, lists = lists.offsets.to_numpy(), lists.values.to_numpy()
        queries = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for row, own in enumerate(asked.column("query_id").to_pylist()):
            query, best = queries[row], _Best(k)
            turned = (query - mean) @ rotation
            size = np.linalg.norm(turned)
            for at in lists[ends[row]:ends[row + 1]].tolist():
                if at in there:
                    ids, columns, originals, reach = there[at]
                    seen = turned - turned_centres[at]
                    rounding = 2.0 ** -21 * (reach + np.linalg.norm(seen)) + 2.0 ** -40 * (size + far[at])
                    scan(best, own, query, seen.astype(np.float32), ids, columns, originals, float(rounding),
                         params.epsilon)
            query_id += [own] * len(best.ids)
            vec_id.append(best.ids)
            score.append(np.sqrt(best.squares))
        return pa.Table.from_arrays(
            [pa.array(query_id, pa.int64()), pa.array(np.concatenate(vec_id) if vec_id else [], pa.int64()),
             pa.array(np.concatenate(score) if score else [], pa.float64())], ["query_id", "vec_id", "score"])

    parts = max(1, -(-queries.count() // params.query_rows))
    asked = queries.select("id", "v").mapInArrow(
        probe, "query_id long, v array<double>, region long, lists array<long>").withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    blocks = index.blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = blocks.groupBy("region", "part").cogroup(asked.groupBy("region", "part")).applyInArrow(
        nearest, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, k: int = 10, every: int = 100, params: Params = Params(), id_col: str = "vec_id",
                       vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`, among all rows."""
    rows = vectors(df, id_col, vector)
    index = build(rows, params)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return search(index, asked, k, params)
