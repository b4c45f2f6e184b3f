"""Window similarity join: query windows against every window of every target.

The join is a block nested loop. Spark partitions the tiles; each task meets
every block of query windows as one matrix product per piece. Blocks are a
broadcast when the checked size of the queries allows, else Parquet files in the
shared folder that tasks read one at a time. The database is never shuffled.

A target inside one tile is decided in one pass. A longer target needs its
distance moments from all tiles first: they are summed per (window, target) and
joined back as thresholds, and the hit counts of the promiscuity rule likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import checkpointed, filesystem, fresh_path, sliced
from profseek.operators.tiles import TiledDb, balanced, stretch
from profseek.schema import MISSING_SENTINEL

CELLS_PER_STEP = 500_000  # distances held at once by a task
SIGMAS = 3.0
SALTS = 256  # places a long target may spread over
MOMENT_BYTES = 8 << 20  # of sums held by a task
HELD_BYTES = 32 << 20  # of Arrow batches that meet a stored block together
MANY_TILES = 65_536  # beyond this many tiles the sums of a target meet in two steps


@dataclass
class QueryBlocks:
    """Query windows as numpy blocks: broadcast, or files read one by one."""

    broadcast: object | None
    paths: list[str]

    def only(self, spark, names: set[str]) -> QueryBlocks:
        """The windows of those queries, of a block in memory."""
        block = self.broadcast.value
        if block is not None:
            keep = np.isin(block["query"], [i for i, name in enumerate(block["ids"].to_pylist()) if name in names])
            block = None if not keep.any() else {
                **{k: block[k][keep] for k in ("query", "q_pos", "q_len", "bases", "gc")}, "ids": block["ids"],
                "normal": np.ascontiguousarray(block["normal"][:, keep])}
        return QueryBlocks(spark.sparkContext.broadcast(block), [])

    def __len__(self) -> int:
        return 1 if self.broadcast is not None else len(self.paths)

    def read(self, no: int) -> dict | None:
        """Block `no`; none if it has no usable window."""
        if self.broadcast is not None:
            return self.broadcast.value
        import pyarrow.dataset as ds

        fs, path = filesystem(self.paths[no])
        return _block(ds.dataset(path, filesystem=fs, format="parquet").to_table())

    def meet(self, batches, prepare, wanted=None) -> Iterator[tuple]:
        """(batch, prepare(batch), block number, block) for all batches and blocks.

        A block in memory meets each batch as it comes. Stored blocks are read once for
        all batches that make up HELD_BYTES, so reads follow the bytes of a task and
        not its batches. `wanted(batch)` names the only blocks that a batch needs.
        """
        held, size = [], 0
        for batch in sliced(batches):
            held.append((batch, prepare(batch), None if wanted is None else wanted(batch)))
            size += batch.nbytes
            if self.broadcast is not None or size >= HELD_BYTES:
                yield from self._pairs(held)
                held, size = [], 0
        yield from self._pairs(held)

    def _pairs(self, held: list[tuple]) -> Iterator[tuple]:
        for no in range(len(self)):
            met = [(batch, made) for batch, made, only in held if only is None or no in only]
            block = self.read(no) if met else None
            if block is not None:
                for batch, made in met:
                    yield batch, made, no, block


def _block(table: pa.Table) -> dict | None:
    """Pack windows: z-normalised values, positions, base codes and GC fractions."""
    table = table.sort_by([("query_id", "ascending"), ("q_pos", "ascending")]).combine_chunks()
    if table.num_rows == 0:
        return None
    values = table["values"].combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(table.num_rows, -1)
    sigma = matrix.std(axis=1)
    usable = sigma > 0.0  # a flat window has no finite distance, hence no hits
    table, matrix, sigma = table.filter(pa.array(usable)), matrix[usable], sigma[usable]
    if table.num_rows == 0:
        return None
    normal = (matrix - matrix.mean(axis=1)[:, None]) / sigma[:, None]
    ids = table["query_id"].combine_chunks().dictionary_encode()
    letters = "".join(table["window_bases"].to_pylist()).encode()
    codes = np.frombuffer(letters, dtype=np.uint8).reshape(table.num_rows, -1)
    return {
        "normal": np.ascontiguousarray(normal.T), "ids": ids.dictionary, "query": ids.indices.to_numpy(),
        "q_pos": table["q_pos"].to_numpy(), "q_len": table["q_len"].to_numpy(), "bases": codes,
        "gc": np.isin(codes, (ord("C"), ord("G"))).mean(axis=1),
    }


def prepare_blocks(windows: DataFrame, query_cells: int, cfg) -> QueryBlocks:
    """`query_cells` is the total length of the queries, which bounds the windows."""
    spark = windows.sparkSession
    size = query_cells * (cfg.kmer_len * 9 + 64)
    if size <= cfg.query_block_bytes:
        return QueryBlocks(spark.sparkContext.broadcast(_block(windows.toArrow())), [])
    n = -(-size // cfg.query_block_bytes)
    path = fresh_path(spark, "query-blocks")
    (windows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
     .repartition(int(n), "block").write.partitionBy("block").parquet(path))
    found = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct()
    folders = found.select(F.regexp_replace("f", "/[^/]+$", "").alias("d")).distinct().orderBy("d")
    return QueryBlocks(None, [r["d"] for r in folders.toLocalIterator()])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class _Tiles:
    """One Arrow batch of tiles with its windows normalised piece by piece."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        lists = batch.column("reactivity")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.raw = values
        filled = np.where(np.isnan(values), MISSING_SENTINEL, values)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.offsets = offsets - offsets[0]
        lens = np.diff(self.offsets)
        core = batch.column("core").to_numpy()
        self.counts = np.clip(np.minimum(core, lens - k + 1), 0, None)
        self.tile_start = batch.column("tile_start").to_numpy()
        self.target_len = batch.column("target_len").to_numpy()
        self.bases = np.frombuffer("".join(batch.column("bases").to_pylist()).encode(), dtype=np.uint8)
        self.k, self.filled = k, filled

    def pieces(self, n_kmers: int) -> Iterator[tuple[int, int]]:
        """Consecutive rows whose windows fit one step."""
        limit = max(1, CELLS_PER_STEP // max(1, min(n_kmers, 4096)))
        first, held = 0, 0
        for row, count in enumerate(self.counts):
            if held and held + count > limit:
                yield first, row
                first, held = row, 0
            held += int(count)
        if first < len(self.counts):
            yield first, len(self.counts)

    def windows(self, lo: int, hi: int):
        """Normalised windows of the rows, their start cells, and rows; flat windows left out."""
        counts = self.counts[lo:hi]
        cells = _ranges(self.offsets[lo:hi], counts)
        rows = np.repeat(np.arange(lo, hi), counts)
        if not len(cells):
            return None
        view = np.lib.stride_tricks.sliding_window_view(self.filled, self.k)[cells]
        mean = view.mean(axis=1)
        centred = view - mean[:, None]
        sigma = np.sqrt(np.einsum("ij,ij->i", centred, centred) / self.k)
        keep = sigma > 0.0
        if not keep.any():
            return None
        return centred[keep] / sigma[keep][:, None], cells[keep], rows[keep]


def _distances(normal_windows: np.ndarray, normal_kmers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    squared = normal_windows @ normal_kmers
    squared *= -2.0
    squared += 2.0 * k
    np.abs(squared, out=squared)
    return np.sqrt(squared), squared


def _moments(dist: np.ndarray, squared: np.ndarray, starts: np.ndarray):
    return np.add.reduceat(dist, starts, axis=0), np.add.reduceat(squared, starts, axis=0)


def _limits(n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """mean - 3 sigma (sample); a single window gives NaN, which nothing passes."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = s1 / n
        variance = np.maximum(s2 - n * mean * mean, 0.0) / (n - 1)
        return mean - SIGMAS * np.sqrt(np.where(n > 1, variance, np.nan))


def _steps(n_kmers: int, n_windows: int) -> Iterator[slice]:
    width = max(1, CELLS_PER_STEP // max(1, n_windows))
    for at in range(0, n_kmers, width):
        yield slice(at, min(at + width, n_kmers))


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return starts, rows[starts]


def _piece_hits(tiles: _Tiles, lo: int, hi: int, block: dict, cfg, fixed: np.ndarray | None):
    """Hits of one piece as (kmer, row, target position) after the filters of short targets."""
    found = tiles.windows(lo, hi)
    if found is None:
        return None
    normal, cells, rows = found
    starts, row_ids = _runs(rows)
    sizes = np.diff(np.r_[starts, len(rows)])
    kmers, where = [], []
    for step in _steps(block["normal"].shape[1], len(rows)):
        dist, squared = _distances(normal, block["normal"][:, step], cfg.kmer_len)
        if fixed is None:
            s1, s2 = _moments(dist, squared, starts)
            limit = _limits(sizes[:, None].astype(np.float64), s1, s2)
            passing = dist <= np.repeat(limit, sizes, axis=0)
        else:
            passing = dist <= np.repeat(fixed[row_ids][:, step], sizes, axis=0)
        at, kmer = np.nonzero(passing)
        kmer += step.start
        if fixed is None and len(at):
            group = np.searchsorted(row_ids, rows[at]) * block["normal"].shape[1] + kmer
            _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
            length = tiles.target_len[rows[at]]
            ok = length // count[inverse] >= np.minimum(cfg.kmer_max_match_every_nt, length)
            at, kmer = at[ok], kmer[ok]
        kmers.append(kmer)
        where.append(at)
    kmer, at = np.concatenate(kmers), np.concatenate(where)
    row = rows[at]
    d_pos = cells[at] - tiles.offsets[row] + tiles.tile_start[row]
    if fixed is None:
        ok = _base_filters(tiles, cells[at], block, kmer, cfg)
        kmer, row, d_pos = kmer[ok], row[ok], d_pos[ok]
    return kmer, row, d_pos


def _base_filters(tiles: _Tiles, cell: np.ndarray, block: dict, kmer: np.ndarray, cfg) -> np.ndarray:
    """Hamming and GC limits; applied after the promiscuity rule."""
    ok = np.ones(len(kmer), dtype=bool)
    if not len(kmer) or (cfg.max_seq_dist is None and cfg.max_gc_diff is None):
        return ok
    target = np.lib.stride_tricks.sliding_window_view(tiles.bases, tiles.k)[cell]
    if cfg.max_seq_dist is not None:
        ok &= (target != block["bases"][kmer]).sum(axis=1) <= cfg.max_seq_dist
    if cfg.max_gc_diff is not None:
        gc = np.isin(target, (ord("C"), ord("G"))).mean(axis=1)
        ok &= np.abs(gc - block["gc"][kmer]) <= cfg.max_gc_diff
    return ok


def _hit_batch(batch: pa.RecordBatch, block: dict, hits) -> pa.RecordBatch:
    kmer, row, d_pos = hits
    take = pa.array(row)
    return pa.RecordBatch.from_pydict({
        "query_id": block["ids"].take(pa.array(block["query"][kmer])),
        "target_id": batch.column("target_id").take(take),
        "target_ord": batch.column("target_ord").take(take),
        "q_pos": pa.array(block["q_pos"][kmer].astype(np.int64)), "d_pos": pa.array(d_pos.astype(np.int64)),
    })


def _island_batch(batch: pa.RecordBatch, tiles: _Tiles, block: dict, hits, cfg) -> pa.RecordBatch | None:
    """Runs of hits per diagonal, with the part of the target an extension can reach."""
    kmer, row, d_pos = hits
    if not len(kmer):
        return None
    query, q_pos = block["query"][kmer], block["q_pos"][kmer]
    diag = q_pos - d_pos
    order = np.lexsort((q_pos, diag, query, row))
    query, q_pos, diag, row, q_len = query[order], q_pos[order], diag[order], row[order], block["q_len"][kmer][order]
    new = np.r_[True, (row[1:] != row[:-1]) | (query[1:] != query[:-1]) | (diag[1:] != diag[:-1])
                | (q_pos[1:] > q_pos[:-1] + cfg.group_gap)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    count = last - first + 1
    enough = count >= cfg.min_kmers
    first, last, count = first[enough], last[enough], count[enough]
    if not len(first):
        return None
    row, q_first, q_last, diag, q_len = row[first], q_pos[first], q_pos[last], diag[first], q_len[first]
    d_first, d_end = q_first - diag, q_last - diag + cfg.kmer_len
    up = q_first + np.floor(q_first * cfg.align_len_tolerance + 0.5).astype(np.int64)
    room = np.maximum(q_len - q_last - cfg.kmer_len, 0)
    down = room + np.floor(room * cfg.align_len_tolerance + 0.5).astype(np.int64)
    lo = np.maximum(d_first - up, 0)
    hi = np.minimum(d_end + down, tiles.target_len[row])
    cells = _ranges(tiles.offsets[row] + lo, hi - lo)
    bounds = np.r_[0, np.cumsum(hi - lo)].astype(np.int32)
    values = tiles.raw[cells]
    letters = tiles.bases[cells].tobytes()
    take = pa.array(row)
    return pa.RecordBatch.from_pydict({
        "query_id": block["ids"].take(pa.array(block["query"][kmer][order][np.flatnonzero(new)[enough]])),
        "target_id": batch.column("target_id").take(take), "target_ord": batch.column("target_ord").take(take),
        "target_len": pa.array(tiles.target_len[row].astype(np.int64)),
        "diag": pa.array(diag.astype(np.int64)), "q_first": pa.array(q_first.astype(np.int64)),
        "q_last": pa.array(q_last.astype(np.int64)), "n_kmers": pa.array(count.astype(np.int64)),
        "t_from": pa.array(lo.astype(np.int64)),
        "t_bases": pa.array([letters[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
        "t_values": pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, mask=np.isnan(values))),
    })


HIT_DDL = "query_id string, target_id string, target_ord long, q_pos long, d_pos long"
REACHED_DDL = ("query_id string, target_id string, target_ord long, target_len long, diag long, q_first long, "
               "q_last long, n_kmers long, t_from long, t_bases string, t_values array<double>")
PROFILE_DDL = ("query_id string, q_pos long, target_id string, target_ord long, d_pos array<long>, "
               "dist array<double>")
MOMENT_DDL = ("target_id string, target_ord long, block long, n long, last_tile long, s1 array<double>, "
              "s2 array<double>")


def _kernel_input(tiles: DataFrame, cfg) -> DataFrame:
    return tiles.withColumn("tile_start", F.col("tile") * F.lit(cfg.tile_len))


def _map_pieces(source: DataFrame, blocks: QueryBlocks, cfg, ddl: str, emit) -> DataFrame:
    """Run `emit(batch, tiles, lo, hi, block_no, block)` over all pieces and blocks."""

    def run(batches):
        for batch, tiles, block_no, block in blocks.meet(batches, lambda b: _Tiles(b, cfg.kmer_len)):
            for lo, hi in tiles.pieces(block["normal"].shape[1]):
                out = emit(batch, tiles, lo, hi, block_no, block)
                if out is not None and out.num_rows:
                    yield out

    return source.mapInArrow(run, ddl)


def distance_profiles(db: TiledDb, blocks: QueryBlocks, cfg) -> DataFrame:
    """Distances of each query window to all windows of each target tile, with their places in the target.

    Windows without spread have no distance and are left out. A row holds at most
    one tile, and what a task holds is bounded by a step of the join.
    """

    def run(batches):
        for batch, tiles, _, block in blocks.meet(batches, lambda b: _Tiles(b, cfg.kmer_len)):
            for lo, hi in tiles.pieces(block["normal"].shape[1]):
                found = tiles.windows(lo, hi)
                if found is None:
                    continue
                normal, cells, rows = found
                starts, row_ids = _runs(rows)
                sizes = np.diff(np.r_[starts, len(rows)])
                place = cells - tiles.offsets[rows] + tiles.tile_start[rows]
                for step in _steps(block["normal"].shape[1], len(rows)):
                    dist, _ = _distances(normal, block["normal"][:, step], cfg.kmer_len)
                    width = dist.shape[1]
                    bounds = pa.array(np.r_[0, np.cumsum(np.tile(sizes, width))].astype(np.int32))
                    take = pa.array(np.tile(row_ids, width))
                    kmer = np.repeat(np.arange(step.start, step.start + width), len(row_ids))
                    yield pa.RecordBatch.from_pydict({
                        "query_id": block["ids"].take(pa.array(block["query"][kmer])),
                        "q_pos": pa.array(block["q_pos"][kmer].astype(np.int64)),
                        "target_id": batch.column("target_id").take(take),
                        "target_ord": batch.column("target_ord").take(take),
                        "d_pos": pa.ListArray.from_arrays(bounds, pa.array(np.tile(place, width).astype(np.int64))),
                        "dist": pa.ListArray.from_arrays(bounds, pa.array(dist.T.ravel()))})

    return _kernel_input(db.tiles, cfg).mapInArrow(run, PROFILE_DDL)


def _short(db: TiledDb, cfg) -> DataFrame:
    tiles = _kernel_input(db.tiles, cfg)
    return tiles.where(F.col("target_len") <= cfg.tile_len) if db.has_long else tiles


class _Sums:
    """Moments of (target, block) as arrays over the windows of the block, added up."""

    def __init__(self) -> None:
        self.held: dict[tuple, list] = {}
        self.bytes = 0

    def add(self, key: tuple, n: int, last_tile: int, s1: np.ndarray, s2: np.ndarray) -> None:
        if key in self.held:
            sums = self.held[key]
            sums[0] += n
            sums[1] = max(sums[1], last_tile)
            sums[2] += s1
            sums[3] += s2
        else:
            self.held[key] = [n, last_tile, s1.copy(), s2.copy()]
            self.bytes += s1.nbytes + s2.nbytes

    def batch(self) -> pa.RecordBatch:
        keys, sums = list(self.held), list(self.held.values())
        self.held, self.bytes = {}, 0
        bounds = pa.array(np.r_[0, np.cumsum([len(s[2]) for s in sums])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([s[i] for s in sums] or [np.empty(0)])))
                 for i in (2, 3)]
        column = lambda rows, i, kind: pa.array([r[i] for r in rows], kind)
        return pa.RecordBatch.from_arrays(
            [column(keys, 0, pa.string()), column(keys, 1, pa.int64()), column(keys, 2, pa.int64()),
             column(sums, 0, pa.int64()), column(sums, 1, pa.int64()), *lists],
            ["target_id", "target_ord", "block", "n", "last_tile", "s1", "s2"])


def _merged_moments(partial: DataFrame, *salt: str) -> DataFrame:
    """One array per (target, block), or per (target, block, salt), from sorted streams."""
    keys = ["target_id", "target_ord", "block", *salt]

    def run(batches):
        sums, at = _Sums(), None
        for batch in sliced(batches):
            lists = [batch.column(c) for c in ("s1", "s2")]
            marks = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            n, last = batch.column("n").to_pylist(), batch.column("last_tile").to_pylist()
            for i, mark in enumerate(marks):
                if mark != at and sums.bytes > MOMENT_BYTES:
                    yield sums.batch()
                at = mark
                sums.add(mark[:3], n[i], last[i], *[x[i].values.to_numpy(zero_copy_only=False) for x in lists])
        if sums.held:
            yield sums.batch()

    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, MOMENT_DDL)


def moment_arrays(db: TiledDb, tiles: DataFrame, blocks: QueryBlocks, cfg) -> DataFrame:
    """Count, sums and sums of squares of the finite distances per (target, block), arrays over the block's windows.

    A task adds up the tiles of a target that it has, in their order, and an array leaves
    it for each target and block. Arrays of a target with very many tiles meet in two steps.
    """

    def prepare(batch):
        return _Tiles(batch, cfg.kmer_len), *[batch.column(c).to_pylist() for c in ("target_id", "target_ord", "tile")]

    def run(batches):
        sums = _Sums()
        for _, (mine, ids, ords, numbers), block_no, block in blocks.meet(batches, prepare):
            for lo, hi in mine.pieces(block["normal"].shape[1]):
                found = mine.windows(lo, hi)
                if found is None:
                    continue
                normal, _, rows = found
                starts, row_ids = _runs(rows)
                sizes = np.diff(np.r_[starts, len(rows)])
                parts = [_moments(*_distances(normal, block["normal"][:, step], cfg.kmer_len), starts)
                         for step in _steps(block["normal"].shape[1], len(rows))]
                s1, s2 = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts], 1)
                for j, row in enumerate(row_ids):
                    sums.add((ids[row], ords[row], block_no), int(sizes[j]), numbers[row], s1[j], s2[j])
                if sums.bytes > MOMENT_BYTES:
                    yield sums.batch()
        if sums.held:
            yield sums.batch()

    ordered = _kernel_input(tiles, cfg).sortWithinPartitions("target_id", "target_ord", "tile")
    partial = ordered.mapInArrow(run, MOMENT_DDL)
    if db.cells // cfg.tile_len > MANY_TILES:
        partial = _merged_moments(partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "salt")
    return _merged_moments(partial)


def distance_moments(db: TiledDb, tiles: DataFrame, blocks: QueryBlocks, cfg) -> DataFrame:
    """The same with one row per (window, target)."""
    both = F.arrays_zip("s1", "s2")
    return moment_arrays(db, tiles, blocks, cfg).select(
        "target_id", "target_ord", "block", "n", "last_tile", F.posexplode(both).alias("kmer", "s")).select(
        "target_id", "target_ord", "block", F.col("kmer").cast("long").alias("kmer"), "n", "last_tile", "s.s1", "s.s2")


def _limit(s1, s2):
    n, mean = F.col("n").cast("double"), s1 / F.col("n")
    variance = F.greatest(s2 - n * mean * mean, F.lit(0.0)) / F.when(n > 1, n - 1)
    return mean - SIGMAS * F.sqrt(variance)


def window_stats(db: TiledDb, blocks: QueryBlocks, names: DataFrame, cfg) -> DataFrame:
    """Mean, sigma and threshold per (query window, target)."""
    n, mean = F.col("n").cast("double"), F.col("s1") / F.col("n")
    sigma = F.sqrt(F.greatest(F.col("s2") - n * mean * mean, F.lit(0.0)) / F.when(n > 1, n - 1))
    moments = distance_moments(db, db.tiles, blocks, cfg).withColumn("limit", _limit(F.col("s1"), F.col("s2")))
    return moments.join(names, ["block", "kmer"]).select(
        "query_id", "q_pos", "target_id", "target_ord", "n", mean.alias("mean_dist"), sigma.alias("sd_dist"), "limit")


def kmer_names(blocks: QueryBlocks, spark) -> DataFrame:
    """(block, kmer) numbers of the packed windows with their query and position."""

    def run(batches):
        for batch in batches:
            for no in batch.column("block").to_pylist():
                block = blocks.read(no)
                if block is not None:
                    n = len(block["q_pos"])
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array(np.full(n, no, np.int64)), "kmer": pa.array(np.arange(n)),
                        "query_id": block["ids"].take(pa.array(block["query"])),
                        "q_pos": pa.array(block["q_pos"].astype(np.int64))})

    return spark.range(len(blocks)).withColumnRenamed("id", "block").mapInArrow(
        run, "block long, kmer long, query_id string, q_pos long")


def long_hits(db: TiledDb, blocks: QueryBlocks, cfg) -> DataFrame:
    """Hits in targets of several tiles, with thresholds and counts taken over the whole target."""
    tiles = db.tiles.where(F.col("target_len") > cfg.tile_len)
    moments = moment_arrays(db, tiles, blocks, cfg)
    key = ["target_id", "target_ord"]
    # the thresholds of a target go to at most SALTS places, each stretch of its tiles to one of them
    salts = F.sequence(F.lit(0).cast("long"), F.least(stretch(F.col("last_tile"), cfg) + 1, F.lit(SALTS)) - 1)
    limits = moments.select(*key, "block", F.zip_with("s1", "s2", _limit).alias("limits"), F.explode(salts).alias("salt"))
    salted = _kernel_input(tiles, cfg).withColumn("salt", stretch(F.col("tile"), cfg) % SALTS)
    # both sides are spread before they meet: their join copies the thresholds to every tile
    joined = balanced(salted, db.cells, *key, "salt").join(balanced(limits, db.cells, *key, "salt"), [*key, "salt"]).drop("salt")

    def run(batches):
        own = lambda batch: set(pc.unique(batch.column("block")).to_pylist())
        for batch, _, block_no, block in blocks.meet(batches, lambda b: None, own):
            mine = batch.filter(pc.equal(batch.column("block"), block_no))
            tile_set = _Tiles(mine, cfg.kmer_len)
            lists = mine.column("limits")
            fixed = lists.flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1)
            for lo, hi in tile_set.pieces(block["normal"].shape[1]):
                hits = _piece_hits(tile_set, lo, hi, block, cfg, fixed)
                if hits is None or not len(hits[0]):
                    continue
                kmer, row, d_pos = hits
                cell = tile_set.offsets[row] + d_pos - tile_set.tile_start[row]
                ok = _base_filters(tile_set, cell, block, kmer, cfg)
                out = _hit_batch(mine, block, hits)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ok)], names=[*out.schema.names, "ok"])

    # counted and filtered below: written once rather than computed twice
    raw = checkpointed(joined.mapInArrow(run, HIT_DDL + ", ok boolean"))
    lens = tiles.where("tile = 0").select(*key, "target_len")
    crowd = raw.groupBy("query_id", *key, "q_pos").agg(F.count(F.lit(1)).alias("n_hits")).join(lens, key)
    crowded = crowd.where(F.floor(F.col("target_len") / F.col("n_hits"))
                          < F.least(F.lit(cfg.kmer_max_match_every_nt), F.col("target_len")))
    return raw.where("ok").join(crowded, ["query_id", *key, "q_pos"], "left_anti").select(
        "query_id", *key, "q_pos", "d_pos")


def match_kmers(db: TiledDb, blocks: QueryBlocks, cfg) -> DataFrame:
    """All (query window, target window) hits."""

    def emit(batch, tiles, lo, hi, block_no, block):
        hits = _piece_hits(tiles, lo, hi, block, cfg, None)
        return None if hits is None else _hit_batch(batch, block, hits)

    short = _map_pieces(_short(db, cfg), blocks, cfg, HIT_DDL, emit)
    return short.unionByName(long_hits(db, blocks, cfg)) if db.has_long else short


def reached_islands(db: TiledDb, blocks: QueryBlocks, cfg) -> DataFrame:
    """Groups of one-tile targets, finished in the task that found their hits."""

    def emit(batch, tiles, lo, hi, block_no, block):
        hits = _piece_hits(tiles, lo, hi, block, cfg, None)
        return None if hits is None else _island_batch(batch, tiles, block, hits, cfg)

    return _map_pieces(_short(db, cfg), blocks, cfg, REACHED_DDL, emit)


