"""Nearest neighbours by an inverted file: training rows in cells, queries sent to the cells that can matter.

Centres of cells come from k-means over a bounded sample of training rows; every row, sampled or not, goes to its nearest
centre's cell, and no training row passes the driver. A query first looks into its `probes` nearest cells, which gives
the distance of its k-th neighbour so far. The exact search then compares every query with every training row: training
rows lie in blocks of at most about SCAN_ROWS, queries are sent to every block, and a task multiplies matrices and looks
closer only at pairs within that distance. Its work is the product of both sides, its memory one block and a batch of
queries. The search without this round (`exact=False`) does much less; its recall is measured in the tests.

Cosine distances are searched among unit vectors, where the Euclidean distance is sqrt(2 d); vectors of zeros, which have
distance 1 to everything, get a dimension of their own on either side.

Skew: a cell with more than CELL_ROWS rows is searched in parts, and one asked by more than ASKED_ROWS queries by several
tasks, each with its own copy of a part. A task holds one part and a batch of queries.

Defined edge cases: fewer than k training rows give as many neighbours; an empty side gives no rows; equal distances (after
rounding) go by the smaller neighbour; rows with null vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.files import staged

#: Rows that k-means sees for each cell, and the most cells.
SAMPLE_PER_CELL = 32
MOST_CELLS = 4096
CELL_ROWS = 20_000
ASKED_ROWS = 20_000
PROBES = 8
#: Training rows of a block and queries of a task of the exact search; columns and queries that are multiplied at once.
SCAN_ROWS, SCAN_QUERIES = 65_536, 65_536
SCAN_COLUMNS, SCAN_BATCH = 4096, 512


def nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row, ties by column: a partition finds the k-th value, then few are sorted."""
    k = min(k, distance.shape[1])
    bound = np.partition(distance, k - 1, axis=1)[:, k - 1]
    best = np.empty((len(distance), k), np.int64)
    for i, row in enumerate(distance):
        near = np.flatnonzero(row <= bound[i])
        best[i] = near[np.argsort(row[near], kind="stable")[:k]]
    return best


def matrix(batch: pa.RecordBatch, column: str = "f") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def prepared(x: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Vectors whose Euclidean distance orders the pairs; side 0 for training rows, 1 for queries."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    more = np.zeros((len(x), 2))
    more[:, side] = norm[:, 0] == 0
    return np.hstack((x / np.where(norm == 0, 1, norm), more))


def between(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T, 0))


def rounded_distances(q: np.ndarray, v: np.ndarray, metric: str, digits: int) -> np.ndarray:
    return np.round(1 - q @ v.T if metric == "cosine" else between(q, v), digits)


def pair_distances(q: np.ndarray, v: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """Distances of row i of q to row i of v; equal rows have distance 0 exactly."""
    return np.round(1 - np.einsum("ij,ij->i", q, v) if metric == "cosine" else np.sqrt(((q - v) ** 2).sum(1)), digits) + 0.0


def chunk(cells: int) -> int:
    """Rows whose distances to all cells are held at once."""
    return max(64, min(2048, (1 << 20) // max(1, cells)))


def centres_of(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = np.concatenate([between(x[at : at + 4096], centres).argmin(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index(NamedTuple):
    """rows: cell_id, cell_type, f (prepared), cell, part. For each cell its centre and number of parts."""

    rows: DataFrame
    metric: str
    centres: np.ndarray
    parts: np.ndarray


def build(train: DataFrame, metric: str = "cosine", cells: int | None = None) -> Index | None:
    """An index over train (cell_id, cell_type, f); None if it has no rows."""
    ship(train.sparkSession)
    train = train.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("cell_type").cast("int").alias("cell_type"), F.col("f").cast("array<double>").alias("f")).where("f is not null")
    n = train.count()
    if not n:
        return None
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, n)
    sample = train.orderBy(F.xxhash64("cell_id"), "cell_id").select("f").limit(cells * SAMPLE_PER_CELL).toArrow()
    centres = centres_of(prepared(np.vstack([matrix(b) for b in sample.to_batches() if b.num_rows]), metric, 0), cells)
    told = train.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk(cells)):
                some = batch.slice(at, chunk(cells))
                x = prepared(matrix(some), metric, 0)
                own = between(x, told.value).argmin(1)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("cell_id"), some.column("cell_type"), held, pa.array(own, pa.int32())], ["cell_id", "cell_type", "f", "cell"])

    placed = staged(train.mapInArrow(assign, "cell_id long, cell_type int, f array<double>, cell int"))
    parts = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # cells
        parts[r.cell] = -(-r.n // CELL_ROWS)
    of_cell = F.element_at(F.lit(np.maximum(parts, 1).tolist()), F.col("cell") + 1)
    return Index(placed.select("cell_id", "cell_type", "f", "cell", F.pmod(F.xxhash64("cell_id"), of_cell).cast("int").alias("part")), metric, centres, parts)


def _asks(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """query, f, cell: the nearest `probes` cells of each query."""
    told = queries.sparkSession.sparkContext.broadcast((index.centres, index.parts))
    metric, step = index.metric, chunk(len(index.centres))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, parts = told.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                q = prepared(matrix(some), metric, 1)
                far = np.where(parts > 0, between(q, centres), np.inf)
                wanted = np.zeros(far.shape, bool)
                np.put_along_axis(wanted, nearest(far, probes), True, 1)
                row, cell = np.nonzero(wanted & (parts > 0))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * q.shape[1], pa.int32()), pa.array(q[row].ravel()))
                yield pa.RecordBatch.from_arrays([some.column("query").take(pa.array(row)), held, pa.array(cell, pa.int32())], ["query", "f", "cell"])

    return queries.mapInArrow(choose, "query long, f array<double>, cell int")


def _searched(asks: DataFrame, index: Index, k: int, digits: int) -> DataFrame:
    """query, neighbour, label, distance: the k best of each part of each cell asked for."""
    asks = staged(asks)
    tasks = asks.groupBy("cell").agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("copies"))  # cells
    copies = {r.cell: r.copies for r in tasks.collect()}
    n = np.array([copies.get(c, 0) for c in range(len(index.centres))])
    of_cell = lambda values: F.element_at(F.lit(np.maximum(values, 1).tolist()), F.col("cell") + 1)
    asked = index.rows.where(F.element_at(F.lit(n.tolist()), F.col("cell") + 1) > 0)
    rows = asked.select("cell", "part", F.explode(F.sequence(F.lit(0), of_cell(n) - 1)).alias("copy"), F.lit(0).alias("side"), F.col("cell_id").alias("id"), F.col("cell_type").alias("label"), "f")
    parts = F.explode(F.sequence(F.lit(0), of_cell(index.parts) - 1)).alias("part")
    sent = asks.select("cell", parts, F.pmod(F.xxhash64("query"), of_cell(n)).cast("int").alias("copy"), F.lit(1).alias("side"), F.col("query").alias("id"), F.lit(None).cast("int").alias("label"), "f")
    both = rows.unionByName(sent).repartition("cell", "part", "copy").sortWithinPartitions("cell", "part", "copy", "side", "id")
    metric = index.metric

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, labels, vectors = None, [], None, None, None
        for batch in batches:
            places = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "part", "copy", "side")])
            cuts = np.concatenate(([0], np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1, [len(places)])) if len(places) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some, place = batch.slice(a, b - a), tuple(places[a, :3])
                if place != now:
                    now, held, vectors = place, [], None
                if not places[a, 3]:
                    held.append((some.column("id").to_numpy(), some.column("label").to_pylist(), matrix(some)))
                    continue
                if vectors is None and held:
                    ids, labels, vectors = np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]], np.vstack([h[2] for h in held])
                    held = []
                for at in range(0, some.num_rows if vectors is not None else 0, 512):
                    part = some.slice(at, 512)
                    distance = rounded_distances(matrix(part), vectors, metric, digits)
                    best = nearest(distance, k)
                    flat = best.ravel()
                    who = np.repeat(part.column("id").to_numpy(), best.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[flat]), pa.array([labels[i] for i in flat], pa.int32()), pa.array(np.take_along_axis(distance, best, 1).ravel())], ["query", "neighbour", "label", "distance"])

    return both.mapInArrow(search, "query long, neighbour long, label int, distance double")


class Block(NamedTuple):
    """Training rows: half their squares (cosine: 0), the greatest length, and both side by side in single precision."""

    half: np.ndarray
    longest: float
    single: np.ndarray


def block_of(v: np.ndarray, metric: str) -> Block:
    square = np.einsum("ij,ij->i", v, v)
    half = np.zeros(len(v)) if metric == "cosine" else square / 2
    with np.errstate(over="ignore"):
        return Block(half, float(np.sqrt(square.max(initial=0.0))), np.column_stack((v, -half)).astype(np.float32))


def single_precision(q: np.ndarray, block: Block, limit: np.ndarray, metric: str) -> tuple[bool, np.ndarray]:
    """Whether products of single precision tell well enough what is within the limits, and by how much they may err for each row of q.

    Each of d + 1 products and sums errs by at most 2^-24 of the product of lengths; twice that is allowed for.
    """
    size = np.sqrt((q * q).sum(1))
    margin = (q.shape[1] + 4) * 2.0**-23 * (size * block.longest + block.half.max(initial=0.0) + size**2 + 1)
    known = limit[np.isfinite(limit) & (limit >= 0)]
    room = np.median(known if metric == "cosine" else known**2) if len(known) else 0.0
    single = bool(margin.max(initial=0.0) <= 0.01 * room)
    return single, margin if single else np.zeros(len(q))


def within(q: np.ndarray, reach: np.ndarray, v: np.ndarray, k: int, metric: str, digits: int, block: Block | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of v, distances): the k nearest of v within reach of each row of q, ties by place in v.

    Matrix products, with a margin for their rounding, tell which pairs to look at; their distances are computed one by one. The
    products are of single precision where its margin is small next to what is within reach.
    """
    block = block or block_of(v, metric)
    half = block.half
    square = np.zeros(len(q)) if metric == "cosine" else (q * q).sum(1)
    unit, limit = 10.0**-digits, reach.copy()
    slack = 1e-6 + 2 * unit + 1e-11 * (square + 2 * half.max(initial=0.0))
    single, margin = single_precision(q, block, limit, metric)
    kind = np.float32 if single else np.float64
    asked = np.column_stack((q, np.ones(len(q)))).astype(kind)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(v), SCAN_COLUMNS):
        some = v[at : at + SCAN_COLUMNS]
        like = asked @ (block.single[at : at + SCAN_COLUMNS] if single else np.column_stack((some, -half[at : at + SCAN_COLUMNS]))).T
        with np.errstate(invalid="ignore"):
            least = 1 - limit - slack if metric == "cosine" else (square - limit**2 - slack * (1 + 2 * limit)) / 2
        least -= margin
        least[limit < 0] = np.inf  # nothing is nearer than k copies
        open_ = np.isinf(limit)
        if open_.any():  # too few known so far: the k likest of these columns, and what ties with them
            of = like.shape[1] - min(k, like.shape[1])
            kth = np.partition(like[open_], of, axis=1)[:, of].astype(float) - 2 * margin[open_]
            least[open_] = kth - slack[open_] * (1 + 2 * np.sqrt(np.maximum(square[open_] - 2 * kth, 0)))
        row, column = np.divmod(np.flatnonzero(like >= least.astype(kind)[:, None]), like.shape[1])
        if not len(row):
            continue
        d = np.concatenate([pair_distances(q[row[i : i + 65_536]], some[column[i : i + 65_536]], metric, digits) for i in range(0, len(row), 65_536)])
        keep = d <= limit[row]
        row, column, d = row[keep], column[keep], d[keep]
        order = np.lexsort((column, d, row))
        row, column, d = row[order], column[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == k - 1  # what comes later in v yields in ties, so only nearer ones count
        limit[row[full]] = np.minimum(limit[row[full]], d[full] - unit / 2)
        first = place < k
        found.append((row[first], column[first] + at, d[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, column, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((column, d, row))
    row, column, d = row[order], column[order], d[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first], d[first]


def _scanned(left: DataFrame, index: Index, k: int, digits: int) -> DataFrame:
    """query, neighbour, label, distance: the k nearest of each block within reach of a query. left: query, f, reach."""
    n, asked, metric = index.rows.count(), left.count(), index.metric
    blocks = max(1, -(-n // SCAN_ROWS))
    wanted = max(-(-asked // SCAN_QUERIES), -(-4 * left.sparkSession.sparkContext.defaultParallelism // blocks))
    copies = max(1, min(wanted, -(-asked // SCAN_BATCH)))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    rows = index.rows.select(dealt("cell_id", blocks).alias("block"), each(copies).alias("copy"), F.lit(0).alias("side"), F.col("cell_id").alias("id"), F.col("cell_type").alias("label"), "f", F.lit(0.0).alias("reach"))
    sent = left.select(each(blocks).alias("block"), dealt("query", copies).alias("copy"), F.lit(1).alias("side"), F.col("query").alias("id"), F.lit(None).cast("int").alias("label"), "f", "reach")
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * copies)
    both = rows.unionByName(sent).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "side", "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, labels, vectors, block = None, [], None, None, None, None
        for batch in batches:
            places = np.column_stack([batch.column(c).to_numpy() for c in ("block", "copy", "side")])
            cuts = np.concatenate(([0], np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1, [len(places)])) if len(places) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some, place = batch.slice(a, b - a), tuple(places[a, :2])
                if place != now:
                    now, held, vectors = place, [], None
                if not places[a, 2]:
                    held.append((some.column("id").to_numpy(), some.column("label"), matrix(some)))
                    continue
                if vectors is None and held:
                    ids, labels, vectors = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.vstack([h[2] for h in held])
                    held, block = [], block_of(vectors, metric)
                for at in range(0, some.num_rows if vectors is not None else 0, SCAN_BATCH):
                    part = some.slice(at, SCAN_BATCH)
                    row, column, d = within(prepared(matrix(part), metric, 1), part.column("reach").to_numpy(), vectors, k, metric, digits, block)
                    yield pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy()[row]), pa.array(ids[column]), labels.take(pa.array(column)), pa.array(d)], ["query", "neighbour", "label", "distance"])

    return both.mapInArrow(scan, "query long, neighbour long, label int, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index | None, k: int = 30, probes: int = PROBES, exact: bool = True, digits: int = 9) -> DataFrame:
    """query, neighbour, label, distance, rank for queries (cell_id, f)."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query long, neighbour long, label int, distance double, rank int")
    asked = queries.select(F.col("cell_id").cast("long").alias("query"), F.col("f").cast("array<double>").alias("f")).where("f is not null")
    asked = staged(asked) if exact else asked
    first = _best(_searched(_asks(asked, index, probes), index, k, digits), k)
    if not exact:
        return first
    reach = staged(first.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach")))
    left = asked.join(reach, "query", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))) + 2 * 10.0**-digits + 1e-6)
    return _best(_scanned(left, index, k, digits), k)
