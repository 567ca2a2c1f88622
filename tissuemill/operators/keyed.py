"""Components and batch correction of many groups at once: one job for a step, however many groups there are.

Groups are strata, of which there are few, and each has vectors of its own width. Tasks sum their rows by group; sums of
squares, centres and shifts of all groups reach the driver together and are told to the tasks of the next step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..sources.files import staged

ROWS = 2048
SUMS = "key string, i int, row binary"
#: Rounds after which the corrected vectors are written anew, so that no row replays more.
REPLAY = 3


class Sparse(NamedTuple):
    """Vectors given by the places (column i) and values (column v) of what is not 0 in them, and the width of each group's."""

    widths: dict[str, int]


def columns_of(f: str | Sparse) -> list[str]:
    return ["i", "v"] if isinstance(f, Sparse) else [f]


def by_key(batch: pa.RecordBatch, key: str, f: str | Sparse) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(key, places, vectors) of each group in a batch; vectors of a group have one width."""
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    if isinstance(f, Sparse):
        for k in dict.fromkeys(keys):
            at = np.flatnonzero(keys == k)
            some = batch.take(pa.array(at))
            x = np.zeros((len(at), f.widths[k]))
            x[np.repeat(np.arange(len(at)), some.column("i").value_lengths().to_numpy()), some.column("i").flatten().to_numpy()] = some.column("v").flatten().to_numpy()
            yield k, at, x
        return
    lists = batch.column(f)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for k in dict.fromkeys(keys):
        at = np.flatnonzero(keys == k)
        width = offsets[at[0] + 1] - offsets[at[0]]
        yield k, at, flat[offsets[at][:, None] + np.arange(width)]


def replaced(batch: pa.RecordBatch, f: str | Sparse, rows: list[np.ndarray]) -> pa.RecordBatch:
    lengths = [len(r) for r in rows]
    values = np.concatenate(rows) if rows else np.zeros(0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))
    if isinstance(f, Sparse):
        others = [c for c in batch.schema.names if c not in columns_of(f)]
        return pa.RecordBatch.from_arrays([*map(batch.column, others), lists], [*others, "f"])
    return batch.set_column(batch.schema.get_field_index(f), f, lists)


def mapped(df: DataFrame, key: str, f: str | Sparse, change: Callable[[str, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """df with f changed, group by group inside of batches; of sparse vectors a column f is made."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                out: list = [None] * part.num_rows
                for k, at, x in by_key(part, key, f):
                    for i, row in zip(at, change(k, x, part.take(pa.array(at))), strict=True):
                        out[i] = row
                yield replaced(part, f, out)

    return df.mapInArrow(run, T.StructType([*df.drop("i", "v").schema, T.StructField("f", T.ArrayType(T.DoubleType()))]) if isinstance(f, Sparse) else df.schema)


def sums_by(df: DataFrame, key: str, f: str | Sparse, start: Callable[[str, int], np.ndarray], add: Callable[[str, np.ndarray, pa.RecordBatch], np.ndarray]) -> dict[str, np.ndarray]:
    """A matrix of sums for each group: every task adds its rows up, rows of the matrices are merged by a shuffle. Rows of zeros
    are not sent, but for the last one; the driver gets bytes, not lists of numbers."""
    ship(df.sparkSession)

    def emitted(total: dict) -> Iterator[pa.RecordBatch]:
        held = list(total.items())
        for at in range(0, len(held), 256):
            some = held[at : at + 256]
            rows = pa.array([r.tobytes() for _, r in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in some], pa.string()), pa.array([i for (_, i), _ in some], pa.int32()), rows], ["key", "i", "row"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for k, rows, x in by_key(part, key, f):
                    if k not in total:
                        total[k] = start(k, x.shape[1])
                    total[k] += add(k, x, part.take(pa.array(rows)))
        yield from emitted({(k, i): row for k, m in total.items() for i, row in enumerate(m) if i == len(m) - 1 or row.any()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for k, i, row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "row")), strict=True):
                total[k, i] = total.get((k, i), 0) + np.frombuffer(row)
        yield from emitted(total)

    out: dict[str, dict[int, bytes]] = {}
    for k, i, row in df.mapInArrow(own, SUMS).repartition("key", "i").mapInArrow(merged, SUMS).collect():
        out.setdefault(k, {})[i] = row
    found = {}
    for k, rows in sorted(out.items()):
        last = max(rows)
        found[k] = np.zeros((last + 1, len(rows[last]) // 8))
        for i, row in rows.items():
            found[k][i] = np.frombuffer(row)
    return found


def pca_by(df: DataFrame, key: str, f: str | Sparse, k: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """(df with each row's scores on its group's components, components by group): at most k, no more than columns or rows."""
    scored, components, _ = pca_by_with_zeros(df, key, f, k, {})
    return scored, components


def pca_by_with_zeros(df: DataFrame, key: str, f: str | Sparse, k: int, zeros: dict[str, int]) -> tuple[DataFrame, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(scores, components, score of a row of zeros by group) of the rows of df and, in each group, rows of zeros that are not in df."""
    from .models import components_of

    def square(_: str, x: np.ndarray, __: pa.RecordBatch) -> np.ndarray:
        z = np.hstack((np.ones((len(x), 1)), x))
        return z.T @ z

    found = {}
    for level, m in sums_by(df, key, f, lambda _, width: np.zeros((width + 1, width + 1)), square).items():
        found[level] = components_of(m[0, 0] + zeros.get(level, 0), m[0, 1:], m[1:, 1:], k)
    scored = mapped(df, key, f, lambda level, x, _: (x - found[level][1]) @ found[level][0].T)
    return scored, {level: c for level, (c, _) in found.items()}, {level: -mean @ c.T for level, (c, mean) in found.items()}


class Fit(NamedTuple):
    """What a round needs of a group: numbers of its batches, centres and penalties, and the shifts of a finished round."""

    number: dict
    centres: np.ndarray
    penalty: np.ndarray
    shift: np.ndarray | None = None


def soft(z: np.ndarray, b: np.ndarray, fit: Fit, sigma: float) -> np.ndarray:
    from .models import distances

    d = distances(z, fit.centres)
    r = np.exp((d - d.min(1, keepdims=True)) / -sigma) * fit.penalty[:, b].T
    return r / r.sum(1, keepdims=True)


def harmony_by(
    df: DataFrame, key: str, f: str, batch: str, clusters: int | None = None, rounds: int = 10, sigma: float = 0.1, theta: float = 2.0, ridge_penalty: float = 1.0, tolerance: float = 1e-4, seed: int = 0, weight: str | None = None
) -> DataFrame:
    """df with column f corrected inside each group: soft clusters penalised for batch imbalance, then a ridge shift for each
    cluster and batch, until a group's objective changes by less than `tolerance` of itself.

    By default a group has one cluster for 30 rows, 100 at most, begun by k-means on a bounded draw of its rows. Rows are
    assigned from the corrected vectors of the round before, which are written every REPLAY rounds. In each round
    groups x clusters x batches sums of vectors are shuffled and reach the driver. weight: a column that tells how many rows a row
    stands for. Equal rows are drawn as one row with their number, so no task sorts them all.
    """
    from .models import distances, k_means, unit

    rows = df.withColumn("_z", F.col(f))
    copies = F.col(weight) if weight else F.lit(1)
    sizes = {(r[0], r[1]): r["n"] for r in df.groupBy(key, batch).agg(F.sum(copies).alias("n")).orderBy(key, batch).collect()}
    levels = list(dict.fromkeys(k for k, _ in sizes))
    n = {k: sum(v for (level, _), v in sizes.items() if level == k) for k in levels}
    most = {k: clusters or max(1, min(100, round(n[k] / 30))) for k in levels}
    drawn = df.groupBy(F.col(key).alias("_key"), F.xxhash64(f).alias("_h"), F.col(f).alias("_f")).agg(F.sum(copies).alias("_n"))
    for salt in (F.pmod("_h", F.lit(64)), F.lit(0)):
        ahead = Window.partitionBy("_key", salt).orderBy("_h", "_f").rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).where(F.col("_ahead") < 50 * max(most.values(), default=1))
    starts: dict[str, list] = {}
    for r in drawn.orderBy("_key", "_ahead").collect():
        held = starts.setdefault(r["_key"], [])
        held += [r["_f"]] * min(r["_n"], 50 * most[r["_key"]] - len(held))
    fits = {}
    for k in levels:
        centres = k_means(np.array(starts[k], float), most[k], seed)
        number = {b: i for i, b in enumerate(b for level, b in sizes if level == k)}
        fits[k] = Fit(number, centres, np.ones((len(centres), len(number))))
    history: list[dict[str, Fit]] = []
    active, before = set(levels), {}

    def now(k: str, x: np.ndarray, z: np.ndarray, part: pa.RecordBatch, history: list) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the batches, vectors after the rounds of history)."""
        b = np.array([fits[k].number[v] for v in part.column(batch).to_pylist()], int)
        for done in history:
            if k in done:
                r, z = soft(z, b, done[k], sigma), x.copy()
                for i in np.unique(b):
                    z[b == i] -= r[b == i] @ done[k].shift[:, i]
        return b, z

    def other(part: pa.RecordBatch, column: str, width: int) -> np.ndarray:
        return part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)

    for _ in range(rounds):
        told = {k: fits[k] for k in active}

        def add(k: str, x: np.ndarray, part: pa.RecordBatch, told=told, history=tuple(history)) -> np.ndarray:
            fit = fits[k]
            width, c = x.shape[1], len(fit.centres)
            total = np.zeros((c * len(fit.number) + 1, 2 * width + 1))
            if k not in told:
                return total
            b, z = now(k, x, other(part, "_z", width), part, history)
            r = soft(z, b, told[k], sigma)
            w = part.column(weight).to_numpy()[:, None] if weight else 1
            total[-1, 0] = (w * r * distances(z, told[k].centres)).sum() + sigma * (w * r * np.log(np.maximum(r, 1e-12))).sum()
            r = w * r
            for i in np.unique(b):
                total[i * c : (i + 1) * c] = r[b == i].T @ np.column_stack((x[b == i], unit(z[b == i]), np.ones((b == i).sum())))
            return total

        found = sums_by(rows, key, f, lambda k, width: np.zeros((len(fits[k].centres) * len(fits[k].number) + 1, 2 * width + 1)), add)
        step = {}
        for k in sorted(active):
            fit, objective = fits[k], found[k][-1, 0]
            total = found[k][:-1].reshape(len(fit.number), len(fit.centres), -1).transpose(1, 0, 2)
            width = (total.shape[2] - 1) // 2
            mass, plain, direction = total[:, :, -1], total[:, :, :width], total[:, :, width:-1]
            mean = plain.sum(1) / np.maximum(mass.sum(1), 1e-12)[:, None]
            step[k] = fit._replace(shift=(plain - mass[:, :, None] * mean[:, None, :]) / (mass[:, :, None] + ridge_penalty))
            expected = mass.sum(1, keepdims=True) * (mass.sum(0) / max(mass.sum(), 1e-12))[None, :]
            fits[k] = fit._replace(penalty=((expected + 1) / (mass + 1)) ** theta, centres=unit(direction.sum(1)))
            if k in before and abs(before[k] - objective) <= tolerance * abs(before[k]):
                active.discard(k)
            before[k] = objective
        history.append(step)
        if len(history) == REPLAY:
            rows, history = staged(_moved(rows, key, f, now, other, history)), []
        if not active:
            break
    done = _moved(rows, key, f, now, other, history) if history else rows
    return done.drop(f).withColumnRenamed("_z", f).select(*df.columns)


def _moved(rows: DataFrame, key: str, f: str, now: Callable, other: Callable, history: list) -> DataFrame:
    """rows with _z after the rounds of history."""
    history = tuple(history)
    return mapped(rows, key, "_z", lambda k, z, part: now(k, other(part, f, z.shape[1]), z, part, history)[1])
