"""Coordinates of a neighbour graph: leading eigenvectors of its normalised adjacency, found by block products.

Cells are dealt to parts. A part holds the edges that leave its cells, sorted by the part and the cell they lead to, and its
rows of the vectors. In a product each part sends every other part that its edges reach one sum for each cell reached there, which is less
than a row for each edge; the edges are shuffled once for all products of a round. A task holds one part, of about PART_ROWS cells at most
and their edges, and what is sent to it. Only matrices of block x block numbers reach the driver, whatever the graph's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.files import staged

#: Vectors more than asked for, products between two orthogonalisations, rounds at most.
MORE, DEGREE, ROUNDS = 6, 8, 12
#: Most and least cells of a part, where their number allows it; edges that are multiplied at once.
PART_ROWS, LEAST_ROWS, MOST_EDGES = 65_536, 1024, 65_536
#: What a row of numbers is: a part's vectors, those before, sums for some of its cells, products of its columns.
OWN, BEFORE, SENT, GRAM = range(4)
NUMBERS = "part int, kind int, cells array<int>, x array<double>"

Change = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def numbers(part: list[int], kind: list[int], cells: list[np.ndarray], x: list[np.ndarray]) -> pa.Table:
    columns = [pa.array(part, pa.int32()), pa.array(kind, pa.int32()), lists(cells, pa.int32()), lists([a.ravel() for a in x], pa.float64())]
    return pa.table(columns, names=["part", "kind", "cells", "x"])


def dealt(edges: DataFrame) -> tuple[DataFrame, int]:
    """(cell_id, degree, part, place: every cell with edges of positive weight in sum, numbered inside its part; their number)."""
    degree = staged(edges.groupBy("cell_id").agg(F.sum("weight").alias("degree")).where("degree > 0"))
    n = degree.count()
    parts = max(1, -(-n // PART_ROWS), min(4 * edges.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("cell_id")) - 1  # a part is bounded
    return staged(degree.withColumn("part", F.pmod(F.xxhash64("cell_id"), F.lit(parts)).cast("int")).withColumn("place", place)), n


def packed(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """part, target, row, first, column, weight: the edges from a part to another, each weight over the root of both cells' sums.

    column is an edge's cell in its part; the edges of first[i] to first[i + 1] lead to cell row[i] of the target.
    """
    one = cells.select("cell_id", F.col("part").alias("target"), F.col("place").alias("row"), F.col("degree").alias("d"))
    two = cells.select(F.col("cell_id").alias("neighbour"), "part", F.col("place").alias("column"), F.col("degree").alias("e"))
    weight = F.col("weight") / F.sqrt(F.col("d") * F.col("e"))
    rows = edges.where("weight > 0").join(one, "cell_id").join(two, "neighbour").select("part", "target", "row", "column", weight.alias("weight"))

    def pack(held: pa.Table) -> pa.Table:
        row, column, weight = (held.column(c).to_numpy() for c in ("row", "column", "weight"))
        order = np.lexsort((column, row))
        row, column, weight = row[order], column[order], weight[order]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(row), MOST_EDGES):
            some = slice(at, at + MOST_EDGES)
            reached, first = np.unique(row[some], return_index=True)
            for values, more in zip(out, (reached, first, column[some], weight[some]), strict=True):
                values.append(more)
        ends = [pa.array([held.column(c)[0].as_py()] * len(out[0]), pa.int32()) for c in ("part", "target")]
        return pa.table([*ends, *(lists(values, pa.int32()) for values in out[:3]), lists(out[3], pa.float64())], names=["part", "target", "row", "first", "column", "weight"])

    return staged(rows.groupBy("part", "target").applyInArrow(pack, "part int, target int, row array<int>, first array<int>, column array<int>, weight array<double>"))


def gathered(held: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, those before, sums of what was sent) of one part's rows of numbers."""
    kind, x = held.column("kind").to_pylist(), held.column("x")
    of = {k: x[kind.index(k)].values.to_numpy().reshape(-1, width) for k in (OWN, BEFORE)}
    sums = np.zeros_like(of[OWN])
    for i in range(len(kind)):
        if kind[i] == SENT:
            sums[held.column("cells")[i].values.to_numpy()] += x[i].values.to_numpy().reshape(-1, width)  # a cell once in a row
    return of[OWN], of[BEFORE], sums


def passed(edges: DataFrame, state: DataFrame, width: int, change: Change) -> DataFrame:
    """Numbers after a change of every part's vectors (vectors, those before, sums sent -> vectors, those before), the new
    vectors' products with the edges being sent."""

    def send(held: pa.Table, state: pa.Table) -> pa.Table:
        v, before = change(*gathered(state, width))
        part, none = state.column("part")[0].as_py(), np.zeros(0, np.int32)
        out = ([part, part], [OWN, BEFORE], [none, none], [v, before])
        for i in range(len(held)):
            row, first, column, weight = (held.column(c)[i].values.to_numpy() for c in ("row", "first", "column", "weight"))
            more = (held.column("target")[i].as_py(), SENT, row, np.add.reduceat(weight[:, None] * v[column], first))
            for values, value in zip(out, more, strict=True):
                values.append(value)
        return numbers(*out)

    return edges.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(send, NUMBERS)


def product(state: DataFrame, width: int) -> DataFrame:
    """The sums that were sent (OWN), the vectors they are of (BEFORE), and the products of all their columns (GRAM), by part."""

    def add(state: pa.Table) -> pa.Table:
        v, _, sums = gathered(state, width)
        both, none = np.hstack((v, sums)), np.zeros(0, np.int32)
        return numbers([state.column("part")[0].as_py()] * 3, [OWN, BEFORE, GRAM], [none] * 3, [sums, v, both.T @ both])

    return state.groupBy("part").applyInArrow(add, NUMBERS)


def step(a: float, b: float, c: float) -> Change:
    return lambda v, before, sums: (a * sums + b * v + c * before, v)


def turned(turn: np.ndarray) -> Change:
    return lambda v, before, sums: (before @ turn, np.zeros_like(before))


def started(cells: DataFrame, width: int) -> DataFrame:
    """Numbers of vectors drawn by the cells' identifiers."""
    start = F.array(*((F.xxhash64("cell_id", F.lit(k)) / float(1 << 63)) for k in range(width)))

    def begin(held: pa.Table) -> pa.Table:
        v = held.sort_by("place").column("v").combine_chunks().flatten().to_numpy()
        none = np.zeros(0, np.int32)
        return numbers([held.column("part")[0].as_py()] * 2, [OWN, BEFORE], [none, none], [np.zeros_like(v), v])

    return cells.select("part", "place", start.alias("v")).groupBy("part").applyInArrow(begin, NUMBERS)


def summed(state: DataFrame, kind: int) -> np.ndarray:
    rows = state.where(F.col("kind") == kind).select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(rows)])


def spectral(edges: DataFrame, wanted: int = 3, tolerance: float = 1e-6, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(cell_id, v array<double>: the wanted leading eigenvectors, of length 1; their eigenvalues, falling).

    Subspace iteration with a Chebyshev filter that damps everything below the block's last value. It ends when every
    wanted vector's residual is below the tolerance, or after the rounds. The sign is that of the sum of cubes. A cell
    without an edge of positive weight has no row; an empty graph gives an empty table.
    """
    ship(edges.sparkSession)
    edges = staged(edges)
    cells, n = dealt(edges)
    width = min(wanted + MORE, n)
    if not width:
        return cells.select("cell_id", F.array().cast("array<double>").alias("v")), np.zeros(0)
    wanted = min(wanted, width)
    held, state, turn, low = packed(edges, cells), started(cells, width), np.eye(width), 0.5
    for _ in range(rounds):
        half, shift = 2 / (1 + low), (1 - low) / (1 + low)  # takes -1 .. low to -1 .. 1
        state = passed(held, state, width, turned(turn))
        for k in range(DEGREE):
            twice = 2.0 if k else 1.0
            state = passed(held, state, width, step(twice * half, twice * shift, -1.0 if k else 0.0))
        state = staged(product(state, width))  # a round is one plan
        m = summed(state, GRAM).reshape(2 * width, 2 * width)
        inside, image = m[:width, :width], m[width:, width:]
        scale = 1 / np.sqrt(np.diag(inside))
        values, vectors = np.linalg.eigh(inside * np.outer(scale, scale))
        real = values > 1e-12 * values[-1]
        base = scale[:, None] * vectors[:, real] / np.sqrt(values[real])
        ritz, turn = np.linalg.eigh(base.T @ ((m[:width, width:] + m[width:, :width]) / 2) @ base)
        turn, ritz = (base @ turn)[:, ::-1], ritz[::-1]
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, image, turn) - ritz**2, 0))
        # Vectors that the block has lost are replaced by its first ones; they mend themselves in the next round.
        turn = np.pad(turn, ((0, 0), (0, width - turn.shape[1])), mode="wrap") if turn.shape[1] < width else turn
        if (residual[:wanted] < tolerance).all():
            break
        low = float(np.clip(ritz[-1], -0.5, 0.999))
    wanted = min(wanted, len(ritz))
    return found(cells, state, turn[:, :wanted]), ritz[:wanted]


def found(cells: DataFrame, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """cell_id, v: the vectors turned, each with a sum of cubes that is not negative."""
    vectors, width = state.where(F.col("kind") == BEFORE), len(turn)

    def cubes(state: pa.Table) -> pa.Table:
        v = state.column("x")[0].values.to_numpy().reshape(-1, width) @ turn
        return numbers([state.column("part")[0].as_py()], [GRAM], [np.zeros(0, np.int32)], [(v**3).sum(0)])

    told = turn * np.where(summed(vectors.groupBy("part").applyInArrow(cubes, NUMBERS), GRAM) < 0, -1.0, 1.0)

    def rows(cells: pa.Table, state: pa.Table) -> pa.Table:
        v = state.column("x")[0].values.to_numpy().reshape(-1, width) @ told
        return pa.table([cells.sort_by("place").column("cell_id"), lists(list(v), pa.float64())], names=["cell_id", "v"])

    return cells.select("part", "place", "cell_id").groupBy("part").cogroup(vectors.groupBy("part")).applyInArrow(rows, "cell_id long, v array<double>")


def coordinates(edges: DataFrame, size: float = 10.0) -> DataFrame:
    """cell_id, x, y: the second and third eigenvector, the largest coordinate `size`. Parts of a graph that no edge joins are told
    apart first: their indicators are eigenvectors of value 1."""
    found, _ = spectral(edges, 3, tolerance=1e-4)
    rows = found.select("cell_id", *(F.coalesce(F.get("v", F.lit(k + 1)), F.lit(0.0)).alias(c) for k, c in enumerate("xy")))
    most = rows.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    return rows.select("cell_id", *((F.col(c) * (size / m if m else 0.0)).alias(c) for c, m in zip("xy", most, strict=True)))
