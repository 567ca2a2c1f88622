"""Periodic runs of words by Lyndon roots.

A run is a stretch of words with smallest period q, at least `exponent` q and `least` words long, that neither neighbour
extends. The longest Lyndon words that start at each place, under the order of the word ids and under its reverse,
contain a root of every run; they are found by one scan from right to left for each order. The scan's stack is the chain
of next smaller suffixes. Two suffixes that begin alike are compared by their longest common extension (LCE): a binary
search over rolling hashes, whose answer is verified word by word. An LCE at a distance is carried on to earlier places at
that distance, so stretches of one repeated word cost no more than others.

A root that stands twice in a row is then extended to both sides by the same search, for all roots of a slice at once.
Each run so found is verified directly; where a hash deceived, its ends are found word by word. Runs are reported once.

All documents of a slice are scanned as one sequence with a mark between them, which is smaller than any word in both orders
and ends every extension.

Defined edge cases: words are `[^\\x20\\x09-\\x0D]+`; null, empty and blank texts have no words and no runs, and an empty
collapsed text; rows that repeat are rows of their own; an empty table gives an empty result; further columns are ignored.
A text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix64, slices, split_words, table, word_count

LEAST = 24
EXPONENT = 3
#: Bytes of text scanned together.
SCAN_BYTES = 4 << 20
#: Words compared one by one before hashes are.
FIRST = 8
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """Longest common extensions in a sequence of ids that begins and ends with a mark (id 0)."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(ids), BASE, np.uint64)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * self.powers[:-1])))
        self.known: dict[int, tuple[int, int]] = {}  # by distance: the last place asked and its extension

    def alike(self, i: int, j: int, length: int) -> bool:
        """Whether the hashes of the `length` ids from i and from j > i are equal."""
        s = self.sums
        return not ((int(s[i + length]) - int(s[i])) * int(self.powers[j - i]) - int(s[j + length]) + int(s[j])) & MASK

    def _within(self, i: int, j: int, most: int) -> int:
        """The ids that agree from i and from j, `most` at most: binary search, then word by word."""
        low, high = 0, 1
        while high <= most and self.alike(i, j, high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.alike(i, j, middle) else (low, middle)
        differ = np.flatnonzero(self.ids[i : i + low] != self.ids[j : j + low])
        return int(differ[0]) if len(differ) else low

    def common(self, i: int, j: int, sure: int = 0) -> int:
        """How many ids agree from i and from j > i on; the first `sure` are known to."""
        seen = self.known.get(j - i)
        gap = seen[0] - i if seen else 0
        if gap > sure and (have := self._within(i, j, gap)) < gap:
            length = have
        else:
            length = gap + seen[1] if gap > 0 else self._within(i, j, len(self.ids) - 1 - j)
        self.known[j - i] = (i, length)
        return length

    def _alike(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[i + length] - s[i]) * self.powers[j - i] == s[j + length] - s[j]

    def repeated(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether `period` ids from each start come twice in a row."""
        return self._alike(start, start + period, period)

    def reach(self, start: np.ndarray, period: np.ndarray, back: bool) -> np.ndarray:
        """How far ids and those a period later agree, from each start on or before it."""
        low = np.zeros(len(start), np.int64)
        high = (start if back else len(self.ids) - start - period) + 1
        while (open_ := high - low > 1).any():
            middle = np.where(open_, (low + high) // 2, low)
            at = start - middle if back else start
            fits = self._alike(at, at + period, middle)
            low, high = np.where(fits, middle, low), np.where(fits | ~open_, high, middle)
        return low


def next_smaller(w: list[int], common) -> np.ndarray:
    """For each place the next one whose suffix is smaller; a mark (0) is smaller than any word."""
    follow = [0] * len(w)
    for i in range(len(w) - 2, -1, -1):
        mine = w[i]
        j = i + 1
        if mine:
            while True:
                other = w[j]
                if other > mine:
                    j = follow[j]
                elif other < mine:
                    break
                else:
                    length = 1
                    while length < FIRST and w[i + length] == w[j + length]:
                        length += 1
                    if length == FIRST:
                        length = common(i, j, FIRST)
                    if w[i + length] > w[j + length]:
                        break
                    j = follow[j]
        follow[i] = j
    return np.array(follow, np.int64)


def runs_of(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows start, end, period of the runs in ids (words from 1, a mark 0 at both ends and between texts), sorted.

    exponent is 3 at least: then a root stands twice behind the place where it is first met.
    """
    ext, top = Extensions(ids), int(ids.max(initial=0)) + 1
    found = []
    for order in (ids, np.where(ids > 0, top - ids, 0)):
        ext.known.clear()
        follow = next_smaller(order.tolist(), ext.common)
        start = np.arange(len(ids))
        period = follow - start
        start, period = (x[(ids > 0) & (start + 2 * period < len(ids))] for x in (start, period))
        twice = ids[start] == ids[start + period]
        start, period = start[twice], period[twice]
        twice = ext.repeated(start, period)
        start, period = start[twice], period[twice]
        low, high = start - ext.reach(start, period, True), start + period + ext.reach(start, period, False)
        found.append(np.column_stack((low, high, period, start)))
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, exponent * rows[:, 2])]
    rows = rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]]
    for row in rows:
        low, high, q, root = row
        if (ids[low : high - q] != ids[low + q : high]).any():  # a hash deceived
            differ = np.flatnonzero(ids[:-q] != ids[q:])
            at = np.searchsorted(differ, root)
            row[:2] = (differ[at - 1] + 1 if at else 0), (differ[at] if at < len(differ) else len(ids) - q) + q
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, exponent * rows[:, 2])]
    return np.unique(rows[:, :3][:, [0, 2, 1]], axis=0)[:, [0, 2, 1]] if len(rows) else rows[:, :3]


def _runs(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SCAN_BYTES):
            offsets, codes, vocabulary = split_words(part.column("text"))
            ids = codes.astype(np.int64) + 1
            tiles = zip(part.column("tile_start").to_pylist(), part.column("tile_period").to_pylist(), strict=True) if "tile_start" in part.schema.names else ()
            for k, (a, p) in enumerate(tiles):
                if p:
                    own = ids[offsets[k] : offsets[k + 1]]
                    own[a:] = own[a + np.arange(len(own) - a) % p]
            n = np.diff(offsets)
            marked = np.insert(ids, np.append(offsets[:-1], len(ids)), 0)
            begins = offsets[:-1] + np.arange(1, len(n) + 1)  # of each text in marked
            rows = runs_of(marked, least, exponent)
            owner = np.searchsorted(begins, rows[:, 0], side="right") - 1
            change = np.zeros(len(marked) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 1], -1)
            kept = (np.cumsum(change)[:-1] == 0) & (marked > 0)
            ends = np.concatenate(([0], np.cumsum(np.add.reduceat(np.append(kept, False), begins) * (n > 0)))) if len(n) else np.zeros(1)
            held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), vocabulary.take(pa.array(marked[kept] - 1)))
            runs = pa.StructArray.from_arrays([pa.array(rows[:, 0] - begins[owner]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), runs, pc.binary_join(held, " ")], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start and length in words, period; by start, then period), collapsed: the text's words joined by
    one blank, of each run only the first period (words that another run drops go as well).

    With columns tile_start and tile_period, of words from tile_start on a stretch of tile_period is repeated over the
    rest of the text before runs are sought; null leaves a text as it is.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 at least")
    tiles = [c for c in ("tile_start", "tile_period") if c in docs.columns]
    return map_arrow(docs.select("doc_id", "text", *tiles), lambda it: _runs(it, least, exponent), RUNS)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by a hash of doc_id, get a periodic tail first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    n = F.when(h % 10 == 0, word_count(F.col("text")))
    docs = docs.withColumn("g", g).withColumn("n", n)
    docs = docs.withColumn("tile_start", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("tile_period", 1 + F.floor((F.col("n") - F.col("tile_start")) / (3 + F.col("g") % 8)))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs(docs).withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
