"""Benchmark decontamination with spaced seeds.

Fixed masks select some of the token positions of a window and ignore the others, so a window still meets its
benchmark counterpart when tokens at ignored positions were replaced. Every window of every document is hashed
under every mask and joined with the hashed windows of all benchmark items. Each hit fixes an alignment
(item position minus document position); the overlap around it is then compared token by token. A stretch of the
alignment is admissible if it holds one of the alignment's hits, begins and ends with equal tokens and has at least
`min_match` of its tokens equal. The alignment counts if an admissible stretch covers at least `min_share` of the item's tokens, or holds at least
`least_equal` equal tokens whatever the size of the item; of those stretches the one with most equal tokens is reported.

Tokens are words with the case of letters dropped and signs at either end cut off. Items shorter than a mask
are compared by windows of their own length, all positions counting.

The benchmark side is broadcast if it has at most `broadcast_items` items of `broadcast_bytes` bytes of text; a larger
benchmark is cut into blocks of about that size, each block meeting all documents. The blocks are a stated query set.
Hits are taken apart HITS_AT_ONCE at a time, so a window that many items share costs time, not memory.

Defined edge cases: null and empty texts match nothing; an item without words matches nothing; equal items are
reported under each item_id, also under a null one; a document that repeats an item is reported once, with its best
alignment (most equal tokens, then the earliest); rows that repeat a doc_id, or have none, are reported as one but
judged and dropped each by its own text; an empty table gives an empty result; further columns are ignored, and kept by
`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_strings, map_arrow, mix64, slices, split_words, table

#: 1: the token counts, 0: it may differ.
MASKS = ("1101100101", "1011010011", "1110010110", "11111")
MIN_SHARE = 0.5
MIN_MATCH = 0.75
LEAST_EQUAL = 13
BROADCAST_ITEMS = 50_000
BROADCAST_BYTES = 64 << 20
FILTER_BITS = 22
HITS_AT_ONCE = 1_000_000

STRETCH = ["doc_id", "item_id", "doc_start", "item_start", "length", "n_equal", "item_words"]
FOUND = ", ".join(f"{c} long" for c in STRETCH)


class Limits(NamedTuple):
    """What makes a stretch count."""

    min_share: float = MIN_SHARE
    min_match: float = MIN_MATCH
    least_equal: int = LEAST_EQUAL


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes of the normalised words)."""
    offsets, codes, words = split_words(texts)
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=".,;:!?\"'()[]{}<>*#$%&|-_/\\`~^+=")
    hashes = hash_strings(plain)
    hashes[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = 0
    hashed = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    real = hashed != 0  # what consists of signs only is no token
    if not real.all():
        before = np.concatenate(([0], np.cumsum(real)))
        hashed, offsets = hashed[real], before[offsets]
    return offsets, hashed


def factors(n: int) -> np.ndarray:
    """Odd constants, one for each place of a mask."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def window_hashes(hashed: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the window that begins at each token, as far as windows fit."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2) * 2654435761 % 2**64, np.uint64)
    for k, c in enumerate(factors(len(mask))):
        if mask[k] == "1":
            out += hashed[k : k + n] * c
    return mix64(out)


class Items:
    """Benchmark items, their hashed windows, and a bit table that turns most windows of documents away."""

    def __init__(self, ids: list[int], texts: list[str | None], masks: tuple[str, ...]):
        offsets, hashed = tokens(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [hashed[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        shortest = min(map(len, masks))
        lengths = {len(w) for w in self.words if 0 < len(w) < shortest}
        self.masks = [*masks, *("1" * n for n in sorted(lengths))]
        self.tables = []
        for mask in self.masks:
            parts = [(window_hashes(w, mask), i) for i, w in enumerate(self.words) if len(w) >= len(mask) and (mask in masks or len(w) == len(mask))]
            keys = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.uint64)])
            items = np.concatenate([np.full(len(p), i) for p, i in parts] or [np.zeros(0, np.int64)])
            places = np.concatenate([np.arange(len(p)) for p, _ in parts] or [np.zeros(0, np.int64)])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[keys & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.tables.append((keys[order], items[order], places[order], bits))

    def hits(self, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(token of the corpus slice, item, token of the item, span) for every pair of equal windows, some at a time."""
        for mask, (keys, items, places, bits) in zip(self.masks, self.tables, strict=True):
            windows = window_hashes(hashed, mask)
            at = np.flatnonzero(bits[windows & np.uint64((1 << FILTER_BITS) - 1)])
            low = np.searchsorted(keys, windows[at], "left")
            n = np.searchsorted(keys, windows[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            ends, done = np.cumsum(n), 0
            while done < len(n):
                to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS_AT_ONCE, "right")))
                a, first, many = at[done:to], low[done:to], n[done:to]
                each = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                yield np.repeat(a, many), items[each], places[each], len(mask)
                done = to

    def verify(self, doc: np.ndarray, item: int, shift: int, hits: np.ndarray, span: int, limits: Limits) -> tuple | None:
        """The admissible stretch of most equal tokens of the alignment document position = item position + shift.

        hits: ascending item positions of windows of `span` tokens. From each equal token a stretch reaches to the last
        equal one up to which enough tokens are equal; it counts if the first window from there on ends inside it.
        """
        words = self.words[item]
        low, high = max(0, -shift), min(len(words), len(doc) - shift)
        same = words[low:high] == doc[low + shift : high + shift]
        gain = np.concatenate(([0.0], np.cumsum(same - limits.min_match)))
        equal = np.concatenate(([0], np.cumsum(same)))
        ends_equal = np.concatenate(([False], same))
        reach = np.maximum.accumulate(np.where(ends_equal, gain, -np.inf)[::-1])  # largest gain from each place on, from the end
        ends = len(gain) - 1 - np.searchsorted(reach, gain - 1e-9, "left")
        begins = np.arange(len(gain))
        following = np.searchsorted(hits - low, begins, "left")
        window = np.append(hits - low + span, len(gain))[following]
        n, same = ends - begins, equal[ends] - equal[begins]
        good = np.append(ends_equal[1:], False) & (window <= ends) & ((n >= limits.min_share * len(words)) | (same >= limits.least_equal))
        if not good.any():
            return None
        best = int(np.argmax(np.where(good, same, -1)))
        return low + best + shift, low + best, int(n[best]), int(same[best]), len(words)

    def overlaps(self, texts: pa.Array, limits: Limits) -> Iterator[tuple[int, int, tuple]]:
        """(text, item, best stretch) for every text and item that overlap."""
        offsets, hashed = tokens(texts)
        best: dict[tuple[int, int], tuple] = {}
        shared: dict[tuple[int, int], list[int]] = {}  # sums of the item's tokens that stand in the text at all
        for at, item, place, span in self.hits(hashed):
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + span <= offsets[doc + 1]  # a window may not run into the next document
            at, item, place, doc = (x[inside] for x in (at, item, place, doc))
            shift = at - offsets[doc] - place
            order = np.lexsort((place, shift, item, doc))
            doc, item, shift, place = (x[order] for x in (doc, item, shift, place))
            new = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(doc)] if len(doc) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # alignments
                d, i, s = int(doc[a]), int(item[a]), int(shift[a])
                held = best.get((d, i))
                if held is not None:  # an alignment that cannot hold as many equal tokens, or as early, cannot win
                    if (d, i) not in shared:
                        shared[d, i] = np.concatenate(([0], np.cumsum(np.isin(self.words[i], hashed[offsets[d] : offsets[d + 1]])))).tolist()
                    low, high = max(0, -s), min(len(self.words[i]), int(offsets[d + 1] - offsets[d]) - s)
                    if (shared[d, i][low] - shared[d, i][high], low + s) > (-held[3], held[0]):
                        continue
                got = self.verify(hashed[offsets[d] : offsets[d + 1]], i, s, place[a:b], span, limits)
                if got is not None and (held is None or (-got[3], *got) < (-held[3], *held)):
                    best[d, i] = got
        for (d, i), got in best.items():
            yield d, i, got


def blocks(benchmark: DataFrame, masks: tuple[str, ...], broadcast_items: int, broadcast_bytes: int) -> Iterator:
    """The benchmark as broadcasts of bounded size."""
    spark = benchmark.sparkSession
    n, size = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // broadcast_items), -(-size // broadcast_bytes))
    for k in range(parts):
        block = benchmark.select("item_id", "text")
        if parts > 1:
            block = block.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = block.orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], masks))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    limits: Limits = Limits(),
    broadcast_items: int = BROADCAST_ITEMS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row for each document and benchmark item that overlap; positions and lengths count tokens."""

    def find(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                rows += [(ids[d], items.ids[i], *got) for d, i, got in items.overlaps(part.column("text"), limits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], STRETCH)

    parts = [map_arrow(docs.select("doc_id", "text"), lambda it, told=told: find(it, told.value), FOUND) for told in blocks(benchmark, masks, broadcast_items, broadcast_bytes)]
    best = F.min_by(F.struct(*STRETCH[2:]), F.struct(-F.col("n_equal"), "doc_start", "item_start", "length"))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    limits: Limits = Limits(),
    broadcast_items: int = BROADCAST_ITEMS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs without the rows whose text holds a benchmark passage. Rows are judged where they lie, nothing is joined."""

    def clean(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _, _ in items.overlaps(part.column("text"), limits)]] = False
                yield part.filter(pa.array(keep))

    for told in blocks(benchmark, masks, broadcast_items, broadcast_bytes):
        docs = map_arrow(docs, lambda it, told=told: clean(it, told.value), docs.schema)
    return docs


def op5_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
