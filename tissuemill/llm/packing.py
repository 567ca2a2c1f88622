"""Packing of documents into sequences of a fixed number of tokens by sum of squares.

Documents become ids, with an end id behind each. One longer than a sequence is cut so that all its pieces but the first
are whole sequences, which need no place; the others are packed. A bin is a sequence with room left; N(g) is how many open
bins have room g. A piece goes where the sum of the squares of N(g) becomes smallest, the smallest remaining room on a tie.

The pieces are dealt at random into shards of some SHARD_ROWS rows, and each shard is packed by itself in one streaming
pass, longest pieces first: a task holds the open bins of a shard, its number of rows doesn't depend on the size of the
table. Left alone, sum of squares opens bins in the hope of pieces to come and ends with many that are not full; here a
shard opens bins freely up to FREE of what its tokens fill at least, beyond that only for a piece that fits in no open bin.
A shard then takes about 0.1 % more sequences than its tokens fill (11 % with arrival order and free opening).

Words are encoded once: a text is cut before a blank and around line ends wherever the tokenizer's own pattern ends a token,
and what is between is encoded once for each worker.

Defined edge cases: null and empty texts have the end id alone; rows that repeat are packed each; a null doc_id is kept; an
empty table gives an empty result; further columns are ignored. A text is held whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, stage, table
from .sstable import END_ID, Encoder

TOKENIZER_FILE = "byte_bpe_50k.json"
CAPACITY = 1024
SHARD_ROWS = 8192
FREE = 0.9
ENCODE_BYTES = 4 << 20
#: Stretches that a worker keeps.
MEMORY_STRETCHES = 1_500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_BYTES = np.arange(256)
#: Bytes that begin a character which is not white space; left out are those that begin some white space, and "<", which
#: may begin a special token, before which a text ends for the pattern.
SOLID_START = (_BYTES > 32) & (_BYTES < 127) & (_BYTES != 60) | (_BYTES >= 0xC3) & ~np.isin(_BYTES, [0xE1, 0xE2, 0xE3])
ALNUM = (_BYTES >= 48) & (_BYTES < 58) | (_BYTES >= 65) & (_BYTES < 91) | (_BYTES >= 97) & (_BYTES < 123)
STOPS = np.isin(_BYTES, list(b",.;:!?)"))


class StretchEncoder(Encoder):
    """Ids of whole texts by way of stretches that the byte-level tokenizer never joins.

    Its pattern leaves the last white space before a solid character to a token of its own, and a blank joins the word
    there: so a token ends before a blank or line end with something solid behind it, and behind such a line end. Letters,
    digits and punctuation never share a token either (but for an apostrophe and what follows it).
    """

    SEPARATOR = "<|endoftext|>"

    def encode(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw):
            before = SOLID_START[raw[1:]]
            before[offsets[(offsets > 0) & (offsets < len(raw))] - 1] = False  # the next text
            line_end = before & (raw[:-1] == 10)
            cut[:-2] |= before & (raw[:-1] == 32) | line_end
            cut[1:-1] |= line_end | ALNUM[raw[:-1]] & STOPS[raw[1:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        stretches = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = stretches.dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int32)
        lengths = self.lengths[rows]
        stops = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        ids = self.pool[np.repeat(self.starts[rows] - stops[:-1], lengths) + np.arange(stops[-1])]
        tail = np.array([end], np.uint32)
        at = stops[np.searchsorted(bounds, offsets)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.concatenate((ids[a:b], tail))

    def _forget(self) -> None:
        super()._forget()
        self.row_of: dict[str, int] = {}

    def _rows(self, stretches: pa.Array) -> np.ndarray:
        """Rows of the pool that hold these different stretches, new ones added."""
        held = stretches.to_numpy(zero_copy_only=False).tolist()
        if len(self.row_of) + len(held) > MEMORY_STRETCHES:
            self._forget()
        new = [x for x in held if x not in self.row_of]
        plain, special = [x for x in new if "<|" not in x], [x for x in new if "<|" in x]  # these may hold a special token
        ids, lengths = self._encode_words(plain) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int32))
        each = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in special]
        ids, lengths = np.concatenate([ids, *each]), np.concatenate((lengths, np.array(list(map(len, each)), np.int32)))
        self.row_of.update(zip(plain + special, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, (len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int32)))
        self.lengths, self.pool = np.concatenate((self.lengths, lengths)), np.concatenate((self.pool, ids))
        return np.fromiter(map(self.row_of.__getitem__, held), np.int64, len(held))


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit): each document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer is None:
            import public_tokenizers

        encoder = StretchEncoder.kept(tokenizer or public_tokenizers.path(TOKENIZER_FILE))
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                out: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"), end_id), strict=True):
                    first = (len(ids) - 1) % capacity + 1
                    for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                        start = end - capacity if k else 0
                        raw = ids[start:end].astype("<u4").tobytes()
                        out.append((doc_id, k, start, end - start, zlib.crc32(raw), raw if keep_ids else None))
                columns = list(zip(*out, strict=True))[: None if keep_ids else 5]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return map_arrow(docs.select("doc_id", "text"), cut, PIECES + (", ids binary" if keep_ids else ""))


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int, free: int):
        self.capacity, self.free = capacity, free
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by room
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        n, last = self.count, self.capacity - size
        change = 2 * (n[: last + 1] - n[size:] + 1)  # of the sum of squares, by the room that stays
        change[0] = 1 - 2 * n[size]  # a full bin is no longer open
        change[n[size:] == 0] = np.iinfo(np.int64).max
        change[last] = (2 * n[last] + 1 if last else 0) if self.opened < self.free else np.iinfo(np.int64).max - 1
        room = int(change.argmin())
        if room == last:
            at, self.opened = self.opened, self.opened + 1
        else:
            at = self.open[room + size].pop()
            n[room + size] -= 1
        if room:
            self.open[room].append(at)
            n[room] += 1
        return at, last - room


def placed(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """items (a staged table with length, doc_id, piece) with sequence_id and offset."""
    whole = items.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = items.where(F.col("length") < capacity)
    rows, tokens = short.agg(F.count("*"), F.sum("length")).first()
    shards = max(1, -(-rows // shard_rows))
    free = int(FREE * (tokens or 0) / shards / capacity)
    dealt = short.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col("length").desc(), "ids_crc32", "doc_id", "piece")

    names = items.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            found = []
            for shard, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if shard != now:
                    now, bins = shard, Bins(capacity, free)
                at, offset = bins.place(length)
                found.append((shard << 32 | at, offset))
            ids, offsets = zip(*found, strict=True) if found else ((), ())
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    return whole.unionByName(map_arrow(dealt, pack, whole.schema))


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, **parameters) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return placed(stage(pieces(docs, capacity=capacity, **parameters)), capacity, shard_rows)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences of pieces packed with keep_ids; a sequence has `capacity` pieces at most."""
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return held.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
