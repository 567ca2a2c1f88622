"""Token-ID output as sorted-string-table shards.

A shard is one immutable file:

    magic "TMSST2\\0\\0"
    data blocks   entries in ascending key order; keys are prefix-compressed inside a block
    filter        Bloom filter over the shard's keys
    index         sparse: first and last key, offset, length and first token position of each block
    footer        fixed 64 bytes: offsets and lengths of filter and index, number of entries, of tokens, magic

A key is nine bytes: 1 and the doc_id as 8 big-endian bytes with the sign bit flipped, so byte order is numeric order,
or nine zeros for a null doc_id. An entry is
varint(shared prefix) varint(rest of key) varint(tokens) rest; the token ids of a block follow its entries as
little-endian unsigned integers, 2 bytes wide if the vocabulary allows it and 4 otherwise, the whole block
compressed with zstandard. `lookup` asks the Bloom filter, bisects the index and decodes one block.

Writing: documents are dealt by ranges of (doc_id, hash of text) and sorted inside each range before they are
tokenized, so token ids are never shuffled and one doc_id's rows may fill many ranges. A task begins a new shard after
`shard_tokens` tokens or `shard_docs` documents, so neither a file nor what is held for its Bloom filter grows with the
range. Each shard is written under a name of its own attempt; the manifest, committed by Spark's output committer, names
the shards that count, so a lost executor or a repeated task leaves at most an unnamed file. The manifest has one row
for each shard, ordered by range and number.

Defined edge cases: a null or empty text has only the end id; a null doc_id sorts first; rows that repeat a doc_id are
entries with equal keys, in the order of a hash of their texts, then of the texts; an empty table gives no shards;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_strings, map_arrow, shared_dir, slices, split_words, stage, table

MAGIC = b"TMSST2\0\0"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_TOKENS = 32_768
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
END_ID = 2
SHARD_TOKENS = 1 << 26
SHARD_DOCS = 1 << 20
NO_KEY = bytes(9)
#: Words whose ids a worker keeps between batches; beyond it the memory starts anew.
MEMORY_WORDS = 1_000_000
ENCODE_BYTES = 8 << 20
TOKENIZER_FILE = "word_bpe_49k.json"

MANIFEST = "shard string, part int, number int, n_docs long, n_tokens long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_key(key: int | None) -> bytes:
    return NO_KEY if key is None else b"\1" + struct.pack(">Q", key + (1 << 63))


def decode_key(raw: bytes) -> int | None:
    return None if raw == NO_KEY else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def encode_block(keys: list[bytes], counts: list[int], ids: bytes) -> bytes:
    out, last = [varint(len(keys))], b""
    for key, count in zip(keys, counts, strict=True):
        shared = next((i for i, (a, b) in enumerate(zip(key, last, strict=False)) if a != b), min(len(key), len(last)))
        out += [varint(shared), varint(len(key) - shared), varint(count), key[shared:]]
        last = key
    head = b"".join(out)
    return zstandard.ZstdCompressor(level=1).compress(varint(len(head)) + head + ids)


def decode_block(raw: bytes) -> tuple[list[bytes], list[int], memoryview]:
    plain = zstandard.ZstdDecompressor().decompress(raw)
    length, at = read_varint(plain, 0)
    ids = memoryview(plain)[at + length :]
    n, at = read_varint(plain, at)
    keys, counts, last = [], [], b""
    for _ in range(n):
        shared, at = read_varint(plain, at)
        rest, at = read_varint(plain, at)
        count, at = read_varint(plain, at)
        last = last[:shared] + plain[at : at + rest]
        at += rest
        keys.append(last)
        counts.append(count)
    return keys, counts, ids


class Bloom:
    """Bits for a set of keys; double hashing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, digests: bytes) -> Bloom:
        """Of the digests of the keys, one after the other."""
        halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        flags = np.zeros(max(8, len(halves) * BLOOM_BITS_PER_KEY // 8 + 1) * 8, bool)
        for i in range(BLOOM_HASHES):
            flags[(halves[:, 1] + np.uint64(i) * (halves[:, 0] | np.uint64(1))) % np.uint64(len(flags))] = True
        return cls(np.packbits(flags, bitorder="little"))

    def _places(self, key: bytes) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key)
        first, second, n = h & (2**64 - 1), h >> 64 | 1, len(self.bits) * 8
        return [(first + i * second) % 2**64 % n for i in range(BLOOM_HASHES)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


class ShardWriter:
    """Takes documents in key order; blocks go out as they fill, so memory holds one block and the index."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.at = stream.write(MAGIC) or len(MAGIC)
        self.digests = bytearray()
        self.docs = 0
        self.index: list[bytes] = []
        self.tokens = 0
        self._start()

    def _start(self) -> None:
        self.block_keys: list[bytes] = []
        self.counts: list[int] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.block_keys.append(encode_key(key))
        self.counts.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.block_keys:
            return
        raw = encode_block(self.block_keys, self.counts, np.concatenate(self.ids).astype(f"<u{self.width}").tobytes())
        self.stream.write(raw)
        self.index.append(self.block_keys[0] + self.block_keys[-1] + struct.pack("<QQQ", self.at, len(raw), self.tokens))
        self.at += len(raw)
        self.digests += b"".join(map(xxhash.xxh3_128_digest, self.block_keys))
        self.docs += len(self.block_keys)
        self.tokens += self.held
        self._start()

    def close(self) -> None:
        self.flush()
        bloom, index = Bloom.of(bytes(self.digests)).bits.tobytes(), b"".join(self.index)
        self.stream.write(bloom + index)
        self.stream.write(FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.docs, self.tokens, self.width, MAGIC))
        self.stream.close()


class Shard:
    """Random access to a shard; reads the footer, then what a call needs."""

    ENTRY = struct.Struct("<9s9sQQQ")

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        bloom_at, bloom_n, index_at, index_n, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard")
        self.bloom = Bloom(np.frombuffer(self._read(bloom_at, bloom_n), np.uint8))
        self.index = list(self.ENTRY.iter_unpack(self._read(index_at, index_n)))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, entry: tuple) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """key, token position in the shard, ids."""
        _, _, at, n, start = entry
        keys, counts, raw = decode_block(self._read(at, n))
        ids, done = np.frombuffer(raw, f"<u{self.width}"), 0
        for key, count in zip(keys, counts, strict=True):
            yield key, start + done, ids[done : done + count]
            done += count

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for entry in self.index:
            for key, start, ids in self._block(entry):
                yield decode_key(key), start, ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry with this key: Bloom filter, then binary search in the sparse index."""
        key = encode_key(doc_id)
        if key not in self.bloom:
            return []
        found = []
        for entry in self.index[bisect.bisect_left(self.index, key, key=lambda e: e[1]) :]:
            if entry[0] > key:
                break
            found += [ids for k, _, ids in self._block(entry) if k == key]
        return found


class Encoder:
    """Ids of whole texts by way of their words.

    The tokenizer drops white space, never joins what white space parts, and takes A-Z for a-z outside its
    special strings; so a text's ids are those of its words in order, and each different word is encoded once.
    Words are encoded many at a time, with a special token between them that marks where each one ends. What a
    worker has encoded it keeps for later tasks, up to MEMORY_WORDS words.
    """

    SEPARATOR = "<|startoftext|>"
    TOGETHER = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self._forget()

    @classmethod
    def kept(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, rows of the pool
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        if self.separator is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int32)
        parts = []
        for at in range(0, len(words), 50 * self.TOGETHER):  # encodings are large, so few are held at once
            joined = [self.SEPARATOR.join([*words[i : i + self.TOGETHER], ""]) for i in range(at, min(at + 50 * self.TOGETHER, len(words)), self.TOGETHER)]
            parts += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.separator)
        return ids[ids != self.separator], np.diff(ends, prepend=-1).astype(np.int32) - 1

    def _learn(self, keys: np.ndarray, words: pa.Array) -> None:
        marked = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        for part in (~marked, marked):
            if part.any():
                chosen = words.filter(pa.array(part)).to_pylist()
                if part is marked:  # may hold a special token
                    each = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in chosen]
                    ids, lengths = np.concatenate(each), np.array(list(map(len, each)), np.int32)
                else:
                    ids, lengths = self._encode_words(chosen)
                rows = np.arange(len(self.lengths), len(self.lengths) + len(chosen), dtype=np.int32)
                self.starts = np.concatenate((self.starts, (len(self.pool) + np.cumsum(lengths) - lengths).astype(np.int32)))
                self.lengths = np.concatenate((self.lengths, lengths))
                self.pool = np.concatenate((self.pool, ids))
                self.keys, self.places = np.concatenate((self.keys, keys[part])), np.concatenate((self.places, rows))
        order = np.argsort(self.keys)
        self.keys, self.places = self.keys[order], self.places[order]

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of the pool that hold these words, new ones added."""
        words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        keys, first, back = np.unique(hash_strings(words), return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + new.sum() > MEMORY_WORDS:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(keys[new], words.take(pa.array(first[new])))
        return self.places[np.searchsorted(self.keys, keys)][back]

    def encode(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        offsets, codes, vocabulary = split_words(texts)
        rows = self._rows(vocabulary)[codes] if len(vocabulary) else np.zeros(0, np.int32)
        lengths = self.lengths[rows]
        stops = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        at = np.repeat(self.starts[rows] - stops[:-1].astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.pool[at]
        tail = np.array([end], np.uint32)
        for a, b in zip(stops[offsets[:-1]], stops[offsets[1:]], strict=True):
            yield np.concatenate((ids[a:b], tail))


#: By tokenizer file; lives as long as the Python worker.
_ENCODERS: dict[str, Encoder] = {}


def write_shards(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None, folder: str | None = None, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """Write docs (doc_id, text) and return the manifest: shard, part, number, n_docs, n_tokens.

    tokenizer: path of a vocabulary file on the workers; None stands for the public one that each worker looks up.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part_id, number = None, None, TaskContext.get().partitionId(), 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([part_id], pa.int32()), pa.array([number], pa.int32()), pa.array([writer.docs]), pa.array([writer.tokens])], ["shard", "part", "number", "n_docs", "n_tokens"]
            )

        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                encoder = encoder or Encoder.kept(tokenizer or default_tokenizer())
                for key, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"), end_id), strict=True):
                    if writer is None:
                        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                        shard = f"{folder}/{uuid.uuid4().hex}.sst"
                        fs, inner = pafs.FileSystem.from_uri(shard)
                        fs.create_dir(inner.rpartition("/")[0], recursive=True)
                        writer = ShardWriter(fs.open_output_stream(inner), width)
                    writer.add(key, ids)
                    if writer.tokens + writer.held >= shard_tokens or writer.docs + len(writer.block_keys) >= shard_docs:
                        yield closed()
                        writer, number = None, number + 1
        if writer is not None:
            yield closed()

    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    ranged = keyed.repartitionByRange(partitions, "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "text")
    return stage(map_arrow(ranged.select("doc_id", "text"), write, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32: all from the files.

    The offsets of the shards are a prefix sum over the manifest, one row for each shard; each travels with its
    shard to the task that reads it, so what is read is never joined, shuffled or broadcast.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, start, ids in Shard(path).scan():
                    rows.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return map_arrow(shards.repartition(max(1, manifest.count())), read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))
