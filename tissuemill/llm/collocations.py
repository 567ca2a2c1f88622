"""Phrase collocations by word-id suffix arrays.

Texts are lower-cased (A-Z) and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, the pieces into words `[^\\x20\\x09]+`; phrases
do not cross pieces. Everything is counted for each language.

Phrases are counted length by length, a pass over the texts for each. A shard is a slice of a partition. Its words become
ids, with a mark behind every piece; a suffix array of the ids is built by prefix doubling, which ends once prefixes reach
the length in question, since the order beyond decides nothing. Neighbours in it give the longest common prefixes, and an
interval of suffixes whose common prefixes are at least m words is one phrase of m words with as many occurrences as it is
long. Shards emit (language, phrase, count), and the counts are merged by key.

Of a frequent phrase every part is as frequent itself. So from the second pass on a shard leaves out what holds a shorter
phrase that is not frequent. Frequent phrases are told by one bit for the hash of each, 16 MB at most whatever their number:
a phrase that only shares a bit comes along and is counted for nothing, none is lost.

A candidate is a phrase of 2 to `longest` words with a >= least occurrences. Cut after k words it scores
floor(1000000 a^2 / (l r)), l and r being the occurrences of the two parts; the lowest-scoring cut counts (ties: the
smallest k). A candidate that lies inside a longer candidate with at least half of its occurrences goes. Scores are
exact: decimals of 38 digits hold the products of counts below 10^15.

Skew: counts are combined in each shard before they travel; the joins with the parts have one row for each part on one side, so a
frequent word multiplies nothing, and adaptive execution splits its partition. The best of a language are chosen in two
steps, first among those of one of SALTS slices.

Defined edge cases: null and empty texts and texts of separators have no words and count nothing; a null lang is
`und`; rows that repeat count each time; other white space than blanks and line ends belongs to words; an empty table
gives an empty result; further columns are ignored. A text is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, mix64, slices, stage, table

LONGEST = 3
LEAST = 10
TOP = 2000
#: Texts of so many bytes make a shard.
SHARD_BYTES = 8 << 20
SALTS = 64
#: Bits that mark frequent phrases, as a power of two, and the block of them that is merged by itself.
MOST_BITS = 27
BLOCK_BYTES = 1 << 14
BLOCKS = "block int, bits binary"
BATCH = 100_000

#: What a byte becomes: capitals small, blanks and separators a blank; and whether it ends a piece.
BLANKS, SEPARATORS = b" \t", b".,;:!?\x0a\x0b\x0c\x0d"
_BYTES = np.arange(256, dtype=np.uint8)
PLAIN = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, np.where(np.isin(_BYTES, list(BLANKS + SEPARATORS)), 32, _BYTES)).astype(np.uint8)
ENDS_PIECE = np.isin(_BYTES, list(SEPARATORS))


def words_and_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(codes, piece, text, vocabulary): each word's place in the vocabulary and the numbers of its piece and its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, plain = offsets - offsets[0], PLAIN[raw]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]))
    words = lists.flatten()
    coded = words.filter(pc.not_equal(words, "")).dictionary_encode()
    inside = plain != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.searchsorted(np.flatnonzero(ENDS_PIECE[raw]), starts) + text  # grows at a separator and from one text to the next
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, text, coded.dictionary


def suffix_array(ids: np.ndarray, longest: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first `longest` ids at least: ranks of prefixes are paired until they reach that far."""
    rank, reach = (ids if ids.max(initial=0) < 1 << 31 else np.unique(ids, return_inverse=True)[1]).astype(np.int64), 1
    if longest == 1:
        return np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-reach] = rank[reach:] + 1
        pairs = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(pairs, kind="stable")
        reach *= 2
        if reach >= longest:
            return order
        sorted_pairs = pairs[order]
        rank[order] = np.concatenate(([0], np.cumsum(sorted_pairs[1:] != sorted_pairs[:-1])))


def intervals(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, start, count): for each m up to the longest the different runs of m ids that hold no mark (id 0), as the place
    of one occurrence and their number."""
    if not len(ids):
        return
    order = suffix_array(ids, longest)
    padded = np.concatenate((ids, np.zeros(longest, ids.dtype)))
    real, same = np.ones(len(order), bool), np.ones(len(order) - 1, bool)
    for m in range(1, longest + 1):
        at = padded[order + m - 1]
        real &= at != 0  # the prefix of m ids ends before a mark
        same &= at[1:] == at[:-1]  # and equals that of the suffix before: the common prefix is m at least
        opens = np.flatnonzero(np.concatenate(([True], ~same)))
        counts = np.diff(np.append(opens, len(order)))
        kept = real[opens]
        yield m, order[opens[kept]], counts[kept]


def chained(hashes: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place on, from those of the words."""
    padded = np.concatenate((hashes, np.zeros(m, np.uint64)))
    out = np.zeros(len(hashes), np.uint64)
    for k in range(m):
        out += mix64(padded[k : k + len(hashes)] + np.uint64(k))
    return mix64(out)


class Seen:
    """Which phrases may be frequent: one bit for each hash, so every frequent phrase is in, and few others are."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def string_hashes(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(strings))


def word_hashes(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of words of a language, from the hashes of both."""
    return mix64(word ^ mix64(lang))


def seen_of(frequent: DataFrame, m: int) -> Seen:
    """frequent: lang, phrase of m words. Tasks set their own bits; blocks of them are merged by a shuffle. The bits, 16 for
    each phrase, MOST_BITS at most, reach the driver."""
    n = 1 << min(MOST_BITS, max(20, (16 * frequent.count()).bit_length()))

    def blocks(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for at, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                words = pc.split_pattern(batch.column("phrase"), " ").flatten()
                at = chained(word_hashes(string_hashes(batch.column("lang")).repeat(m), string_hashes(words)), m)[::m] & np.uint64(n - 1)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield from blocks({k: part for k, part in enumerate(np.split(bits, n // 8 // BLOCK_BYTES)) if part.any()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                held[at] = held.get(at, 0) | np.frombuffer(raw, np.uint8)
        yield from blocks(held)

    rows = map_arrow(map_arrow(frequent.select("lang", "phrase"), own, BLOCKS).repartition("block"), merged, BLOCKS).collect()
    bits = np.zeros(n // 8, np.uint8)
    for at, raw in rows:
        bits[at * BLOCK_BYTES : (at + 1) * BLOCK_BYTES] = np.frombuffer(raw, np.uint8)
    return Seen(bits)


def _phrases(batches: Iterator[pa.RecordBatch], m: int, seen: Seen | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            codes, piece, text, words = words_and_pieces(part.column("text"))
            if not len(codes):
                continue
            langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
            ids = codes * len(langs.dictionary) + of + 1  # a word of one language is another id than in the next
            marks = np.flatnonzero(piece[1:] != piece[:-1]) + 1
            marked = np.insert(ids, marks, 0)
            if seen:
                hashes = word_hashes(string_hashes(langs.dictionary)[of], string_hashes(words)[codes])
                known = np.append(seen.has(chained(np.insert(hashes, marks, 0), m - 1)), False)  # of the m - 1 words from each place on
                held = np.zeros(len(marked), bool)
                for k in range(m - 1):
                    held[k:] |= known[: len(marked) - k]
                marked[~held] = 0  # a word of no frequent phrase ends phrases as a mark does
            for size, starts, counts in intervals(marked, m):
                if size < m:
                    continue
                if seen:
                    fits = known[starts] & known[starts + 1]
                    starts, counts = starts[fits], counts[fits]
                own = marked[starts]
                phrase = words.take(pa.array((own - 1) // len(langs.dictionary)))
                for k in range(1, m):
                    phrase = pc.binary_join_element_wise(phrase, words.take(pa.array((marked[starts + k] - 1) // len(langs.dictionary))), pa.scalar(" ", pa.large_string()))
                lang = langs.dictionary.take(pa.array((own - 1) % len(langs.dictionary)))
                for at in range(0, len(own), BATCH):
                    some = slice(at, at + BATCH)
                    yield pa.RecordBatch.from_arrays([lang[some].cast(pa.string()), phrase[some].cast(pa.string()), pa.array(counts[some].astype(np.int64))], ["lang", "phrase", "f"])


def phrase_counts(docs: DataFrame, m: int, seen: Seen | None = None) -> DataFrame:
    """lang, phrase, f: phrases of m words and their occurrences; with `seen` only those whose parts of m - 1 words are in it."""
    told = docs.sparkSession.sparkContext.broadcast(seen)
    shards = map_arrow(docs.select("text", "lang"), lambda it: _phrases(it, m, told.value), "lang string, phrase string, f long")
    return shards.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))  # shards are combined already


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` candidates of each language by score, a, phrase."""
    counted, seen = [], None
    for m in range(1, longest + 1):
        found = phrase_counts(docs, m, seen)
        counted.append(stage(found if m == 1 else found.where(F.col("f") >= least)))
        if m < longest:
            seen = seen_of(counted[-1].where(F.col("f") >= least), m)
    sizes = counted[0].groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = reduce(DataFrame.unionByName, (df.where(F.col("f") >= least).withColumn("m", F.lit(m)) for m, df in enumerate(counted, 1)))
    words = F.split("phrase", " ")
    some = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    candidates = frequent.where("m >= 2").withColumn("words", words)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "m", F.col("f").alias("a"), "k", some(F.lit(1), F.col("k")).alias("head"), some(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cut = cuts.join(parts.withColumnsRenamed({"part": "head", "f": "l"}), ["lang", "head"]).join(parts.withColumnsRenamed({"part": "tail", "f": "r"}), ["lang", "tail"])
    exact = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact["a"] * exact["a"]), exact["l"] * exact["r"]).cast("long")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("m >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    longer = inner.groupBy("lang", some(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * a")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    out = stage(rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(*counted)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split) CROSS JOIN (VALUES (1), (2), (3)) AS sizes(m)
  WHERE i + m - 1 <= len(w)
), counts AS MATERIALIZED (
  SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), parts AS MATERIALIZED (
  SELECT {'lang': lang, 'phrase': phrase} AS part, f FROM counts WHERE f >= 10
), cuts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS tail
  FROM counts CROSS JOIN (VALUES (1), (2)) AS places(k) WHERE m >= 2 AND k < m AND f >= 10
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f * t.f) AS score
  FROM cuts c JOIN parts h ON h.part = {'lang': c.lang, 'phrase': c.head} JOIN parts t ON t.part = {'lang': c.lang, 'phrase': c.tail}
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[k : k + 1], ' ') AS phrase, max(f) AS longer
  FROM counts CROSS JOIN (VALUES (1), (2)) AS places(k) WHERE m = 3 AND f >= 10 GROUP BY ALL
), kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase AND w.m = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * w.a
), sizes AS (
  SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
