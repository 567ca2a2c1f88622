"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct five-word shingles, as 64-bit hashes. Two documents link when
100 * |x & y| >= 80 * |x | y|. The result is the connected component of every document.

T-occurrence: a set of n shingles that links with another shares at least t(n) = ceil(0.8 n) of them with it, and
with one of m shingles at least T(n, m). DivideSkip parts a set's inverted lists into long ones, fewer than the
threshold, that are set aside, and short ones, that are merged; who occurs often enough in the short lists is then
looked up in the long ones. It works here at two levels.

Over the corpus: every pair that links shares a shingle among the n - t(n) + 1 short lists of both, under one order of
all lists. The order puts long lists last: lists with more than `long_list` entries are ordered by length, all others
come before them in the order of their hashes. The order decides only cost, any order gives the same links. The short
lists are built by one shuffle, and what they and the long ones can contribute bounds the overlap of a pair.

Inside a task: a set is the query, the sets that the short lists bring up for it are the index. Its inverted lists over
them are parted again; the short ones are merged by a heap, and each set that occurs there at least T - L times is
binary-searched in the L long ones until the overlap is reached or out of reach (`divide_skip`). Every link of the
result comes from this search.

Steps, all on DataFrames:
1. Two passes over the texts: lengths of the lists that may become short ones of a set (half as many again as it needs),
   then of all lists of sets for which even those do not suffice, since long ones crowd them (map-side combine). So a list not
   known as long has at most `long_list` entries from each pass.
2. Third pass: each document's set size, set signature and short lists. Documents with equal sets are one node.
3. The short lists are dealt by shingle; entries of long lists are salted into blocks. A block is merged in a
   streaming pass over its sorted entries, so no list is ever held; lists with one node go, except that of a list
   dealt over several blocks every node stays, as its partners may lie in other blocks.
4. Star rounds: in every list the nodes of like size are paired with one pivot of that size and one of the size
   below; of its partners a node keeps the one it meets most often. The first round's pivots are the nodes with most
   long lists among their short ones, which have least for themselves. Links give components, so large groups of near
   copies collapse without pairs. Later rounds take other pivots, across components only, as long as the lists left
   would make many pairs.
5. Rest: pairs across components that can still reach the required overlap. Pairs that meet in a list that is not
   long are counted over those lists, and what lies outside them bounds the rest of the overlap. Pairs that meet in
   long lists only cannot share more than their long lists, and come up only if both have enough of them for their
   sizes, by which these lists are joined. Of the pairs between two components the most promising is searched first, the
   others only if it did not link them. Together the rounds lose no link between components.

A query with many candidates is dealt in parts of GROUP candidates, each with a copy of the query, so a pivot that a
large group shares is no hot key. Long lists are broadcast while there are at most `broadcast_lists`; beyond that only
the longest are, which costs speed, not links. Candidates are told to later passes by broadcast up to
`broadcast_nodes`, by join beyond it.

Defined edge cases: words are what lies between the six ASCII white-space characters, with A-Z lower-cased;
a text of one to four words has one shingle, the whole sequence; null, empty and blank texts have no shingles,
link with nothing and are their own component; rows that repeat a doc_id are documents of their own, each with the
component of its text, and a component is named by the smallest doc_id that any of its rows has; an empty table gives
an empty result; further columns are ignored. A null doc_id takes part and yields to any other as the name of a
component.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, hash_strings, map_arrow, mix64, release, slices, split_words, stage, table

SHINGLE = 5
PER_CENT = 80
LONG_LIST = 64
BLOCK = 20_000
#: Sizes within this ratio make a band.
BAND = 1.05
BROADCAST_LISTS = 2_000_000
BROADCAST_NODES = 4_000_000

#: Ratio of sizes within which nodes of a list count as of like size.
LIKE = 1.1
STAR_ROUNDS = 2
#: Further star rounds follow, at most so many in all, while the lists left hold more pairs than this for each entry.
MOST_ROUNDS = 6
PAIRS_PER_ENTRY = 2_000
#: Candidates of a query that are searched together, and bytes of their sets that a task holds.
GROUP = 512
GROUP_BYTES = 32 << 20
#: Cost of a binary search in a list of length M is MU * log2(M) of that of merging one list, as the method's authors measured.
MU = 0.0085

SETS = "doc_id long, text_key long, n int, sig long, plain int, short array<long>"


def least_overlap(n, per_cent: int = PER_CENT):
    """t(n): what a set of n shares at least with any set it links with."""
    return -(-n * per_cent // 100)


def required(n, m, per_cent: int = PER_CENT):
    """T(n, m): smallest overlap that links sets of n and m. i >= q (n + m - i) <=> i >= q (n + m) / (1 + q)."""
    return -(-per_cent * (n + m) // (100 + per_cent))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    offsets, codes, words = split_words(pc.ascii_lower(texts))
    hashes = hash_strings(words)
    hashed = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    factor = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashed) - size + 1
    whole = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        whole += hashed[k : k + len(whole)] * factor[k]
    whole = mix64(whole)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(whole[a : b - size + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif b > a:
            yield mix64((hashed[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signature(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def divide_skip(lists: list[Sequence[int]], need: Sequence[int]) -> Iterator[int]:
    """Who occurs in at least need[who] of the lists, which are sorted.

    The longest lists, fewer than any need, are set aside; the others are merged by a heap. Who occurs there often
    enough to reach its need with all of the long ones is binary-searched in these, until it has or cannot any more.
    """
    lists = sorted(filter(len, lists), key=len)
    least = min(need, default=0)
    if not lists or not 0 < least <= len(lists):
        return
    n_long = min(least - 1, int(least / (MU * math.log2(len(lists[-1])) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for who, occurrences in itertools.groupby(heapq.merge(*short)):
        have, want = sum(1 for _ in occurrences), need[who]
        if have + n_long < want:
            continue
        for left, entries in zip(range(n_long, 0, -1), long, strict=True):
            if have >= want or have + left < want:
                break
            at = bisect.bisect_left(entries, who)
            have += at < len(entries) and entries[at] == who
        if have >= want:
            yield who


def linked(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of the sorted sets link with the sorted query: T-occurrence search in the query's inverted lists over them."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    held = query[at] == flat
    at, owner = at[held], owner[held]
    entries = owner[np.argsort(at, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(at, minlength=len(query))).tolist()
    need = [int(required(len(query), len(x))) for x in sets]
    return list(divide_skip([entries[a:b] for a, b in zip([0, *ends], ends, strict=False)], need))


class Order:
    """Where each list stands: 0, or its length if it is long."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.lengths = keys[order], lengths[order]

    def rank(self, found: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(found), np.int64)
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == found, self.lengths[at], 0)

    def short(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        """The set's short lists, and how many of them are not long."""
        n = len(found)
        if not n:
            return found, 0
        first = n - int(least_overlap(n)) + 1
        rank = self.rank(found)
        if not rank.any():
            return found[:first], first
        return found[np.lexsort((found, rank))[:first]], min(first, int(np.count_nonzero(rank == 0)))

    def counted(self, found: np.ndarray) -> np.ndarray:
        """The lists of a set to be counted: those first in the plain order, half as many again as it has short ones, while
        no long list is known; then all that are not long, if that leaves too few of the first ones."""
        n_short = len(found) - int(least_overlap(len(found))) + 1 if len(found) else 0
        first = found[: n_short + (n_short + 1) // 2]
        if not len(self.keys):
            return first
        return found[self.rank(found) == 0] if np.count_nonzero(self.rank(first) == 0) < n_short else found[:0]


def _sets(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n, sigs, plain, short = [], [], [], []
            for found in shingle_sets(part.column("text")):
                n.append(len(found))
                sigs.append(signature(found))
                chosen, not_long = order.short(found)
                plain.append(not_long)
                short.append(chosen)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("text_key"), pa.array(n, pa.int32()), pa.array(sigs, pa.int64()), pa.array(plain, pa.int32()), _lists(short)],
                ["doc_id", "text_key", "n", "sig", "plain", "short"],
            )


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(parts) if parts else np.zeros(0, np.uint64))))


def _list_lengths(batches: Iterator[pa.RecordBatch], known: Order) -> Iterator[pa.RecordBatch]:
    """Lists counted inside slices before they travel; equal sets of a slice count once."""
    for batch in batches:
        for part in slices(batch, "text"):
            of_sets = {signature(found): known.counted(found) for found in shingle_sets(part.column("text"))}
            keys, n = np.unique(np.concatenate(list(of_sets.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n, pa.int64())], ["shingle", "n"])


def long_lists(docs: DataFrame, long_list: int = LONG_LIST, most: int = BROADCAST_LISTS) -> Order:
    keys, lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(2):
        told = docs.sparkSession.sparkContext.broadcast(Order(keys, lengths))
        counted = map_arrow(docs.select("text"), lambda it, told=told: _list_lengths(it, told.value), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        rows = counted.where(F.col("n") > long_list).orderBy(F.col("n").desc(), "shingle").limit(most - len(keys)).toPandas()
        keys = np.concatenate((keys, rows["shingle"].to_numpy(np.int64).view(np.uint64)))
        lengths = np.concatenate((lengths, rows["n"].to_numpy(np.int64)))
        del counted
        release(docs.sparkSession)
        if not len(keys) or len(keys) >= most:
            break
    return Order(keys, lengths)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (list, block, sig): drops repeats and lists with one node. Holds one entry and a batch.

    Blocks from 1 up are parts of a list: one node alone there may meet nodes of other blocks and stays.
    """
    last, told = None, False
    for batch in batches:
        lists, blocks, sigs = (batch.column(c).to_numpy() for c in ("shingle", "block", "sig"))
        if not len(lists):
            continue
        new_list = np.concatenate(([last is None or (lists[0], blocks[0]) != last[:2]], (lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1])))
        new_node = new_list | np.concatenate(([last is None or sigs[0] != last[2]], sigs[1:] != sigs[:-1]))
        lists, blocks, sigs, new_list = lists[new_node], blocks[new_node], sigs[new_node], new_list[new_node]
        if not len(lists):
            continue
        again = np.concatenate((~new_list[1:], [False]))  # the next entry is in this list
        keep = ~new_list | again | (blocks > 0)
        carried = not new_list[0] and not told  # the list's first entry ended the batch before
        if carried:
            lists, blocks, sigs = (np.concatenate(([v], x)) for v, x in zip(last, (lists, blocks, sigs), strict=True))
            keep = np.concatenate(([True], keep))
        told = bool(keep[-1])
        last = (lists[-1], blocks[-1], sigs[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(lists[keep]), pa.array(blocks[keep], pa.int32()), pa.array(sigs[keep])], ["shingle", "block", "sig"])


def _components(links: DataFrame) -> DataFrame:
    """links: a, b (nodes). node, root: the smallest node reachable. Large-star and small-star in turn.

    Both steps keep connectivity and end in stars. Each round is written to the shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    known = digest(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        new = stage(small.where("u <> v").distinct())
        discard(edges)
        edges, before, known = new, known, digest(new)
        if known == before:  # equal in number and in a 64-bit digest
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._staged_at = edges._staged_at
    return out


def _need(n: str, m: str) -> Column:
    return F.ceil(PER_CENT * (F.col(n) + F.col(m)) / (100 + PER_CENT))


def _after(n: str) -> Column:
    """Tokens of a set that come after its short lists."""
    return F.ceil(F.col(n) * PER_CENT / 100) - 1


class Join:
    """One run over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, long_list: int = LONG_LIST, block_size: int = BLOCK, broadcast_lists: int = BROADCAST_LISTS, broadcast_nodes: int = BROADCAST_NODES, star_rounds: int = STAR_ROUNDS, group: int = GROUP):
        self.docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
        self.broadcast_nodes, self.star_rounds, self.group = broadcast_nodes, star_rounds, group
        spark = docs.sparkSession
        order = long_lists(self.docs, long_list, broadcast_lists)
        told = spark.sparkContext.broadcast(order)
        self.sets = stage(map_arrow(self.docs, lambda it: _sets(it, told.value), SETS))
        self.nodes = self.sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("plain").alias("plain"))
        entries = self.sets.select("sig", "plain", F.posexplode("short").alias("at", "shingle"))
        block = F.when(F.col("at") < F.col("plain"), -1).otherwise(0)  # -1: not a long list, 0: a whole one, from 1 up: a part of one
        big = order.keys[order.lengths > block_size]
        if len(big):  # lists too long for one task are dealt in blocks
            n = (order.lengths[order.lengths > block_size] // block_size + 1).tolist()
            salted = spark.createDataFrame(list(zip(signed(big).tolist(), n, strict=True)), "shingle long, blocks int")
            entries = entries.join(F.broadcast(salted), "shingle", "left")
            block = F.when(block < 0, block).otherwise(F.coalesce(F.pmod(F.xxhash64("sig"), F.col("blocks")) + 1, F.lit(0)))
        entries = entries.select("shingle", block.cast("int").alias("block"), "sig")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        entries = entries.repartition(parts, "shingle", "block").sortWithinPartitions("shingle", "block", "sig")
        self.shared = stage(map_arrow(entries, _merge_blocks, "shingle long, block int, sig long"))
        del entries
        release(spark)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """pairs: a, b -> those that link, by T-occurrence search: b is the query, its a the index. Sets come from the
        texts of the nodes in question."""
        spark = pairs.sparkSession
        asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
        asked = stage(self.nodes.join(asked, "sig").select("sig", "rep"))
        ids = asked.select("rep").distinct()
        if asked.count() <= self.broadcast_nodes:
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = list(shingle_sets(part.column("text")))
                    yield pa.RecordBatch.from_arrays([pa.array([signature(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["sig", "held"])

        held = map_arrow(texts, full, "sig long, held binary").dropDuplicates(["sig"])
        crowded = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > self.group).select("b", F.ceil(F.col("c") / self.group).alias("parts"))
        dealt = pairs.join(crowded, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
        index = dealt.join(held.withColumnRenamed("sig", "a"), "a").select("b", "part", "a", "held")
        queries = dealt.select("b", "part").distinct().join(held.withColumnRenamed("sig", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "held")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        together = queries.unionByName(index).repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query, who, names, sets, size = None, None, [], [], 0

            def hits() -> pa.RecordBatch:
                found = [names[k] for k in linked(query, sets)]
                return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([who] * len(found), pa.int64())], ["a", "b"])

            for batch in batches:
                for b, a, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "held")), strict=True):
                    if sets and (a is None or size > GROUP_BYTES):
                        yield hits()
                        names, sets, size = [], [], 0
                    if a is None:
                        query, who = np.frombuffer(raw, np.uint64), b
                    else:
                        names.append(a)
                        sets.append(np.frombuffer(raw, np.uint64))
                        size += len(raw)
            if sets:
                yield hits()

        out = stage(map_arrow(together, search, "a long, b long"))
        discard(asked)
        del held, index, queries, together
        release(spark)
        return out

    def _stars(self, placed: DataFrame, seed: int) -> DataFrame:
        """placed: shingle, sig, n, long_short, root. For each node the pivot of another component that it meets most often, if
        often enough that a link is to be hoped for."""
        like = F.floor(F.log(F.col("n").cast("double")) / float(np.log(LIKE))).cast("int")
        own = F.lit(0) if seed else -F.col("long_short")
        placed = placed.select("shingle", "sig", "n", "root", own.alias("own"), like.alias("like"))
        pivots = placed.groupBy("shingle", "like").agg(F.min(F.struct("own", F.xxhash64(F.lit(seed), "sig").alias("h"), "sig", "n", "root")).alias("p"))
        pivots = pivots.select("shingle", "like", F.col("p.sig").alias("pivot"), F.col("p.n").alias("m"), F.col("p.root").alias("pivot_root"))
        sides = placed.select("shingle", "sig", "n", "root", F.explode(F.array("like", F.col("like") - 1)).alias("like"))
        met = sides.join(pivots, ["shingle", "like"]).where("root <> pivot_root").groupBy("sig", "pivot", "n", "m").agg(F.count("*").alias("c"))
        hope = F.col("c") * 2 >= _need("n", "m") - F.greatest(_after("n"), _after("m"))
        return stage(met.where(hope).groupBy("sig").agg(F.max_by("pivot", F.struct("c", "pivot")).alias("b")).select(F.col("sig").alias("a"), "b"))

    def _placed(self, sized: DataFrame, links: DataFrame) -> DataFrame:
        """The entries of lists that several components meet in."""
        roots = _components(links)
        placed = sized.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        several = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
        out = stage(placed.join(several, "shingle", "left_semi"))
        discard(roots)
        return out

    def _rest(self, placed: DataFrame) -> DataFrame:
        """a, b, root_a, root_b, c: pairs across components that may link.

        outside: tokens of a set not in its plain short lists; long_short: long lists among its short ones. A pair
        shares at most c plain short lists, and then no more than what lies outside of them in the smaller (if both
        sets have all their plain lists among the short ones), nor more than the long lists that both have among
        the short ones and what follows the short lists of one of them.
        """
        columns = ["shingle", "block", "sig", "n", "outside", "long_short", "root", "band"]
        band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")
        # The smaller set stands in its band of sizes; the larger one looks into the bands of sizes it can link with, for a
        # long list only those for which its long lists among the short ones make up for what the others lack: from
        # T(n, m) <= long_short + after(n) follows m <= (long_short + after(n)) (1 + q) / q - n.
        most = F.floor((F.col("long_short") + _after("n")) * (100 + PER_CENT) / PER_CENT - F.col("n"))
        low, high = F.ceil(F.col("n") * PER_CENT / 100), F.when(F.col("block") < 0, F.col("n")).otherwise(F.least(most, F.col("n")))
        x = placed.withColumn("band", band(F.col("n"))).select(*columns)
        y = placed.where(high >= low).withColumn("band", F.explode(F.sequence(band(low), band(high))))
        y = y.select("shingle", "band", *(F.col(c).alias(f"{c}_b") for c in columns[1:-1]))
        both = F.least("long_short", "long_short_b")
        inside = F.when(both > 0, F.least("outside", "outside_b")).otherwise(F.greatest("outside", "outside_b"))
        lack = _need("n", "n_b") - F.least(inside, both + F.greatest(_after("n"), _after("n_b")))
        fits = (F.col("n") < F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("sig") < F.col("sig_b"))
        fits &= (F.col("root") != F.col("root_b")) & (F.col("n") * 100 >= F.col("n_b") * PER_CENT)
        fits &= (F.col("block") < 0) | (lack <= 0)
        pair = [F.col("sig").alias("a"), F.col("sig_b").alias("b"), F.col("root").alias("root_a"), F.col("root_b")]
        met = x.join(y, ["shingle", "band"]).where(fits).select(*pair, (F.col("block") < 0).cast("int").alias("plain"), lack.cast("int").alias("lack"))
        met = met.groupBy("a", "b", "root_a", "root_b").agg(F.sum("plain").alias("c"), F.max("lack").alias("lack")).where("c >= lack")
        return stage(met.drop("lack"))

    def links(self) -> DataFrame:
        """a, b: links between nodes that connect all that links connect."""
        short = F.col("n") - _after("n")
        nodes = self.nodes.select("sig", "n", (F.col("n") - F.col("plain")).alias("outside"), (short - F.col("plain")).cast("int").alias("long_short"))
        sized = stage(self.shared.join(nodes, "sig"))
        discard(self.shared)
        stars = self._stars(sized.withColumn("root", F.col("sig")), 0)
        links = self._verify(stars)
        for seed in range(1, MOST_ROUNDS):
            placed = self._placed(sized, links)
            discard(stars)
            if seed >= self.star_rounds and not _many_pairs(placed):
                break
            stars = self._stars(placed, seed)
            links = links.unionByName(self._verify(stars))
            discard(placed)
        else:
            discard(stars)
            placed = self._placed(sized, links)
        rest = self._rest(placed)
        between = [F.least("root_a", "root_b").alias("lo"), F.greatest("root_a", "root_b").alias("hi")]
        best = stage(rest.groupBy(*between).agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p")).select("p.a", "p.b"))
        found = self._verify(best)
        links = links.unionByName(found)
        roots, left = _components(links), rest
        for side in "ab":
            left = left.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"now_{side}")), side, "left")
        apart = F.coalesce("now_a", "a") != F.coalesce("now_b", "b")
        others = stage(left.where(apart).select("a", "b").join(best, ["a", "b"], "left_anti"))
        links = links.unionByName(self._verify(others))
        discard(sized, placed, rest, best, others, roots)
        return links

    def rows(self) -> DataFrame:
        """doc_id, text_key, n, sig, root: for each row of docs its set and the node that stands for its component."""
        roots = _components(self.links())
        return self.sets.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "text_key", "n", "sig", F.coalesce("root", "sig").alias("root"))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        rows = self.rows()
        names = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        rows = rows.join(names, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")))
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _many_pairs(placed: DataFrame) -> bool:
    """Whether the lists would make many pairs for each of their entries."""
    n = placed.groupBy("shingle").agg(F.count("*").cast("double").alias("n"))
    entries, pairs = n.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return (pairs or 0.0) > PAIRS_PER_ENTRY * (entries or 0.0)


def components(docs: DataFrame, **parameters) -> DataFrame:
    return Join(docs, **parameters).components()


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row for each component: that of its smallest doc_id (a null one last), then of the smallest text hash.

    Rows without shingles are components of their own and all stay. Rows equal in doc_id and text are one document
    given twice, of which an arbitrary one stays.
    """
    rows = stage(Join(docs, **parameters).rows().where("n > 0"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = rows.groupBy("root").agg(F.min(place).alias("kept"))
    at = rows.join(kept, "root").where(~place.eqNullSafe(F.col("kept")))
    gone = at.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key"))
    out = keyed.join(gone, same, "left_anti")
    twice = rows.groupBy("doc_id", "text_key").agg(F.count("*").alias("times")).where("times > 1")
    if not twice.isEmpty():
        has_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) > 0
        out = out.where(has_words).dropDuplicates(["doc_id", "_key"]).unionByName(out.where(~has_words))
    return out.drop("_key")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
