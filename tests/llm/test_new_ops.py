"""Collocations, packing and periodic runs on awkward rows, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_ops import SCHEMA, sentence, texts

from tissuemill.llm import collocations, packing, periodic

SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    few = [sentence(rng, 1) for _ in range(7)]
    more = ["".join(rng.choice([*few, *"  \t\n\r\x0b,.;:!?AZé ", " "]) for _ in range(80)) for _ in range(80)]
    more += [" ".join(rng.choice(few) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    more += ["tick tock " * 40, "a " * 3000, " ".join(["one two three four five six seven"] * 9), ", . ;", "x" * 5000]
    lang = [None, "en", "fr", "en", "und"]
    found = [(k, t, lang[k % 5], None, 0, 1, "x", 2, 3, 4) for k, t in enumerate([*texts(), *more])]
    return [*found, found[70], found[70], (None, "no id here here here", "en", None, 0, 1, "x", 2, 3, 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_collocations(rows, longest, least, top):
    f, out = collections.defaultdict(collections.Counter), []
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f[r[2] or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            holds = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in holds):
                continue
            score, _, l, r = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest, least, top, shard", [(3, 10, 2000, 1 << 20), (4, 3, 25, 200), (2, 5, 7, 3000)])
def test_collocations(docs, rows, empty, monkeypatch, longest, least, top, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    got = sorted(tuple(r) for r in collocations.collocations(docs, longest, least, top).collect())
    assert got == brute_collocations(rows, longest, least, top) and got
    assert collocations.collocations(empty).count() == 0


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ids = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 60))
        longest = int(rng.integers(1, 7))
        order, padded = collocations.suffix_array(ids, longest), [*ids.tolist(), *[-1] * longest]
        prefixes = [padded[i : i + longest] for i in order]
        assert prefixes == sorted(prefixes) and sorted(order) == list(range(len(ids)))
        expected = collections.Counter(tuple(ids[i : i + m].tolist()) for m in range(1, longest + 1) for i in range(len(ids) - m + 1))
        found = {tuple(ids[s : s + m].tolist()): c for m, starts, counts in collocations.intervals(ids, longest) for s, c in zip(starts, counts.tolist(), strict=True)}
        assert found == {p: c for p, c in expected.items() if 0 not in p}


def test_scores_of_large_counts(spark):
    """Products beyond 64 bits."""
    a, l, r = 10**14 + 1, 3 * 10**14 + 7, 10**15 - 1
    exact = {c: F.lit(v).cast("decimal(16,0)") for c, v in zip("alr", (a, l, r), strict=True)}
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact["a"] * exact["a"]), exact["l"] * exact["r"]).cast("long")
    assert spark.range(1).select(score).first()[0] == 10**6 * a * a // (l * r)


def test_stretch_encoder_equals_the_tokenizer():
    encoder = packing.StretchEncoder(public_tokenizers.path(packing.TOKENIZER_FILE))
    rng = random.Random(3)
    atoms = ["a", "é", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "'s", "'t", "12", "!", "…", "«", "日本", "<|endoftext|>", "<|", "\x1c", "\u0085", "ab", "Z", "\x0b", "😀", ".", "​", "﻿", "ß"]
    found = ["".join(rng.choice(atoms) for _ in range(rng.randrange(0, 25))) for _ in range(4000)] + ["", *texts()[1:]]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(found, add_special_tokens=False)]
    assert [x[:-1].tolist() for x in encoder.encode(pa.array(found), 2)] == expected
    assert [x.tolist() for x in encoder.encode(pa.array([None, *found[:3]]).slice(1), 2)] == [[*e, 2] for e in expected[:3]]


def test_packing(docs, rows, spark, empty):
    tokenizer = packing.StretchEncoder(public_tokenizers.path(packing.TOKENIZER_FILE)).tokenizer
    for capacity, shard_rows in ((1024, 8192), (64, 20)):
        got = packing.pack(docs, capacity=capacity, shard_rows=shard_rows, keep_ids=True).collect()
        expected = collections.Counter()
        for r in rows:
            ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
            first = (len(ids) - 1) % capacity + 1
            for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                start = end - capacity if k else 0
                expected[r[0], k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
        assert collections.Counter(tuple(r)[:5] for r in got) == expected
        held = collections.defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for parts in held.values():
            ends = [0, *np.cumsum([n for _, n in sorted(parts)])]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    df = spark.createDataFrame(got, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(df).collect()}
    assert all(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids for r in got)
    assert packing.pack(empty).count() == 0


def test_packing_is_tight():
    """Sum of squares over lengths of documents: at most 0.5 % more sequences than the tokens fill."""
    rng = np.random.default_rng(4)
    sizes = np.sort(np.minimum(1023, rng.lognormal(5.8, 1, 8192).astype(int) % 1024 + 1))[::-1]
    least = -(-sizes.sum() // 1024)
    bins = packing.Bins(1024, int(packing.FREE * sizes.sum() / 1024))
    for size in sizes.tolist():
        bins.place(size)
    assert least <= bins.opened <= least * 1.005 + 1


def brute_runs(w, least, exponent):
    """Every period in turn: stretches in which words a period apart agree, shortest period first."""
    ids, out = np.unique(w, return_inverse=True)[1] if len(w) else np.zeros(0, int), {}
    for p in range(1, len(w) // exponent + 1):
        differ = np.concatenate(([-1], np.flatnonzero(ids[:-p] != ids[p:]), [len(w) - p]))
        for at in np.flatnonzero(np.diff(differ) - 1 + p >= max(least, exponent * p)).tolist():
            start, end = int(differ[at]) + 1, int(differ[at + 1]) + p
            if not any(q < p and s <= start and end <= e for s, e, q in out.values()):
                out[start, p] = (start, end, p)
    return [(s, e - s, p) for (s, _), (_, e, p) in sorted(out.items())]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 60)
        w = [rng.randrange(1, k + 1) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        least, exponent = rng.choice([(3, 3), (4, 3), (24, 3), (2, 4)])
        found = [(int(a) - 1, int(b - a), int(q)) for a, b, q in periodic.runs_of(np.array([0, *w, 0]), least, exponent)]
        assert found == brute_runs(w, least, exponent)


def test_runs_where_hashes_deceive(monkeypatch):
    """A base that makes all sums collide: every answer comes from the words."""
    monkeypatch.setattr(periodic, "mix64", lambda x: np.where(x == 1, 1, 5).astype(np.uint64))
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(1, 4) for _ in range(12)] + [1, 2, 3] * rng.randrange(0, 12) + [rng.randrange(1, 4) for _ in range(9)]
        found = [(int(a) - 1, int(b - a), int(q)) for a, b, q in periodic.runs_of(np.array([0, *w, 0]), 24, 3)]
        assert set(found) <= set(brute_runs(w, 24, 3))


def tiled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(spark, docs, rows, empty, tmp_path):
    extra = [(10_000 + k, " ".join(random.Random(k).choices("abcdefgh", k=60 + k)), "en", None, 0, 1, "x", 2, 3, 4) for k in range(60)]
    docs.unionByName(spark.createDataFrame(extra, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    expected = collections.Counter()
    for r in [*rows, *extra]:
        w = tiled(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        runs = brute_runs(w, 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected[r[0], len(runs), *row, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = periodic.op13_periodic_runs(spark, str(tmp_path))
    assert collections.Counter(tuple(r) for r in got.collect()) == expected
    assert sum(n for row, n in expected.items() if row[1]) > 5
    assert periodic.periodic_runs(empty).count() == 0
