"""The ten operators on small fixtures with awkward rows, against brute force."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tissuemill.llm import catalog, chat, decontaminate, licenses, line_dedup, mixing, ngram_join, order_minhash, privacy, quality, sstable
from tissuemill.llm.common import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, n int, block int, part int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(2, 6))) for _ in range(n))


def texts():
    rng = random.Random(4)
    base = [sentence(rng, rng.randrange(6, 60)) for _ in range(25)]
    lines = ["\n".join(sentence(rng, 5) for _ in range(6)) for _ in range(4)]
    near = []
    for t in base[:8]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    long = sentence(rng, 20_000)
    more = ["Mail a.b@c-d.org or +1 (743) 555-3824 now", "card 4111 1111 1111 1111 and 1.2.3.4 and 999.1.1.1", "Releaséd\nReleased under the MIT License.\nend", "x", "\t \n", "日本 語 😀 text"]
    more += ["a\nb\nc\nd\n" + lines[0], lines[0] + "\n" + lines[1], lines[1], "a\nb\nc"]
    return [None, "", *base, *near, *base[:3], *lines, *more, long, long + " tail"]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 3 % 101, t, "en", [None, "", "s1", "s1", "s1", "zß"][i % 6], len(t or ""), 1, "x", 2, 3, 4) for i, t in enumerate(texts())]
    return [*found, found[5], found[5], (None, "no id here at all", "en", "s1", 0, 1, "x", 2, 3, 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(rows):
    """Rows with an identifier of their own."""
    seen = collections.Counter(r[0] for r in rows)
    return [r for r in rows if r[0] is not None and seen[r[0]] == 1]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    order = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows})
    seen, covered = set(), collections.defaultdict(set)
    for i, text in order:
        lines = text.split("\n")
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                covered[i] |= {k, k + 1, k + 2}
            seen.add(window)
    for i, text in order:
        kept = [x for k, x in enumerate(text.split("\n")) if k not in covered[i]]
        r = got[None if i < 0 else i]
        assert (r.text, r.n_removed) == ("\n".join(kept), len(covered[i]))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    """What one text repeats is not taken from another text of the same doc_id, or of none."""
    texts = {name: "\n".join(f"{name}{k}" for k in range(6)) for name in "abcd"}
    rows = [(1, texts["a"]), (1, texts["b"]), (7, texts["c"]), (7, texts["d"]), (7, texts["d"]), (None, texts["a"].replace("a", "e")), (None, texts["a"] + "\nnull"), (9, texts["a"]), (9, "x\ny\nz\nu\nv\nw")]
    got = collections.Counter(tuple(r) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {
        (1, "", 6, 6): 1, (1, texts["b"], 6, 0): 1, (7, texts["c"], 6, 0): 1, (7, texts["d"], 6, 0): 2, (None, texts["a"].replace("a", "e"), 6, 0): 1,
        (None, texts["a"] + "\nnull", 7, 0): 1, (9, "", 6, 6): 1, (9, "x\ny\nz\nu\nv\nw", 6, 0): 1,
    }


def luhn(value):
    total = 0
    for k, d in enumerate(int(c) for c in reversed(value) if c.isdigit()):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
}


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_patterns_on_random_strings(spark):
    rng = random.Random(9)
    cases = ["".join(rng.choice(["1", "0", "23", "555", ".", "-", " ", "+", "@", "a", "_", "(", ")", "é", "b.c", "4111111111111111", "\n"]) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in privacy.base_matches(df).collect():
        got[r.doc_id].append((r.begin, privacy.KINDS.index(r.kind), r.kind, r.end))
    for i, text in enumerate(cases):
        assert [(k, a, b) for a, _, k, b in sorted(got[i])] == base_spans(text), text


def test_disclosing_terms_and_sanitising(spark, empty):
    entity = "write to secret@x.org"
    rows = [(i, f"the whistle agent {entity} near zorbax place number{i}") for i in range(4)] + [(10, "zorbax alone again"), (11, "the place has an agent"), (12, "the agent"), (13, None)]
    rows += [(20 + i, "the agent place near number write whistle whistle") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in privacy.find(df).collect()}
    terms = {(i, s.begin) for i, spans in found.items() for s in spans if s.kind == "term"}
    assert (10, 0) in terms and not any(i >= 11 for i, _ in terms)
    clean = dict(privacy.sanitise(df).collect())
    assert "secret@x.org" not in clean[0] and "<EMAIL>" in clean[0] and "zorbax" not in clean[10] and clean[11] == rows[5][1] and clean[13] == ""
    assert privacy.find(empty).count() == 0


def test_sstable_round_trip(docs, rows, spark, tmp_path, empty):
    from tokenizers import Tokenizer

    path = sstable.default_tokenizer()
    reference = Tokenizer.from_file(path)
    text_key = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_key(r[1] or ""), r[1] or ""))
    got = [tuple(r) for r in sstable.encode_and_read(docs).collect()]
    expected, at = [], 0
    for r in order:
        ids = [*reference.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    manifest = sstable.write_shards(docs, path, partitions=2, folder=f"file://{tmp_path}").collect()
    shards = [sstable.Shard(m.shard) for m in manifest]
    for r in rows[:40]:
        hits = [ids.tolist() for s in shards for ids in s.lookup(r[0])]
        assert [*reference.encode(r[1] or "", add_special_tokens=False).ids, 2] in hits
    assert not any(s.lookup(10**12) for s in shards)
    assert sstable.encode_and_read(empty).count() == 0
    small = sstable.write_shards(docs, partitions=2, shard_tokens=500, shard_docs=5)
    assert small.count() > 10 and max(r.n_docs for r in small.collect()) <= 5
    assert sorted(map(tuple, sstable.read_shards(small).collect()), key=lambda r: r[1]) == expected


def test_sstable_hot_and_extreme_keys(spark, tmp_path):
    """One key with a third of the rows fills many ranges; the lowest number is not the absent one."""
    rows = [(7, f"copy {k}") for k in range(300)] + [(k, "x") for k in range(100, 400)] + [(-(2**63), "lowest"), (2**63 - 1, "highest"), (None, "none"), (None, None)]
    manifest = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), partitions=6, folder=f"file://{tmp_path}")
    held = manifest.collect()
    assert len(held) == 6 and max(r.n_docs for r in held) < 250
    got = sstable.read_shards(manifest).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and collections.Counter(ids) == collections.Counter(r[0] for r in rows)
    shards = [sstable.Shard(r.shard) for r in held]
    assert sum(len(s.lookup(7)) for s in shards) == 300 and sum(len(s.lookup(None)) for s in shards) == 2 and sum(len(s.lookup(-(2**63))) for s in shards) == 1


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = sstable.default_tokenizer()
    reference, encoder, rng = Tokenizer.from_file(path), sstable.Encoder(path), random.Random(1)
    alphabet = [*"aAbBzZ019 \t\n\x0b\x0c\r\x1c\x85\xa0　'’.,!-_<|>éÉßİıΣς日😀́\u0000&", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL", "word"]
    cases = [None, "", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000))]
    for text, ids in zip(cases, encoder.encode(pa.array(cases, pa.string()), 2), strict=True):
        assert ids.tolist() == [*reference.encode(text or "", add_special_tokens=False).ids, 2]


def xx64(*longs, seed=42):
    """The engine's hash of several long numbers."""
    for x in longs:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def xx64_text(*strings):
    seed = 42
    for x in strings:
        seed = xxhash.xxh64_intdigest(x.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def fingerprint(text):
    """Order MinHash by its definition: for each function all numbered k-mers in the order from its start."""
    words = WORD.findall(text)
    if not words:
        return []
    kmers = [words[k : k + 2] for k in range(len(words) - 1)] or [words]
    count, points = collections.Counter(), []
    for place, kmer in enumerate(kmers):
        h = xx64_text(*kmer) << 24 & (2**64 - 1)
        h = (h - (1 << 64) if h >> 63 else h) >> 24
        point = np.int64(xx64_pair(h, count[h])).astype(np.uint64)
        points.append((int(point) >> 24 << 24 | place, place))
        count[h] += 1
    out = []
    for f in range(64):
        start = ((f - 32) << 58) % 2**64
        chosen = sorted(points, key=lambda p: (p[0] - start) % 2**64)[:2]
        ordered = [((p >> 25) & (1 << 39) - 1) for p, _ in sorted(chosen, key=lambda c: (c[1], c[0]))]
        out.append(f << 32 | (xx64(*ordered) & (2**64 - 1)) >> 32)
    return out


def xx64_pair(h, number):
    """Of a long and an int."""
    seed = xxhash.xxh64_intdigest(int(h).to_bytes(8, "little", signed=True), 42)
    seed = xxhash.xxh64_intdigest(int(number).to_bytes(4, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_order_minhash_equals_its_definition(spark, tmp_path):
    """Fingerprints and likeness of the whole query against brute force."""
    rng = random.Random(31)
    texts = [None, "", "one", "one two", "two one two one two one two", *(sentence(rng, n) for n in (3, 9, 30, 130, 700)), *(" ".join(rng.choice("abcde") for _ in range(n)) for n in (12, 90, 400))]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in order_minhash.op4_order_minhash(spark, str(tmp_path)).collect()}
    told = lambda cells: "".join(f"{x:010x}" for x in cells)
    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / 64
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = fingerprint(text), fingerprint(edited), fingerprint(following)
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), told(own), told(other)), text
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(own, other)) and r.near_next == pytest.approx(like(own, after))


def test_order_minhash(docs, rows, spark, empty):
    got = order_minhash.compare_with_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = collections.Counter()
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        text, half = r[1] or "", len(r[1] or "") // 2
        edited = text[: len(text) - half] + (following[1] or "")[:half]
        expected[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    same = collections.defaultdict(set)
    for r in order_minhash.fingerprints(docs).collect():
        same[[x[1] or "" for x in rows if x[0] == r.doc_id][0]].add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values())
    words = sentence(random.Random(2), 400).split()
    shuffled = words[200:] + words[:200]
    blocks = [w for k in reversed(range(0, 400, 2)) for w in words[k : k + 2]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:100], "new", *words[101:]])), (3, " ".join(shuffled)), (4, " ".join(blocks))], "doc_id long, text string")
    cells = {r.doc_id: set(r.cells) for r in order_minhash.with_cells(df, "text", "cells").collect()}
    like = {k: len(cells[1] & cells[k]) / 64 for k in (2, 3, 4)}
    assert like[2] > 0.9 and like[2] > like[3] > 0.2 and like[4] < 0.3  # the same pairs of words, in another order
    assert order_minhash.compare_with_edits(empty).count() == 0


def test_order_minhash_of_short_texts(spark):
    """Halves swapped: about half of all pairs of k-mers change their order, in short texts as in long ones."""
    rng = random.Random(17)
    texts = {(n, k): [f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (20, 40, 77, 130) for k in range(60)}
    rows = [(n, k, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])) for (n, k), w in texts.items()] + [(0, 0, "", "one"), (1, 0, "one", "one"), (2, 0, "one two", "two one"), (3, 0, "a b c", "a b c")]
    df = spark.createDataFrame(rows, "n int, k int, text string, other string")
    both = order_minhash.with_cells(order_minhash.with_cells(df, "text", "a"), "other", "b")
    like = collections.defaultdict(list)
    for r in both.select("n", "a", "b", order_minhash.likeness("a", "b").alias("like")).collect():
        like[r.n].append(r.like)
        assert [x >> 32 for x in r.a] == (list(range(64)) if r.n else [])
    assert (like[0], like[1], like[2], like[3]) == ([0], [1], [0], [1])
    for n in (20, 40, 77, 130):
        kept, swapped = (n - 2) / n, (n // 2 - 1) / (n - 2)  # of each text's pairs of words one differs
        assert abs(np.mean(like[n]) - kept**2 * swapped) < 0.08, (n, np.mean(like[n]))


def test_spaced_seeds(spark, empty):
    rng = random.Random(6)
    items = [(k, sentence(rng, n)) for k, n in enumerate((12, 30, 50, 3))] + [(9, None), (10, "")]
    item = items[2][1].split()
    swapped = [("other" if k % 7 == 3 else w) for k, w in enumerate(item)]
    rows = [
        (1, "lead in " + items[1][1].upper() + ", and out", "c"), (2, " ".join(swapped), "c"), (3, sentence(rng, 200), "c"), (4, None, "c"), (5, "", "c"),
        (6, " ".join(item[:8]) + " " + sentence(rng, 80), "c"), (7, "see " + items[3][1], "c"), (8, sentence(rng, 5000) + " " + items[0][1], "c"), (8, sentence(rng, 5), "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {(1, 1), (2, 2), (7, 3), (8, 0)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == expected
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, broadcast_items=2).collect()} == expected
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {3, 4, 5, 6, 8}  # of the rows of 8 the clean one
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id > 99")).count() == 0


def test_spaced_seeds_in_long_items(spark):
    """Parts of an item under half of it, and a seed that fails close to one that verifies."""
    rng = random.Random(8)
    long, middle, short = (sentence(rng, n).split() for n in (400, 59, 20))
    gap = [*middle[:5], *("gap" for _ in range(9)), *middle[14:44]]
    rows = [(1, [*sentence(rng, 90).split(), *middle[20:48]]), (2, [*long[100:299], *sentence(rng, 300).split()]), (3, gap), (4, [*long[7:19], *sentence(rng, 50).split()]), (5, [*sentence(rng, 30).split(), *long[50:63]])]
    rows += [(6, ["x" if k % 5 == 2 else w for k, w in enumerate(long[200:260])]), (7, short[:9])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((long, middle, short))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.length, r.n_equal) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 0), (3, 1), (5, 0), (6, 0)}
    assert found[1, 1] == (90, 20, 28, 28) and found[2, 0] == (0, 100, 199, 199) and found[3, 1] == (0, 0, 44, 35) and found[5, 0] == (30, 50, 13, 13)
    assert found[6, 0][3] >= 46


def test_quality_held_out(spark, data, docs, rows, empty):
    tables = [spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "labels")]
    model = quality.fit(*tables)
    scored = quality.score(tables[0], model).join(tables[1], "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95
    for r in quality.score(docs, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert quality.score(docs, model).count() == len(rows) and quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty, model).count() == 0
    assert quality.train([], []).score(pa.array(["a"])).tolist() == [0.5]
    odd = spark.createDataFrame([(0, 5), (2, -1), (3, None), (None, 1)], "doc_id long, quality int")
    assert quality.fit(docs, odd).score(pa.array(["a"])).tolist() == [0.5]
    assert quality.fit(empty, tables[1]).score(pa.array([None], pa.string())).tolist() == [0.5]


def test_character_ngrams_are_of_code_points():
    """Slots of a word: one for each different place and length of n-gram of <word>, and one for the word."""
    words = ["a", "né", "日本語", "😀x", "abc", "é", "ab"]
    starts, hashed = quality.slots(pa.array(words))
    of = {w: hashed[a:b] for w, a, b in zip(words, starts[:-1], starts[1:], strict=True)}
    for w in words:
        n = len(w) + 2
        assert len(of[w]) == 1 + sum(max(0, n - k + 1) for k in quality.NGRAMS)
    first = lambda w: list(quality.slots(pa.array([w]))[1])
    shared = lambda a, b: len(set(first(a)) & set(first(b)))
    assert first("né") == list(of["né"]) and shared("日本語", "日本人") > shared("日本語", "abc") and shared("é", "è") <= 2  # "<" and ">" only
    bounds, points = quality.code_points(pa.array(["", "é", "ab", ""]))
    assert bounds.tolist() == [0, 0, 1, 3, 3] and points.tolist() == [0xC3A9, 97, 98]


def test_mixing(docs, rows, spark, empty):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    assert sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.plan(empty).count() == 0 and mixing.mix(docs).columns == docs.columns
    rng = random.Random(3)
    many = [(i, " ".join(["w"] * rng.randrange(1, 300)), "abcde"[min(4, i % 9)]) for i in range(3000)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    sums = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.plan(df).join(df.select("doc_id", "source"), "doc_id").collect():
        sums[r.source][0] += r.taken
        sums[r.source][1], sums[r.source][2] = r.target, r.source_size
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(sorted(sums))}, {}, set(sums)
    left = sum(v[2] for v in sums.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sums[s][2]}
        target |= {s: 3 * sums[s][2] for s in over} if over else share
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    for s, (taken, t, _) in sums.items():
        assert np.isclose(t, target[s]) and abs(taken - t) <= 0.02 * t


def test_mix_emits_what_the_plan_takes(spark):
    """Rows without a doc_id, rows that share one, and rows equal in every column."""
    rng = random.Random(30)
    rows = [(None if k % 3 == 0 else k // 4 if k % 3 == 1 else k, " ".join(["w"] * rng.randrange(1, 60)) + f" {k}", "abcd"[min(3, k % 7)], None if k % 2 else "en", "en" if k % 2 else None) for k in range(900)]
    rows += [(5000, "the same row", "a", None, None)] * 50 + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, other string")
    planned = collections.Counter()
    for r in mixing.plan(df).collect():
        planned[r.doc_id, r.size] += r.copies
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    emitted, given = collections.Counter(map(tuple, mixed.collect())), collections.Counter(rows)
    got = collections.Counter()
    for r, n in emitted.items():
        got[r[0], len(WORD.findall(r[1] or ""))] += n
        assert r in given and n <= 3 * given[r]
    assert got == +planned


def test_chat_round_trip(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "\\(\\\\[x<y", "<s>[INST]a[/INST]b</s>", "é😀\\"]
    rows = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(odd)] + [(2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "assistant", "[")]
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.tree: r for r in chat.read_back(chat.format_paths(nodes, chat.best_paths(nodes))).collect()}
    for c in (1, 2, 3):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in back[c].turns] == turns and back[c].learned == "".join(t for r, t in turns if r == "assistant")
        inner = re.sub(r"<s>\[INST\]|\[/INST\]|</s>", "", back[c].formatted)
        assert "<" not in inner and "[" not in inner


def test_chat_without_conv_id(spark):
    rows = [(None, 0, "user", "one"), (None, 1, "assistant", "two"), (4, 0, "user", "three")]
    nodes = chat.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for threshold in ("10485760", "-1"):  # joined by broadcast, and by sorting
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            back = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_paths(nodes, chat.best_paths(nodes))).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert back == {None: [("user", "one"), ("assistant", "two")], 4: [("user", "three")]}


def test_reply_tree_paths(spark):
    #      1
    #    2   3
    #   4 5   6 - 7;  8 answers a missing message, 9 and 10 answer each other
    edges = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 1.0), (4, 2, 0.0), (5, 2, 3.0), (6, 3, 9.0), (7, 6, 1.0), (8, 99, 2.5), (9, 10, 50.0), (10, 9, 50.0)]
    nodes = spark.createDataFrame([("t", *e) for e in edges], "tree string, node long, parent long, score double")
    paths = collections.defaultdict(list)
    for r in chat.best_paths(nodes, branches=9).orderBy("branch", "place").collect():
        paths[r.branch].append(r.node)
    assert dict(paths) == {1: [1, 2, 5], 2: [1, 3, 6, 7], 3: [8], 4: [1, 2, 4]}
    assert chat.best_paths(nodes.limit(0)).count() == 0


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_components(rows):
    sets, parent = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, unique, docs, rows, empty):
    rng = random.Random(12)
    passage = sentence(rng, 60)
    more = [(1000 + k, passage + " " + sentence(rng, rng.randrange(0, 40))) for k in range(60)]
    base = sentence(rng, 80).split()
    for k in range(60):  # a chain of near copies
        base[rng.randrange(80)] = f"edit{k}"
        more.append((2000 + k, " ".join(base)))
    every = [(r[0], r[1]) for r in unique] + more
    df = spark.createDataFrame(every, "doc_id long, text string")
    expected = brute_components(every)
    for options in ({"long_list": 5, "block_size": 8}, {"broadcast_nodes": 0, "long_list": 3, "broadcast_lists": 10}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, **options).collect()}
        assert got == expected
    assert ngram_join.components(docs).count() == len(rows)
    assert ngram_join.components(empty).count() == 0
    kept = sorted(r.doc_id for r in ngram_join.keep_one(df).collect())
    assert kept == sorted({c for _, c in expected.values()})


def test_ngram_join_parted_lists(spark):
    """Lists dealt in blocks of one entry: the nodes of a link lie in different blocks of every list they share."""
    rng = random.Random(21)
    rows = []
    for k in range(40):
        words = sentence(rng, 60).split()
        rows += [(10 * k + j, " ".join([*words[:59], f"end{j}"])) for j in range(2 + k % 2)]
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), long_list=1, block_size=1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_divide_skip_equals_counting():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 50))) for _ in range(rng.randrange(1, 25))]
        count = collections.Counter(x for v in lists for x in v)
        need = [rng.randrange(1, 27) for _ in range(60)]
        assert sorted(ngram_join.divide_skip(lists, need)) == sorted(x for x, n in count.items() if n >= need[x])
    for _ in range(200):
        pool = np.sort(np.array(rng.sample(range(10**6), 60), np.uint64))
        query, sets = pool[:40], [np.sort(np.array(rng.sample(pool.tolist(), rng.randrange(1, 60)), np.uint64)) for _ in range(9)]
        sets.append(np.delete(query, rng.randrange(40)))
        expected = [k for k, x in enumerate(sets) if 100 * len(np.intersect1d(query, x)) >= 80 * len(np.union1d(query, x))]
        assert sorted(ngram_join.linked(query, sets)) == expected


def test_ngram_join_on_repeated_and_absent_ids(spark, empty):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black grey pink")
    rows = [(5, a, 1), (3, a, 2), (5, b, 3), (None, c, 4), (None, c, 5), (None, a, 6), (9, None, 7), (9, "", 8), (9, None, 9), (7, b, 10), (7, b, 11), (None, " ", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = collections.Counter(tuple(r) for r in ngram_join.components(df, broadcast_nodes=0).collect())
    assert got == {(5, 3, 3): 1, (3, 3, 3): 1, (None, 3, 3): 1, (5, 2, 5): 1, (7, 2, 5): 2, (None, 3, None): 2, (9, 0, 9): 3, (None, 0, None): 1}
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert texts == sorted([(3, a), (5, b), (None, c), (9, None), (9, ""), (9, None), (None, " ")], key=repr)
    assert ngram_join.keep_one(empty).count() == 0


def test_ngram_join_of_a_crowd(spark):
    """Near copies of one text in more parts than a search takes at once, exact copies spread over many partitions, and a
    passage that documents of all sizes share without being alike."""
    rng = random.Random(41)
    base, passage = sentence(rng, 80).split(), sentence(rng, 60)
    rows = [(k, " ".join(base)) for k in range(40)]
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(80), rng.randrange(1, 3)):
            words[at] = f"edit{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, " ".join([sentence(rng, rng.randrange(0, 30)), passage, sentence(rng, rng.randrange(0, 30))])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    expected = brute_components(rows)
    for options in ({"long_list": 8, "block_size": 10, "group": 7}, {"long_list": 2, "group": 1000, "star_rounds": 1}):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, **options).collect()} == expected


def test_license_scan(docs, rows, empty):
    model = licenses.train()
    got = {(r.doc_id, r.paragraph): (r.family, round(r.probability, 6), round(r.coverage, 6)) for r in licenses.scan(docs, model).collect()}
    expected = {}
    for r in rows:
        for k, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            if hit := model.classify(line):
                expected[r[0], k] = (hit[0], round(hit[1], 6), round(hit[2], 6))
    assert got == expected and any(v[0] == "MIT" for v in got.values())
    for family, given in licenses.FAMILIES.items():
        for text in given:
            assert model.classify(text)[0] == family
    assert not any(model.classify(t) for t in licenses.UNKNOWN)
    assert licenses.scan(empty).count() == 0


def test_license_scan_wrapped_and_dual(spark):
    """Notices wrapped over lines, also behind comment signs and in a long block, and two families in one text."""
    mit = licenses.FAMILIES["MIT"][3]
    bsd, lgpl = licenses.FAMILIES["BSD"][0], licenses.FAMILIES["LGPL"][0]
    wrap = lambda t, n, lead="": "\n".join(lead + x for x in textwrap.wrap(t, n))
    rng = random.Random(2)
    rows = [
        (1, "head\n\n" + wrap(mit, 72) + "\n\nfoot"), (2, wrap(bsd, 40, " * ")), (3, wrap(mit, 50) + "\n" + wrap(bsd, 50)), (4, "Licensed under the MIT License or the Apache License, Version 2.0."),
        (5, wrap(lgpl, 60)), (6, "\n".join(sentence(rng, 8) for _ in range(40)) + "\n" + wrap(mit, 30) + "\n" + sentence(rng, 9)), (7, "\n\n".join(wrap(mit, 30).split("\n"))), (None, wrap(mit, 72)), (8, None),
        (9, "\n".join(wrap(t, 30) for t in licenses.UNKNOWN)),
    ]
    got = collections.Counter((r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 2, "MIT"), (2, 0, "BSD"), (3, 0, "MIT"), (3, 0, "BSD"), (4, 0, "MIT"), (4, 0, "Apache-2.0"), (5, 0, "LGPL"), (6, 0, "MIT"), (None, 0, "MIT")])


def test_split_words():
    offsets, codes, words = split_words(pa.array([" a  b\n", None, "", "b", "\t"]))
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [["a", "b"], [], [], ["b"], []]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, duck, data):
    got, expected = catalog.queries()[name](spark, data).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    names = sorted(expected.columns)
    assert sorted(got.columns) == names and sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, expected[names].values.tolist()))


def test_pipeline(spark, data):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    good = {r.doc_id for r in quality.score(tables["documents"], quality.fit(tables["documents"], tables["labels"])).where("predicted = 1").collect()}
    kept = [r for r in docs if r[0] in good]
    groups = brute_components(kept)
    kept = [r for r in kept if groups[r[0]][1] == r[0]]
    passages = [r.text for r in tables["benchmark"].collect()]
    kept = [r for r in kept if not any(p in r[1] for p in passages)]
    copies = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    reference, at, expected = Tokenizer.from_file(sstable.default_tokenizer()), 0, []
    for r in sorted(kept):
        for _ in range(copies[r[0]]):
            ids = [*reference.encode(r[1], add_special_tokens=False).ids, 2]
            expected.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect()), key=lambda r: r[1]) == expected
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None
