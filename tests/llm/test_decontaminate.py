"""Spaced seeds against a brute-force search of all alignments and stretches."""

import collections
import random

import numpy as np
import pytest

from tissuemill.llm import decontaminate as D


def stretches(doc, item, shift, masks, limits):
    """(n_equal, doc_start, item_start, length) of every admissible stretch of one alignment."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = [item[k] == doc[k + shift] for k in range(low, high)]
    hits = []
    for mask in masks:
        for k in range(len(same) - len(mask) + 1):
            if all(same[k + j] for j, c in enumerate(mask) if c == "1"):
                hits.append((k, k + len(mask)))
    for b in range(len(same)):
        for e in range(len(same), b, -1):
            equal = sum(same[b:e])
            if not (same[b] and same[e - 1]) or equal < limits.min_match * (e - b) or not any(b <= x and y <= e for x, y in hits):
                continue
            if e - b >= limits.min_share * len(item) or equal >= limits.least_equal:
                yield -equal, b + low + shift, b + low, e - b
            break  # the longest from here holds as many equal tokens as any


def brute(docs, items, masks=D.MASKS, limits=D.Limits()):
    found = {}
    for doc_id, doc in docs:
        for item_id, item in items:
            mine = [m for m in masks if len(m) <= len(item)] or ["1" * len(item)]
            every = [s for shift in range(-len(item) + 1, len(doc)) for s in stretches(doc, item, shift, mine, limits)] if item else []
            if every:
                best = min(every)
                found[doc_id, item_id] = (best[1], best[2], best[3], -best[0], len(item))
    return found


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    word = lambda: rng.choice(["ka", "lo", "mi", "nu", "pe", "ra", "so", "ti"])
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate((3, 12, 20, 34, 60, 26))]
    docs = []
    for k in range(160):
        words = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            _, item = rng.choice(items)
            a = rng.randrange(1 + len(item) // 2)
            b = rng.randrange((a + len(item)) // 2, len(item)) + 1
            rate = rng.choice([0, 0.1, 0.25, 0.4])
            words += [f"x{rng.randrange(99)}" if rng.random() < rate else w for w in item[a:b]] + [word() for _ in range(rng.randrange(0, 8))]
        docs.append((k, words))
    return docs, items


def test_all_stretches(spark, case, monkeypatch):
    docs, items = case
    expected = brute(docs, items)
    assert len(expected) > 40 and len({i for _, i in expected}) == len(items)
    df = spark.createDataFrame([(k, " ".join(w), None) for k, w in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    bad = {d for d, _ in expected}
    for options in ({}, {"broadcast_items": 2}, {"broadcast_bytes": 150}):
        assert {(r.doc_id, r.item_id): tuple(r)[2:] for r in D.contaminated(df, bench, **options).collect()} == expected
        kept = D.drop_contaminated(df, bench, **options)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - bad


def test_hits_in_pieces(case, monkeypatch):
    import pyarrow as pa

    docs, items = case
    texts = pa.array([" ".join(w) for _, w in docs])
    held = D.Items([k for k, _ in items], [" ".join(w) for _, w in items], D.MASKS)
    whole = sorted(held.overlaps(texts, D.Limits()))
    monkeypatch.setattr(D, "HITS_AT_ONCE", 3)
    assert sorted(held.overlaps(texts, D.Limits())) == whole


def test_rows_that_share_or_lack_an_identifier(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "clean text of its own", 1), (None, f"see {item} there", 2), (4, item, 3), (4, f"{item} once more", 4), (4, "another clean text", 5), (5, None, 6), (6, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string")
    for options in ({}, {"broadcast_items": 1}):
        found = collections.Counter((r.doc_id, r.item_id) for r in D.contaminated(df, bench, **options).collect())
        assert found == {(None, 1): 1, (None, None): 1, (4, 1): 1, (4, None): 1}
        assert sorted(r.item_id for r in D.drop_contaminated(df, bench, **options).collect()) == [1, 5, 6, 7]


def test_recall_under_substitutions():
    """Items of 40 tokens of which each is replaced with a probability: found at least as often as stated."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for rate, least in ((0.1, 0.99), (0.15, 0.99), (0.2, 0.97), (0.25, 0.9)):
        items = [[f"w{x}" for x in rng.integers(0, 10**6, 40)] for _ in range(200)]
        changed = [[f"z{rng.integers(10**6)}" if rng.random() < rate else w for w in item] for item in items]
        held = D.Items(list(range(200)), [" ".join(w) for w in items], D.MASKS)
        texts = pa.array([" ".join([*(f"a{x}" for x in range(20)), *w, "tail"]) for w in changed])
        hit = {(d, i) for d, i, _ in held.overlaps(texts, D.Limits())}
        share = len({d for d, i in hit if d == i}) / 200
        assert share >= least, (rate, share)
        assert not any(d != i for d, i in hit)
