"""Links of short texts over shared heads: every shingle that they share is a long list, and no star round helps."""

import collections
import random

import numpy as np
from test_ops import brute_components

from tissuemill.llm import ngram_join
from tissuemill.llm.common import stage


def family(name, n, decoys):
    """Two texts of n shingles that share n - 1, and decoys that make the lists of all those long without being alike."""
    head, common = [f"{name}w{j}" for j in range(n + 3)], [f"{name}c{j}" for j in range(n - 2)]
    out = [[*head, f"{name}x"], [*head, f"{name}y"]]
    out += [[*common, f"{name}own{j}z{d}", *head[j : j + 5]] for j in range(n - 1) for d in range(decoys)]
    return [" ".join(words) for words in out]


def test_pairs_that_meet_in_long_lists_only(spark, monkeypatch):
    """All lists of more than four entries count as long, whatever their place in the hash order; sizes cover all n mod 5."""
    texts = [t for n in range(9, 20) for t in family(f"f{n}", n, 3)]
    rows = list(enumerate(random.Random(7).sample(texts, len(texts))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lengths = collections.Counter(h for found in ngram_join.shingle_sets(df.select("text").toArrow().column("text").combine_chunks()) for h in found.tolist())
    long = {h: n for h, n in lengths.items() if n > 4}
    order = ngram_join.Order(np.array(list(long), np.uint64), np.array(list(long.values()), np.int64))
    found = ngram_join.Join._stars
    monkeypatch.setattr(ngram_join, "long_lists", lambda *_: order)
    monkeypatch.setattr(ngram_join.Join, "_stars", lambda self, placed, seed: stage(found(self, placed, seed).limit(0)))
    expected = brute_components(rows)
    assert len({c for _, c in expected.values()}) == len(rows) - 11
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, long_list=4, star_rounds=0).collect()} == expected
