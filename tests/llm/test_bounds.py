"""Bounded work on repetitive texts, shared identifiers and long runs of lines."""

import random
import time

import numpy as np
import pyarrow as pa

from tissuemill.llm import decontaminate as D
from tissuemill.llm import licenses, mixing, quality


def test_repeated_words_try_few_alignments(monkeypatch):
    items = D.Items([0, 1], ["ha " * 60, "ha " * 30 + "ho " * 30], D.MASKS)
    texts = pa.array(["ha " * 3000, "ha " * 500 + "ho " * 500, "ho " * 40])
    tried = []
    verify = D.Items.verify
    monkeypatch.setattr(D.Items, "verify", lambda self, *a: tried.append(1) or verify(self, *a))
    got = {(d, i): s for d, i, s in items.overlaps(texts, D.Limits())}
    assert got[0, 0] == (0, 0, 60, 60, 60) and got[1, 1] == (470, 0, 60, 60, 60) and got[1, 0][:4] == (0, 0, 60, 60)
    assert len(tried) < 3000  # some 30,000 alignments have hits


def test_skipped_alignments_cannot_win():
    """Every alignment verified, none skipped: the same best stretches."""
    rng = random.Random(2)
    for _ in range(30):
        item = [rng.choice("ab") for _ in range(rng.randint(12, 30))]
        doc = [rng.choice("aab") for _ in range(rng.randint(12, 80))]
        items = D.Items([0], [" ".join(item)], D.MASKS)
        _, hashed = D.tokens(pa.array([" ".join(doc)]))
        best = None
        for at, _, place, span in items.hits(hashed):
            shift = at - place
            for s in np.unique(shift):
                got = items.verify(hashed, 0, int(s), np.sort(place[shift == s]), span, D.Limits())
                if got is not None and (best is None or (-got[3], *got) < (-best[3], *best)):
                    best = got
        assert [s for _, _, s in items.overlaps(pa.array([" ".join(doc)]), D.Limits())] == ([] if best is None else [best])


def test_training_rows_and_bytes_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    ids = [i for i in range(40) if quality.zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(ids[0], f"copy {k}") for k in range(50)] + [(ids[1], "x" * 200), (ids[2], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs.repartition(5), labels)
    assert seen[0] == seen[1] and len(seen[0][0]) == 3 and sorted(seen[0][1]) == [0, 0, 1]
    quality.fit(docs, labels, train_bytes=1600)  # the long text is over a sixteenth
    assert sorted(seen[2][0], key=str) == sorted((t for t in seen[0][0] if t is None or len(t) < 100), key=str)


def test_rows_without_identifier_spread_over_slices(spark):
    docs = spark.createDataFrame([(None, f"word{i} of text", "s") for i in range(600)], "doc_id long, text string, source string")
    plan = mixing.plan(docs)
    assert plan.count() == 600 and plan.agg({"taken": "sum"}).first()[0] == 1800
    digests = docs.select(mixing.F.md5(mixing.F.concat_ws("|", mixing.F.lit(""), mixing.F.md5("text"))).substr(1, 2).alias("part"))
    assert digests.distinct().count() > 200


def test_long_runs_of_lines_cost_their_length(spark):
    filler = "\n".join(f"entry {i} of the log" for i in range(40_000))
    notice = "Licensed under the Apache License, Version 2.0"
    docs = spark.createDataFrame([(1, f"{notice}\n{filler}"), (2, notice)], "doc_id long, text string")
    began = time.perf_counter()
    got = {(r.doc_id, r.family) for r in licenses.scan(docs).collect()}
    assert {d for d, _ in got} == {1, 2} and len({f for _, f in got}) == 1
    assert time.perf_counter() - began < 150  # guards against a hang only
