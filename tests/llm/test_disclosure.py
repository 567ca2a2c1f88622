"""Disclosure sanitisation against brute force over whole texts."""

import collections
import hashlib
import math
import random
import re

import regex

from tissuemill.llm import privacy as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(value):
    return [int(c) for c in value if c.isdigit()]


def valid(kind, value):
    d = digits(value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        back = d[::-1]
        return 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(back)) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def words_near(text, at, end, before, after):
    """Terms among the words between the neighbouring matches of the kind, NEAR to each side."""
    split = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    near = [" ".join(split(text[before:at])[-P.NEAR :]), " ".join(split(text[end:after])[: P.NEAR])]
    return {t.lower() for n in near for t in regex.findall(r"\p{L}{3,}", n)}


def brute(rows):
    """doc_id -> (counts, base digest, spans) of texts with identifiers of their own."""
    texts = {i: t or "" for i, t in rows}
    base, pairs, documents, occurrences = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for i, text in texts.items():
        for rank, (kind, pattern) in enumerate(BASE.items(), 1):
            floor = r"[0-9]([\x20-]?[0-9]){11,}" if kind == "card" else pattern  # shorter runs of digits are no match of the operator
            found = list(re.finditer(floor, text))
            for k, m in enumerate(found):
                if not valid(kind, m.group()):
                    continue
                base[i].append((m.start(), rank, m.end(), kind))
                entity = f"{kind}:{m.group().lower()}"
                occurrences[entity] += 1
                near = words_near(text, m.start(), m.end(), found[k - 1].end() if k else 0, found[k + 1].start() if k + 1 < len(found) else len(text))
                for t in near:
                    pairs[entity, t] += 1
                    documents[entity, t].add(i)
    every = collections.Counter(t.lower() for text in texts.values() for t in regex.findall(r"\p{L}{3,}", text))
    size, terms = sum(every.values()), set()
    for (entity, t), together in pairs.items():
        given = min(1.0, together / every[t])
        own = -math.log(occurrences[entity] / max(2, size))
        if len(documents[entity, t]) >= P.LEAST_DOCUMENTS and given >= P.LEAST_GIVEN and 1 + math.log(given) / own >= P.LEAST_DISCLOSED:
            terms.add(t)
    out = {}
    for i, text in texts.items():
        mine = sorted(base[i])
        spans = sorted(mine + [(m.start(), 5, m.end(), "term") for m in regex.finditer(r"\p{L}{3,}", text) if m.group().lower() in terms])
        told = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in xs)
        counts = [sum(x[3] == k for x in mine) for k in BASE]
        out[i] = (*counts, hashlib.sha256(told(mine).encode()).hexdigest(), told(spans))
    return out, terms


def corpus():
    rng = random.Random(23)
    plain = ["the", "place", "near", "agent", "Write", "number", "über", "no", "日本語", "x1", "and", "meets"]
    secret = ["Zorbax", "quill", "Österling", "vantor"]
    entities = ["a.b@c-d.org", "+1 (743) 555-3824", "4111 1111 1111 1111", "10.20.30.40", "999.1.1.1", "x@y.z", "4111 1111 1111 1112"]
    rows = []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(entities))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [*rng.choices(secret[k % 4 :][: k < 4] + plain, k=rng.randrange(2)), *secret[k % 4 :][: k < 4], entities[k], *rng.choices(plain, k=2)]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    return [*rows, (900, None), (901, ""), (902, "Zorbax alone"), (903, "a" * 30 + "@b" + ".c" * 40_000 + " quill"), (904, "7" * 60_000 + " " + "1." * 30_000), (905, "+1" + "-" * 50_000)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus()
    expected, terms = brute(rows)
    assert terms and sum("term" in v[5] for v in expected.values()) > 20 and expected[902][5] == "term:0:6"
    spark.createDataFrame([(i, t, "doc", 1) for i, t in rows], "doc_id long, text string, spans string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in P.op2_disclosure(spark, str(tmp_path)).collect()}
    assert got == expected
    few = {r.term for r in P.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), P.base_matches(spark.createDataFrame(rows, "doc_id long, text string")), broadcast_terms=0).collect()}
    assert few == terms


def test_a_domain_of_many_labels(spark):
    text = "a@b" + ".c" * 1_000_000
    found = [(r.kind, r.begin, r.end) for r in P.base_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert found == [("email", 0, len(text))]
