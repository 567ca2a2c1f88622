"""License scan: a trained paragraph classifier, its unknown class calibrated, its findings confirmed.

Paragraphs (lines, and runs of lines that hold words, as notices are often wrapped) are lower-cased, parted into words at everything but a-z, 0-9, "+", "-" and inner dots, and seen as
sets of single words, word bigrams and trigrams, n-grams of nothing but stop words left out. A softmax over the license
families and one unknown class is trained in numpy, on the driver, from the notices in license_texts: whole, cut
into stretches, and set among foreign words; the unknown class learns from paragraphs about licenses that grant
none and from shuffled words. A temperature calibrates the probabilities: it is chosen on whole notices and paragraphs
that a first model has never seen, and `evaluate` reports recall and calibration error by folds of such. A
prediction counts only if it is not the unknown class, reaches `least_probability`, and the paragraph holds at
least `least_coverage` of the n-grams of one of the family's templates.

A paragraph may hold notices of several families. After the likeliest one every other family is reported of which a
template is covered, by that template's n-grams alone, as far as the families reported before do not explain them.
A run of lines (up to a line without words) is reported under its first line, for families that none of its lines tells
by itself.

The scan is DataFrame functions only. Texts without any anchor word are turned away first: the anchors are chosen so
that `least_coverage` of no template can be reached without one, so this loses nothing. Then n-grams are exploded, joined
with the weights (a broadcast as large as the model, some thousand rows), and only the n-grams found travel to the sums.

Defined edge cases: null and empty texts have no findings; a paragraph without known n-grams is unknown and not
reported; of equally likely families the first in the order of the training texts wins; rows that repeat both doc_id and
text are one document, rows that share a doc_id (or have none) with other texts are documents of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .license_texts import EVERYDAY, FAMILIES, UNKNOWN

ORDERS = (1, 2, 3)
SEPARATOR = r"[^a-z0-9.+\-]+|\.(?![0-9])"
BREAK = "\n"
STOP = frozenset("a an and any are as at be by for from in is it its no not of on or that the this to was were will with you your".split())
LEAST_PROBABILITY = 0.6
LEAST_COVERAGE = 0.6


def words_of(paragraph: str) -> list[str]:
    return re.sub(SEPARATOR, " ", paragraph.lower()).split()


def grams_of(words: list[str]) -> set[str]:
    found = {tuple(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1)}
    return {" ".join(g) for g in found if not STOP.issuperset(g)}


class Model:
    """vocabulary: n-gram -> row; weights: row x class, the last class unknown; bias; temperature; templates."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, templates: list[tuple[str, set[str]]]):
        self.vocabulary, self.weights, self.bias, self.temperature, self.templates = vocabulary, weights, bias, temperature, templates
        self.families = list(FAMILIES)

    def classify(self, paragraph: str, least_probability: float = LEAST_PROBABILITY, least_coverage: float = LEAST_COVERAGE) -> tuple[str, float, float] | None:
        """(family, probability, coverage) of one paragraph, or None: what the scan computes, without Spark."""
        found = grams_of(words_of(paragraph)) & self.vocabulary.keys()
        if not found:
            return None
        logits = (self.weights[[self.vocabulary[g] for g in found]].sum(0) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        if best == len(self.families) or p[best] < least_probability:
            return None
        coverage = max(len(found & t) / len(t) for family, t in self.templates if family == self.families[best])
        return (self.families[best], float(p[best]), coverage) if coverage >= least_coverage else None


def anchors(templates: list[tuple[str, set[str]]], least_coverage: float) -> list[str]:
    """Words of which each paragraph that covers a template holds one: their n-grams are more than may be missing.

    Greedy; words of everyday prose count for less, since they turn fewer texts away.
    """
    missing = [len(t) - int(np.ceil(least_coverage * len(t))) + 1 for _, t in templates]
    left, chosen = [{g: frozenset(g.split()) for g in t} for _, t in templates], []
    while any(m > 0 for m in missing):
        gain: Counter[str] = Counter()
        for m, grams in zip(missing, left, strict=True):
            if m > 0:
                held = Counter(w for words in grams.values() for w in words)
                for w, n in held.items():
                    gain[w] += min(n, m)
        best = min(gain, key=lambda w: (-gain[w] / (1 + (30 if len(w) > 3 else 300) * (w in EVERYDAY) + 1000 * (w in STOP)), w))
        chosen.append(best)
        for k, grams in enumerate(left):
            missing[k] -= sum(best in words for words in grams.values())
            left[k] = {g: words for g, words in grams.items() if best not in words}
    return sorted(chosen)


def pattern(words: list[str]) -> str:
    """A regular expression for any of the words, standing by itself; words are parted letter by letter, so few are tried at a place."""

    def of(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest if w})
        parts = [re.escape(h) + of([w[1:] for w in rest if w and w[0] == h]) for h in heads]
        ends = ["(?![a-z0-9])"] if "" in rest else []
        return "(?:" + "|".join(ends + parts) + ")" if len(ends) + len(parts) > 1 else (ends + parts)[0]

    return "(?:^|[^a-z0-9])" + of(words)


Notice = tuple[list[str], int]


def _notices() -> list[Notice]:
    """Words and class of every training paragraph; the last class is unknown."""
    labelled = [(words_of(t), k) for k, texts in enumerate(FAMILIES.values()) for t in texts]
    return labelled + [(words_of(t), len(FAMILIES)) for t in UNKNOWN]


def _examples(rng: np.random.Generator, notices: list[Notice]) -> list[tuple[set[str], int, float]]:
    """(n-grams, class, weight) of the notices: whole, in stretches, among foreign words."""
    unknown = len(FAMILIES)
    every = sorted({w for words, _ in notices for w in words})
    out = []
    for words, k in notices:
        out.append((grams_of(words), k, 6.0))
        if k == unknown:
            continue
        for _ in range(2):  # stretches of at least two thirds
            n = max(2, int(np.ceil(len(words) * rng.uniform(0.67, 1))))
            at = rng.integers(0, len(words) - n + 1)
            out.append((grams_of(words[at : at + n]), k, 2.0))
        for _ in range(2):  # among foreign words
            around = [list(rng.choice(every, rng.integers(1, 12))) for _ in range(2)]
            out.append((grams_of(around[0] + words + around[1]), k, 2.0))
        n = min(len(words), int(rng.integers(2, 4)))  # a few words of a notice are not a notice
        if len(words) >= 3 * n:
            at = rng.integers(0, len(words) - n + 1)
            out.append((grams_of(words[at : at + n]), unknown, 1.0))
    out += [(grams_of(list(rng.choice(every, rng.integers(4, 30)))), unknown, 1.0) for _ in range(300)]
    return out


def _matrix(examples: list[tuple[set[str], int, float]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, (grams, _, _) in enumerate(examples):
        x[i, [vocabulary[g] for g in grams if g in vocabulary]] = 1
    return x, np.array([k for _, k, _ in examples]), np.array([w for _, _, w in examples], np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted multinomial logistic regression by full gradient steps, each weight's step scaled by its gradients (Adam)."""
    classes, w = len(FAMILIES) + 1, (w / w.mean() / len(w))[:, None]
    one = np.eye(classes, dtype=np.float32)[y]
    x = np.column_stack((x, np.ones(len(x), np.float32)))
    weights = np.zeros((x.shape[1], classes), np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = x.T @ ((_softmax(x @ weights) - one) * w) + decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return weights[:-1], weights[-1]


def _vocabulary(notices: list[Notice]) -> dict[str, int]:
    return {g: i for i, g in enumerate(sorted(set().union(*(grams_of(words) for words, _ in notices))))}


def _folds(notices: list[Notice], folds: int, seed: int) -> np.ndarray:
    """A fold for each notice, dealt inside each class."""
    rng, out, dealt = np.random.default_rng(seed), np.zeros(len(notices), int), Counter()
    for i in rng.permutation(len(notices)):
        out[i] = dealt[notices[i][1]] % folds
        dealt[notices[i][1]] += 1
    return out


def _kept_back(seed: int, folds: int, only: int | None, steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(logits, classes) of whole notices by models that never saw them; `only` one fold, or all."""
    notices = _notices()
    fold, logits, classes = _folds(notices, folds, seed), [], []
    for f in range(folds) if only is None else [only]:
        seen = [n for n, k in zip(notices, fold, strict=True) if k != f]
        vocabulary = _vocabulary(seen)
        weights, bias = _fit(*_matrix(_examples(np.random.default_rng(seed + f), seen), vocabulary), steps, rate, decay)
        x, y, _ = _matrix([(grams_of(words), k, 1.0) for (words, k), at in zip(notices, fold, strict=True) if at == f], vocabulary)
        logits.append(x @ weights + bias)
        classes.append(y)
    return np.concatenate(logits), np.concatenate(classes)


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / t)[np.arange(len(classes)), classes] + 1e-12).mean())

    return float(min(np.geomspace(0.2, 20, 47), key=loss))


FIT = {"steps": 150, "rate": 0.1, "decay": 1e-5}


@functools.cache
def train(seed: int = 11, folds: int = 4) -> Model:
    """The classifier of all notices; its temperature comes from one fold of notices kept back whole."""
    notices = _notices()
    temperature = _temperature(*_kept_back(seed, folds, 0, **FIT))
    templates = [(family, grams_of(words_of(t))) for family, texts in FAMILIES.items() for t in texts]
    vocabulary = _vocabulary(notices)
    weights, bias = _fit(*_matrix(_examples(np.random.default_rng(seed), notices), vocabulary), **FIT)
    return Model(vocabulary, np.round(weights.astype(np.float64), 6), np.round(bias.astype(np.float64), 6), temperature, templates)


def evaluate(seed: int = 11, folds: int = 4, bins: int = 10) -> dict[str, float]:
    """On notices kept back whole, fold by fold: recall (family right and probable enough), share of paragraphs that are no
    notices but taken for one, and the expected calibration error of the likeliest class's probability."""
    logits, classes = _kept_back(seed, folds, None, **FIT)
    p = _softmax(logits / _temperature(*_kept_back(seed, folds, 0, **FIT)))
    top, best, unknown = p.max(1), p.argmax(1), len(FAMILIES)
    told = (best != unknown) & (top >= LEAST_PROBABILITY)
    place = np.minimum((top * bins).astype(int), bins - 1)
    error = sum(abs((best == classes)[place == b].mean() - top[place == b].mean()) * (place == b).mean() for b in range(bins) if (place == b).any())
    return {
        "notices": float((classes != unknown).sum()),
        "recall": float((told & (best == classes))[classes != unknown].mean()),
        "wrong_family": float((told & (best != classes))[classes != unknown].mean()),
        "false_alarms": float(told[classes == unknown].mean()),
        "calibration_error": float(error),
    }


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))

    return F.flatten(F.array(*map(of, ORDERS)))


def _crossing(own: Column, following: Column) -> Column:
    """The n-grams that begin in own words and end in following ones."""
    found = []
    for n in ORDERS:
        for k in range(1, n):  # words of own
            words = [F.get(own, F.size(own) - k + i) for i in range(k)] + [F.get(following, F.lit(i)) for i in range(n - k)]
            found.append(F.when((F.size(own) >= k) & (F.size(following) >= n - k), F.concat_ws(" ", *words)))
    return F.array_compact(F.array(*found))


def scan(
    docs: DataFrame, model: Model | None = None, least_probability: float = LEAST_PROBABILITY, least_coverage: float = LEAST_COVERAGE, paragraph_break: str = BREAK
) -> DataFrame:
    """doc_id, paragraph (from 0: its first line), family, probability, coverage: one row for each family found in a line or run of lines."""
    spark = docs.sparkSession
    model = model or train()
    classes = len(model.families) + 1
    weights = F.broadcast(
        spark.createDataFrame([(g, i, *map(float, model.weights[i])) for g, i in model.vocabulary.items()], "gram string, g int, " + ", ".join(f"w{k} double" for k in range(classes)))
    )
    vocabulary, weights = weights.select("gram", "g"), weights.drop("gram")
    vocabulary, weights = F.broadcast(vocabulary), F.broadcast(weights)
    # Rare n-grams of a template first: who holds enough of the template holds one of its first few (a prefix filter).
    of_templates = [sorted(model.vocabulary[g] for g in t) for _, t in model.templates]
    frequency = Counter(g for t in of_templates for g in t)
    of_all = {f: sorted(model.vocabulary[g] for g in set().union(*(t for x, t in model.templates if x == f))) for f in model.families}
    lead = [(g, k) for k, t in enumerate(of_templates) for g in sorted(t, key=lambda g: (frequency[g], g))[: len(t) - int(np.ceil(least_coverage * len(t))) + 1]]
    leads = F.broadcast(spark.createDataFrame(lead, "g int, template int"))
    templates = F.broadcast(
        spark.createDataFrame(
            [(k, model.families.index(f), of_templates[k], of_all[f]) for k, (f, _) in enumerate(model.templates)], "template int, of_family int, of_template array<int>, of_all array<int>"
        )
    )
    told = pattern(anchors(model.templates, least_coverage))
    low = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).alias("doc"), F.lower("text").alias("low"))
    low = low.where(F.col("low").rlike(told))
    clean = F.transform(F.split("low", paragraph_break), lambda x: F.trim(F.regexp_replace(x, SEPARATOR, " ")))
    # Generators keep what they hold from being computed again by each reader.
    cleaned = low.select("doc", F.explode(F.array(clean)).alias("lines"))
    line, at = (lambda i: F.get("lines", i)), F.sequence(F.lit(0), F.size("lines") - 1)
    opens = F.filter(at, lambda i: (line(i) != "") & (F.coalesce(line(i - 1), F.lit("")) == ""))
    shuts = F.filter(at, lambda i: (line(i) != "") & (F.coalesce(line(i + 1), F.lit("")) == ""))
    runs = cleaned.select("doc", F.explode(F.transform(F.arrays_zip(opens.alias("a"), shuts.alias("b")), lambda x: F.struct(x["a"].alias("block"), F.slice("lines", x["a"] + 1, x["b"] - x["a"] + 1).alias("lines")))).alias("run"))
    runs = runs.where(F.array_join("run.lines", " ").rlike(told))
    # Each line goes on with the first words of the two after it, so a line carries no more of its run than these.
    ahead = max(ORDERS) - 1

    def goes_on(line: Column, i: Column) -> Column:
        return F.struct(line.alias("line"), F.concat_ws(" ", *(F.substring_index(F.get("run.lines", i + k), " ", ahead) for k in (1, 2))).alias("next"))

    each = runs.select("doc", "run.block", F.transform("run.lines", goes_on).alias("each"))
    each = each.select("doc", "block", F.posexplode("each").alias("place", "at")).select("doc", "block", "place", "at.line", "at.next")
    following = F.when(F.col("next") != "", F.slice(F.split("next", " +"), 1, ahead)).otherwise(F.array().cast("array<string>"))
    words = each.select("doc", "block", (F.col("block") + F.col("place")).alias("line"), F.split("line", " +").alias("own"), following.alias("following"))
    words = words.select("doc", "block", "line", F.explode(F.array(F.struct("own", "following"))).alias("held"))
    own, n = F.col("held.own"), F.size("held.own")
    n_inside = sum((F.greatest(n - (k - 1), F.lit(0)) for k in ORDERS), F.lit(0))
    grams = words.select("doc", "block", "line", n_inside.alias("n_inside"), F.posexplode(F.concat(_grams(own), _crossing(own, F.col("held.following")))).alias("pos", "gram"))
    grams = grams.select("doc", "block", "line", (F.col("pos") < F.col("n_inside")).alias("inside"), "gram")
    rows = grams.join(vocabulary, "gram")
    # A gram counts for its line, if it lies in one line, and for the run of lines around it.
    place = [F.struct(F.lit(0).alias("kind"), F.col("line").alias("paragraph")), F.struct(F.lit(1).alias("kind"), F.col("block").alias("paragraph"))]
    rows = rows.select("doc", "block", "g", F.explode(F.when(F.col("inside"), F.array(*place)).otherwise(F.array(place[1]))).alias("unit"))
    unit = ["doc", "block", "kind", "paragraph"]
    least = min(int(np.ceil(least_coverage * len(grams))) for _, grams in model.templates)
    held = rows.groupBy("doc", "block", "unit").agg(F.array_sort(F.collect_set("g")).alias("held")).where(F.size("held") >= least)
    held = stage(held.select("doc", "block", "unit.kind", "unit.paragraph", "held"))

    def scored(df: DataFrame, by: list[str]) -> DataFrame:
        """Adds z, the logits of the n-grams g of each group."""
        logits = [((F.sum(f"w{k}") + float(model.bias[k])) / model.temperature) for k in range(classes)]
        return df.join(weights, "g").groupBy(*by).agg(F.array(*logits).alias("z"))

    def probability(k: Column) -> Column:
        top = F.array_max("z")
        return F.exp(F.get("z", k) - top) / F.aggregate(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)

    # Which templates are covered; the likeliest family of all n-grams; then every family of which a template is covered, by the
    # template's n-grams.
    met = held.select(*unit, F.explode("held").alias("g")).join(leads, "g").select(*unit, "template").distinct()

    def same(x: DataFrame, y: DataFrame, by: list[str]) -> list[Column]:
        return [x[c].eqNullSafe(y[c]) for c in by]

    pairs = met.join(held, same(met, held, unit)).select(*(met[c] for c in unit), "template", "held").join(templates, "template")
    n = F.size("of_template")
    pairs = pairs.withColumn("common", F.array_intersect("of_template", "held")).withColumn("coverage", F.size("common") / n)
    pairs = stage(pairs.where(F.col("coverage") >= least_coverage).select(*unit, "template", "of_family", "coverage", "common", "held"))
    single = pairs.select(*unit, "held").distinct().select(*unit, F.explode("held").alias("g"))
    likeliest = scored(single, unit).withColumn("family", (F.array_position("z", F.array_max("z")) - 1).cast("int"))
    likeliest = likeliest.select(*unit, F.struct("family", probability(F.col("family")).alias("probability")).alias("first"))
    full = [*unit, "template", "of_family", "coverage"]
    covered = scored(pairs.select(*full, F.explode("common").alias("g")), full).select(*full, probability(F.col("of_family")).alias("p"))
    covered = covered.join(likeliest, same(covered, likeliest, unit)).select(*(covered[c] for c in full), "p", "first")
    is_first = F.col("of_family") == F.col("first.family")
    p = F.when(is_first & (F.col("first.probability") >= least_probability), F.col("first.probability")).otherwise(F.col("p"))
    covered = covered.withColumn("p", p).where(F.col("p") >= least_probability)
    covered = covered.join(templates.select("template", "of_template", "of_all"), "template")
    rank = F.struct((~is_first).alias("later"), (-F.col("coverage")).alias("c"), (-F.col("p")).alias("q"), "template", F.col("of_family").alias("family"), F.col("p").alias("probability"), "coverage", "of_template", "of_all")
    candidates = covered.groupBy(*unit).agg(F.array_sort(F.collect_list(rank)).alias("candidates"))
    candidates = candidates.join(held, same(candidates, held, unit)).select(*(candidates[c] for c in unit), "candidates", "held")
    found = "struct<family:int,probability:double,coverage:double>"

    def accept(taken: Column, c: Column) -> Column:
        """A candidate is taken if what no family before it explains of its template is covered too."""
        fresh = F.array_except(c["of_template"], taken["explained"])
        good = (F.size(fresh) > 0) & (F.size(F.array_intersect(fresh, F.col("held"))) >= F.size(fresh) * F.lit(least_coverage))
        more = F.struct(F.array_union(taken["explained"], c["of_all"]).alias("explained"), F.concat(taken["found"], F.array(F.struct(c["family"].alias("family"), c["probability"].alias("probability"), c["coverage"].alias("coverage")))).alias("found"))
        return F.when(good, more).otherwise(taken)

    none = F.struct(F.array().cast("array<int>").alias("explained"), F.array().cast(f"array<{found}>").alias("found"))
    taken = stage(candidates.select(*unit, F.inline(F.aggregate("candidates", none, accept)["found"])))
    # What a line tells by itself is not told again for the lines around it.
    told = taken.where("kind = 0").select(F.col("doc").alias("_doc"), F.col("block").alias("_block"), F.col("family").alias("_family")).distinct()
    around = taken.where("kind = 1").join(told, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("block") == F.col("_block")) & (F.col("family") == F.col("_family")), "left_anti")
    best = taken.where("kind = 0").unionByName(around)
    names = F.array(*map(F.lit, model.families))
    return best.select("doc.doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.element_at(names, F.col("family") + 1).alias("family"), "probability", "coverage")


def op10_license_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("coverage", 6).alias("coverage"))
