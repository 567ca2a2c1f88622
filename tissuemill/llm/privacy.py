"""Information-theoretic sanitisation of personal data.

Protected entities are emails, IP addresses, card numbers and phone numbers found by pattern. The corpus then
tells which other terms give an entity away. For a term t seen near an entity e (within NEAR words) the corpus
estimates P(e | t) = c(t, e) / c(t), where c(t, e) counts the occurrences of e with t near and c(t) all occurrences
of t; the disclosed information is log P(e | t) - log P(e) as a share of the -log P(e) that e holds. A term that
was seen with e in at least `least_documents` documents, of which P(e | t) is at least `least_given`, and which
discloses at least `least_disclosed` of e, is marked wherever it stands: removed if P(e | t) is at least
`remove_given`, otherwise generalised to its shape. Base spans always stay.

All counts cover all documents. Patterns run inside the JVM; positions come from the lengths of matches and of
the pieces between them, summed by a window over the matches of one document. The terms in question are
broadcast up to `broadcast_terms`; beyond that words are counted before they are joined.

Defined edge cases: null and empty texts have no spans; rows that repeat both doc_id and text are given the same
spans; rows that repeat a doc_id with other texts are separate documents; matches of different kinds may overlap
and all are reported; offsets count code points; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Base patterns, by the order of kinds. The look-behinds only spare the engine starts that cannot match.
#: Possessive quantifiers change no match, since what they hold cannot be given back to what follows; they keep the
#: engine from descending once for each repeat, which a long domain would turn into a stack overflow. Card keeps to runs of
#: at least 12 digits, since shorter ones are dropped anyway.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}{3,}"
NEAR = 6
LEAST_DOCUMENTS = 2
LEAST_GIVEN = 0.5
LEAST_DISCLOSED = 0.5
REMOVE_GIVEN = 0.9
BROADCAST_TERMS = 1_000_000
ROW = ["doc_id", "text_hash"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def digit(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), digit), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    parts = F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255
    )
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", n.between(12, 19) & _luhn(value))
        .otherwise(n.between(9, 15))
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _near(piece: Column, last: bool) -> Column:
    """The terms among the last or first words of a piece, lower-cased."""
    words = F.filter(F.split(piece, r"\s+"), lambda w: w != "")
    words = F.slice(words, F.greatest(F.size(words) - (NEAR - 1), F.lit(1)), NEAR) if last else F.slice(words, 1, NEAR)
    return F.transform(F.regexp_extract_all(F.array_join(words, " "), F.lit(TERM), 0), lambda t: F.lower(t))


def _matches(texts: DataFrame, patterns: dict[str, str], hints: dict[str, str], context: bool) -> DataFrame:
    """ROW, kind, i, begin, end, value (and near): each match of each pattern, positions in code points."""

    def of(kind: str) -> Column:
        pattern, text = F.lit(patterns[kind]), F.col("text")
        pieces, found = F.split(text, patterns[kind], -1), F.regexp_extract_all(text, pattern, 0)
        empty = F.array().cast("array<string>")
        worth = F.contains(text, F.lit(hints[kind])) if kind in hints else F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), F.when(worth, found).otherwise(empty).alias("found"), F.when(worth, pieces).otherwise(empty).alias("pieces"))

    each = texts.select(*ROW, F.inline(F.array(*map(of, patterns)))).where(F.size("found") > 0)

    def match(value: Column, i: Column) -> Column:
        gap = F.get("pieces", i)
        near = [F.concat(_near(gap, True), _near(F.get("pieces", i + 1), False)).alias("near")] if context else []
        return F.struct(i.alias("i"), F.length(gap).alias("gap"), F.length(value).alias("length"), value.alias("value"), *near)

    rows = each.select(*ROW, "kind", F.inline(F.transform("found", match))).dropDuplicates([*ROW, "kind", "i"])
    sofar = Window.partitionBy(*ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(sofar)
    return rows.withColumn("end", end).withColumn("begin", F.col("end") - F.col("length")).drop("gap", "length")


def base_matches(docs: DataFrame) -> DataFrame:
    """ROW, kind, begin, end, value, near: the valid base matches of all texts."""
    return _matches(_texts(docs), PATTERNS, HINTS, True).where(_valid(F.col("kind"), F.col("value"))).drop("i")


def _words(texts: DataFrame) -> DataFrame:
    found = texts.select(*ROW, F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("word"))
    return found.select(*ROW, F.lower("word").alias("term"))


def disclosing_terms(
    docs: DataFrame,
    matches: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    least_given: float = LEAST_GIVEN,
    least_disclosed: float = LEAST_DISCLOSED,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """term, given (largest P(e | t)), disclosed: the terms over the thresholds.

    P(e) is c(e) over the number of words of the corpus.
    """
    entity = F.concat_ws(":", "kind", F.lower("value"))
    seen = matches.select(*ROW, entity.alias("entity"), "begin", F.explode(F.array_distinct("near")).alias("term"))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("together"), F.count_distinct(F.struct(*ROW)).alias("documents"))
    pairs = stage(pairs.where(F.col("documents") >= least_documents))
    asked = pairs.select("term").distinct()
    # One pass counts both the asked terms and all words.
    words = _words(_texts(docs))
    if asked.count() <= broadcast_terms:
        counts = words.join(F.broadcast(asked.withColumn("hit", F.lit(True))), "term", "left").groupBy(F.when(F.col("hit"), F.col("term")).alias("term")).agg(F.count("*").alias("total"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("total"))
    counts = stage(counts)
    counted = counts.join(asked, "term", "left_semi")
    size = counts.agg(F.sum("total")).first()[0] or 0
    alone = matches.groupBy(entity.alias("entity")).agg(F.count("*").alias("occurrences"))
    rated = pairs.join(counted, "term").join(alone, "entity").withColumn("given", F.least(F.lit(1.0), F.col("together") / F.col("total")))
    own = -F.log(F.col("occurrences") / F.lit(max(2, size)))
    rated = rated.withColumn("disclosed", 1 + F.log("given") / own)
    return (
        rated.where((F.col("given") >= least_given) & (F.col("disclosed") >= least_disclosed))
        .groupBy("term")
        .agg(F.max("given").alias("given"), F.max("disclosed").alias("disclosed"))
    )


def term_spans(docs: DataFrame, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """ROW, begin, end, term, given: every place where a disclosing term stands."""
    few = terms.count() <= broadcast_terms
    told = F.broadcast(terms.select("term", "given")) if few else terms.select("term", "given")
    texts = _texts(docs)
    holding = stage(_words(texts).join(told, "term", "left_semi").select(*ROW).distinct())
    if holding.count() <= broadcast_terms:
        holding = F.broadcast(holding)
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    chosen = texts.join(holding.select(*(F.col(c).alias(f"_{c}") for c in ROW)), keys[0] & keys[1], "left_semi")
    found = _matches(chosen, {"term": TERM}, {}, False).withColumn("term", F.lower("value"))
    return found.join(told, "term").select(*ROW, "begin", "end", "term", "given")


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, text_hash, spans array<struct<begin, end, rank, kind, given>>: one row for each document that has any."""
    matches = stage(base_matches(docs))
    terms = stage(disclosing_terms(docs, matches, **thresholds))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    base = matches.select(*ROW, "begin", "end", rank.alias("rank"), "kind", F.lit(None).cast("double").alias("given"))
    more = term_spans(docs, terms).select(*ROW, "begin", "end", F.lit(len(KINDS) + 1).alias("rank"), F.lit("term").alias("kind"), "given")
    every = base.unionByName(more).groupBy(*ROW)
    return every.agg(F.array_sort(F.collect_list(F.struct("begin", "rank", "end", "kind", "given"))).alias("spans"))


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    other = found.select(*(F.col(c).alias(f"_{c}") for c in ROW), "spans")
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")), "left")


def sanitise(docs: DataFrame, remove_given: float = REMOVE_GIVEN, **thresholds) -> DataFrame:
    """doc_id, text: base spans become <KIND>, disclosing terms <REMOVED> or their shape; of overlapping spans the first counts."""
    each = _joined(_texts(docs), find(docs, **thresholds))

    def step(acc: Column, s: Column) -> Column:
        term = s["kind"] == "term"
        shape = F.regexp_replace(F.regexp_replace(F.substr("text", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")), r"\p{Lu}", "X"), r"\p{Ll}", "x")
        mark = F.when(~term, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["given"] >= remove_given, F.lit("<REMOVED>")).otherwise(shape)
        gap = F.substr("text", (acc["at"] + 1).cast("int"), (s["begin"] - acc["at"]).cast("int"))
        done = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mark).alias("out"))
        return F.when(s["begin"] >= acc["at"], done).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    body = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"))))
    return each.select("doc_id", F.coalesce(body, "text").alias("text"))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs)
    each = _joined(_texts(docs).select(*ROW), found).withColumn("spans", F.coalesce("spans", F.filter("spans", lambda s: F.lit(False)), F.array().cast(found.schema["spans"].dataType)))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return each.select("doc_id", *map(count, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
