"""Document fingerprints by Order MinHash.

A text is its words; its k-mers are runs of K words, each numbered by how often it occurred before, so that
repeats differ. Every numbered k-mer is hashed once, to a point of a circle. There are FUNCTIONS functions, each an order
of all k-mers of the text: by the point, going around from the function's own start; the starts are evenly spread. Of each
function the LENGTH smallest k-mers of the whole text are taken, put back into text order and hashed as a tuple, so a
tuple is short only if the whole text is. Two texts agree in a function if they chose the same k-mers in the same order
there, which is what makes the signature sensitive to edit distance rather than to the set of k-mers alone. The likeness
of two fingerprints is the share of functions in which they agree. The functions are rotations of one hash, not
independent: the expected likeness is that of independent ones, but of a text with fewer k-mers than functions,
neighbouring functions choose the same tuple, so its likeness scatters as that of as many functions as it has k-mers.

Everything is array functions on one row; nothing but the texts themselves is shuffled, once, to bring each
document next to its successor. Successors come from ranges of doc_id: within a range by a window, across ranges
by joining the first document of the next range that has any.

Hashes inside a text are compared by 40 bits and places by 24, so texts of up to 16.7 million words are told
apart exactly in order; beyond that places repeat, which leaves equal texts equal.

Defined edge cases: null is empty; a text without words has an empty fingerprint, and two such are alike (1);
a text of fewer than K words has one k-mer, all its words; rows with equal doc_id are ordered by text, null
doc_ids come first; the only document is its own successor; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table

K = 2
FUNCTION_BITS = 6
FUNCTIONS = 1 << FUNCTION_BITS
LENGTH = 2
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1

def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column by a generator, which the optimizer never merges into what reads the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _arc(x: Column) -> Column:
    """The function whose start lies next before a point; arcs ascend with the points."""
    return F.shiftright(x, 64 - FUNCTION_BITS).cast("int") + FUNCTIONS // 2


def with_cells(df: DataFrame, text: str, out: str, k: int = K, length: int = LENGTH) -> DataFrame:
    """Adds `out`: array of function << 32 | 32 bits of the function's tuple hash, by function."""
    nothing = F.array().cast("array<long>")
    keep = df.columns
    df = _held(df, "_words", F.regexp_extract_all(F.col(text), F.lit(WORD), 0))
    n = F.size("_words")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k))
    kmer = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(*(F.get("_words", i + j) for j in range(k))), PLACE_BITS).bitwiseOR(i.bitwiseAND(F.lit(PLACE))))
    few = F.array(F.shiftleft(F.xxhash64("_words"), PLACE_BITS))
    df = _held(df, "_sorted", F.sort_array(F.when(n >= k, kmer).when(n > 0, few).otherwise(nothing)))
    first = F.filter(F.transform("_sorted", lambda x, i: F.when((i > 0) & (F.shiftright(F.get("_sorted", i - 1), PLACE_BITS) == F.shiftright(x, PLACE_BITS)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    df = _held(df, "_first", first)
    numbers = F.transform("_first", lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get("_first", j + 1), F.size("_sorted")) - at - 1))
    df = _held(df, "_number", F.flatten(numbers))
    hashed = F.zip_with("_sorted", "_number", lambda x, c: F.xxhash64(F.shiftright(x, PLACE_BITS), c).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))
    df = _held(df, "_hashed", F.sort_array(hashed))
    # The LENGTH smallest k-mers of a function lie among the first LENGTH of each arc, one after the other.
    least = F.filter("_hashed", lambda x, i: (i < length) | (_arc(F.get("_hashed", i - length)) != _arc(x)))
    df = _held(df, "_least", least)
    opens = F.filter(F.transform("_least", lambda x, i: F.when((i > 0) & (_arc(F.get("_least", i - 1)) == _arc(x)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    df = _held(df, "_opens", opens)

    def tuple_hash(at: Column) -> Column:
        """Of the k-mers from one point on, around the circle, in text order."""
        taken = [F.get("_least", (at + j) % F.size("_least")) for j in range(length)]
        placed = [F.shiftleft(x.bitwiseAND(F.lit(PLACE)), 63 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS + 1)) for x in taken]
        ordered = F.sort_array(F.array_distinct(F.array(*placed)))
        return F.shiftrightunsigned(F.xxhash64(F.transform(ordered, lambda y: y.bitwiseAND(F.lit((1 << 63 - PLACE_BITS) - 1)))), 32)

    # All functions that start between two used arcs choose the same tuple; those after the last one begin anew.
    used = F.transform("_opens", lambda at: F.struct(_arc(F.get("_least", at)).alias("arc"), tuple_hash(at).alias("hash")))
    df = _held(df, "_used", used)

    def cells_of(first: Column, last: Column, held: Column) -> Column:
        functions = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(functions, lambda b: F.shiftleft(b.cast("long"), 32).bitwiseOR(held))

    inner = F.flatten(F.transform("_used", lambda u, j: cells_of(F.coalesce(F.get("_used", j - 1)["arc"] + 1, F.lit(0)), u["arc"], u["hash"])))
    around = cells_of(F.element_at("_used", -1)["arc"] + 1, F.lit(FUNCTIONS - 1), F.get("_used", F.lit(0))["hash"])
    cells = F.when(F.size("_used") > 0, F.concat(inner, around)).otherwise(nothing)
    return _held(df, out, cells).select(*keep, out)


def likeness(a: str, b: str) -> Column:
    bins = [F.transform(c, lambda x: F.shiftright(x, 32)) for c in (a, b)]
    used = F.size(F.array_union(*bins))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def written(cells: str) -> Column:
    """Ten hexadecimal digits for each function: its number and its hash."""
    return F.array_join(F.transform(cells, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_cells(plain, "text", "cells").select("doc_id", written("cells").alias("fingerprint"))


def successors(docs: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, heads). rows: part, doc_id, text, place, following (null for the last of its part).
    heads: part, following (the first text of the next part that has any; after the last part, of the first)."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = plain.agg(F.percentile_approx("doc_id", steps, 20 * ranges)).first()[0] if steps else None
    bounds = sorted(set(bounds or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    plain = plain.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    order = Window.partitionBy("part").orderBy("doc_id", "text")
    rows = plain.select("part", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("following"))
    least = plain.groupBy("part").agg(F.min("doc_id").alias("least"))
    heads = plain.join(F.broadcast(least.withColumnRenamed("part", "_part")), (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("least")))
    heads = heads.groupBy("part").agg(F.min("text").alias("following"))
    around = Window.orderBy("part")  # one row for each range
    owner = F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy()))
    return rows, stage(heads.select(owner.alias("part"), "following"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each text against its edited form and the next document; see op4's contract."""
    rows, heads = successors(docs)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    joined = rows.join(heads.withColumnRenamed("following", "head"), "part").withColumn("next_text", F.coalesce("following", "head"))
    joined = joined.select("part", "place", "doc_id", "text", n.cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"))
    marked = with_cells(with_cells(joined, "text", "cells"), "edited", "edited_cells")
    marked = marked.select("part", "place", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "cells", "edited_cells")
    after = with_cells(heads, "following", "head_cells").select("part", "head_cells")
    order = Window.partitionBy("part").orderBy("place")
    marked = marked.withColumn("next_cells", F.lead("cells").over(order)).join(after, "part").withColumn("next_cells", F.coalesce("next_cells", "head_cells"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("cells").alias("fingerprint"),
        written("edited_cells").alias("edited_fingerprint"),
        likeness("cells", "edited_cells").alias("near_edited"),
        likeness("cells", "next_cells").alias("near_next"),
    )


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
