"""Chat formatting of reply trees.

Iterative self-joins double the distance that each message knows about its ancestors: after k rounds every
message has its 2^k-th ancestor and the score of the stretch between. When no message has an ancestor left
unseen, every leaf has the score of its root-to-leaf path. Leaves are ranked per tree, the best are taken, and
the stored ancestor tables are walked from the largest step to the smallest to enumerate each chosen path, so
a thread of depth d takes 2 log2(d) joins.

Template: each turn is <s>[INST]role[/INST]text</s>. Inside roles and texts a backslash, "<" and "[" are
written \\\\, \\( and \\{, so no control string can occur there, and reading back is exact. The loss mask is a
list of code point spans, one for the text of each assistant turn.

Defined edge cases: null text and null role are empty; a message whose parent is absent is a root; messages
on a cycle belong to no path; ties in score go to the lower leaf; a null tree is a tree like any other; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
LEARN = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\(")), F.lit("["), F.lit("\\{"))


def unescape(text: Column) -> Column:
    """Two backslashes stand for one; between them the other two signs are put back."""
    plain = F.transform(
        F.split(text, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\("), F.lit("<")), F.lit("\\{"), F.lit("[")),
    )
    return F.array_join(plain, "\\")


def _keyed(df: DataFrame) -> DataFrame:
    """df with tree wrapped, so that a null tree joins like any other; tree.tree is what it was."""
    return df.withColumn("tree", F.struct("tree"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """nodes: tree, node, parent, score -> tree, leaf, branch (rank from 1), node, place (0 at the root).

    The score of a path is the mean of its messages' scores.
    """
    keys = ["tree", "node"]
    nodes = stage(_keyed(nodes).select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = nodes.join(known, ["tree", "parent"], "left_semi").select(*keys, F.col("parent").alias("up"))
    state = stage(nodes.join(up, keys, "left").select(*keys, "up", F.lit(1).alias("length"), F.col("score").alias("total")))
    steps = []
    for _ in range(math.ceil(math.log2(max(2, nodes.count()))) + 1):
        climbing = state.where("up is not null")
        if climbing.isEmpty():
            break
        steps.append(climbing.select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("length").alias("l2"), F.col("total").alias("t2"))
        higher = climbing.join(above, ["tree", "up"], "left").select(
            *keys,
            F.col("up2").alias("up"),
            (F.col("length") + F.coalesce("l2", F.lit(0))).alias("length"),
            (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"),
        )
        state = stage(state.where("up is null").unionByName(higher))
    leaves = state.where("up is null").join(up.select("tree", F.col("up").alias("node")).distinct(), keys, "left_anti")
    rank = Window.partitionBy("tree").orderBy((F.col("total") / F.col("length")).desc(), "node")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "length", F.row_number().over(rank).alias("branch")).where(F.col("branch") <= branches)
    walk = stage(leaves.select("tree", "leaf", "branch", "length", F.col("leaf").alias("node"), F.lit(0).alias("back")))
    for k in reversed(range(len(steps))):
        further = walk.join(steps[k], ["tree", "node"]).select("tree", "leaf", "branch", "length", F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        walk = stage(walk.unionByName(further))
    return walk.select("tree.tree", "leaf", "branch", "node", (F.col("length") - 1 - F.col("back")).alias("place"))


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """messages: tree, node, role, text. Gives tree, leaf, branch, formatted, loss array<struct<start, length>>."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = _keyed(paths).join(_keyed(messages).select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), role.alias("r"), text.alias("t")), ["tree", "node"])
    turns = turns.withColumn("turn", F.concat(F.lit(OPEN), "r", F.lit(MIDDLE), "t", F.lit(CLOSE)))
    path = ["tree", "leaf", "branch"]
    before = Window.partitionBy(*path).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + len(OPEN) + F.length("r") + len(MIDDLE)
    span = F.when(F.col("role") == LEARN, F.struct(F.col("start"), F.length("t").cast("long").alias("length")))
    whole = turns.withColumn("start", start.cast("long")).groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("place", "turn", span.alias("span")))).alias("all"))
    return whole.select(
        "tree.tree",
        *path[1:],
        F.array_join(F.col("all.turn"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>> and learned (all text under the loss mask), from the output alone."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        half = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), r"\[/INST\]", 2)
        return F.struct(unescape(half[0]).alias("role"), unescape(half[1]).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("learned", F.array_join(learned, ""))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A linear conversation as a tree: each row answers the one before it. Rows of one turn go by role, then text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select("tree", "node", (F.col("node") - 1).alias("parent"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    messages = stage(conversation_nodes(rows))
    written = stage(format_paths(messages, best_paths(messages)))
    back = read_back(written)
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
  sum(length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + length('<s>[INST][/INST]</s>')) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
