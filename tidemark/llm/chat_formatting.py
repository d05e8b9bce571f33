r"""Chat formatting: reply trees to formatted conversations, with DataFrame functions only.

Messages point to the message they answer. Self-joins that double their reach each round (as many
rounds as the logarithm of the largest tree) give every message its depth and the sum of scores
on its path; each tree's leaves are ranked by that score; a second pass of the same joins, from
the farthest reach down, enumerates the messages on the chosen root-to-leaf paths. Text takes no
part in these joins and is joined once, when the paths are known.

The template writes a turn as ``<s>role[INST]text</s>``. Inside roles and texts every control
string gets a backslash after its first character (and one that has backslashes there one more),
which reads back unchanged. The loss mask is a list of spans over the formatted text: the
assistants' texts, without the marks around them.

Defined results: a null text or role is empty; a message whose parent is missing starts a tree of
its own; messages of a cycle have no root and belong to no path; rows with equal turn are ordered
by role and text, and repeated rows stay separate turns; a null conversation id is a conversation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

OPEN, ROLE_END, CLOSE = "<s>", "[INST]", "</s>"
_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, id, place (0 for the root) of the messages on each tree's best branches.

    ``messages``: tree, id (unique within the tree), parent, score.
    """
    known = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    links = (
        messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
        .join(known, ["tree", "parent"], "left")
        .select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"))
        .withColumn("hops", F.col("up").isNotNull().cast("long"))
    )
    reach = [written(links, "reach")]
    most = reach[0].groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, math.ceil(math.log2(most)))
    for _ in range(rounds):
        near = reach[-1]
        far = near.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        moving = near.where("up is not null")  # the rest has reached its root and is not joined again
        further = moving.join(far, ["tree", "up"], "left").select(
            "tree", "id", F.col("up2").alias("up"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
            (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"),
        )
        reach.append(written(further.unionByName(near.where("up is null").select(further.columns)), "reach"))
    parents = reach[0].where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = reach[-1].where("up is null").join(parents, ["tree", "id"], "left_anti")
    ranks = Window.partitionBy("tree").orderBy(F.desc("total"), "id")
    chosen = leaves.withColumn("nth", F.row_number().over(ranks)).where(F.col("nth") <= per_tree)
    path = chosen.select("tree", F.col("id").alias("leaf"), "id", F.col("hops").alias("place"))
    for k in range(rounds - 1, -1, -1):
        step = reach[k].where("up is not null").select("tree", "id", "up")
        both = F.array(F.struct(F.col("id"), F.col("place")), F.struct(F.col("up").alias("id"), (F.col("place") - 2**k).alias("place")))
        path = path.join(step, ["tree", "id"], "left").select("tree", "leaf", F.explode(both).alias("at")).where("at.id is not null").select("tree", "leaf", "at.id", "at.place")
    return path


def formatted(turns: DataFrame) -> DataFrame:
    """tree, leaf, formatted, loss_spans (start, end in characters) of each path.

    ``turns``: tree, leaf, place, role, text.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    rows = turns.select("tree", "leaf", "place", (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(OPEN), role, F.lit(ROLE_END)).alias("head"), text.alias("body"))
    rows = rows.withColumn("width", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("said"), F.when(F.col("learn"), F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))).alias("span"))
    every = F.array_sort(F.collect_list(turn))
    return rows.groupBy("tree", "leaf").agg(every.alias("every")).select(
        "tree", "leaf",
        F.array_join(F.col("every.said"), "").alias("formatted"),
        F.filter(F.col("every.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(F.substr(text, F.lit(1), F.length(text) - len(CLOSE)), CLOSE, -1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, ROLE_END, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(part, F.length(head) + len(ROLE_END) + 1)).alias("text"),
        )

    return F.transform(parts, turn)


def chains(rows: DataFrame) -> DataFrame:
    """Messages of conversations in which every turn answers the one before it."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    out = rows.select("conv_id", "turn", "role", "text", tree.alias("tree")).withColumn("id", F.row_number().over(order).cast("long"))
    return out.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(1.0)).drop("turn")


def format_chats(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, formatted and loss_spans of the best branches of each tree of ``messages``."""
    messages = written(messages, "messages")
    paths = best_paths(messages.select("tree", "id", "parent", "score"), per_tree)
    return formatted(paths.join(messages.select("tree", "id", "role", "text"), ["tree", "id"]))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(extra)
    out = format_chats(chains(rows)).withColumn("turns", read_back(F.col("formatted")))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumn("learnt", learnt)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).cast("bigint").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(13 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
