"""Preference formatting of conversations (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import table


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Per pair: pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, paired.

    pair: the pair that a turn belongs to; chosen: whether it is of the chosen side. The longest common prefix of both sides, by role and text,
    is rendered once as prompt; the rest of either side is its completion. A mask lists the completion's segments as length:1 where a
    model is trained (turns of role trained) and length:0 where not, in code points. A pair of one side alone comes out with
    paired false, everything in its completion and null on the other side. Null roles and texts count as empty; rows of a null pair belong to no
    conversation and are left out. Turns are ordered by number (null first), role and text, so that repeated turns have a fixed place.
    Texts are rendered as they are: markers that a text holds are not escaped, and it is the masks' lengths that tell segments apart.
    A pair's turns meet in one row, as they do in the result; no other grouping is used.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("side"), F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).alias("t"))
    side = lambda flag: F.sort_array(F.collect_list(F.when(F.col("side") == F.lit(flag), F.col("t"))))
    both = rows.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differ = lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"])
    first = F.get(F.filter(F.sequence(F.lit(0), least - 1), differ), F.lit(0))
    both = both.withColumn("k", F.when(least > 0, F.coalesce(first, least)).otherwise(F.lit(0)))
    text = lambda c: F.array_join(F.transform(c, rendered), "")
    mask = lambda c: F.array_join(F.transform(c, lambda t: F.concat(F.length(rendered(t)).cast("string"), F.when(t["role"] == trained, ":1").otherwise(":0"))), ",")
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))
    there = lambda c, x: F.when(F.size(c) > 0, x)
    return both.select(
        "pair_id",
        F.col("k").alias("prompt_turns"),
        text(F.slice("c", F.lit(1), F.col("k"))).alias("prompt"),
        there("c", text(rest("c"))).alias("chosen"),
        there("c", mask(rest("c"))).alias("chosen_mask"),
        there("r", text(rest("r"))).alias("rejected"),
        there("r", mask(rest("r"))).alias("rejected_mask"),
        (least > 0).alias("paired"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no preferences: conversations 2n and 2n + 1 make pair n, the even one as chosen."""
    return format_preferences(table(spark, sf_dir, "conversations"), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)


SQL = """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT pair_id, coalesce(list_sort(list(t) FILTER (side)), []) AS c, coalesce(list_sort(list(t) FILTER (NOT side)), []) AS r FROM t GROUP BY pair_id),
k AS (SELECT *, least(len(c), len(r)) AS n FROM g),
f AS (SELECT *, coalesce(list_min(list_filter(range(0, n), lambda i: c[i + 1].role <> r[i + 1].role OR c[i + 1].text <> r[i + 1].text)), n) AS k FROM k),
x AS (SELECT *, list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS cs,
                list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS rs FROM f)
SELECT pair_id, k::INT AS prompt_turns, array_to_string(cs[1:k], '') AS prompt,
       CASE WHEN len(c) > 0 THEN array_to_string(cs[k + 1:], '') END AS chosen,
       CASE WHEN len(c) > 0 THEN array_to_string(list_transform(range(k, len(c)), lambda i: length(cs[i + 1]) || CASE WHEN c[i + 1].role = 'assistant' THEN ':1' ELSE ':0' END), ',') END AS chosen_mask,
       CASE WHEN len(r) > 0 THEN array_to_string(rs[k + 1:], '') END AS rejected,
       CASE WHEN len(r) > 0 THEN array_to_string(list_transform(range(k, len(r)), lambda i: length(rs[i + 1]) || CASE WHEN r[i + 1].role = 'assistant' THEN ':1' ELSE ':0' END), ',') END AS rejected_mask,
       n > 0 AS paired
FROM x
"""
