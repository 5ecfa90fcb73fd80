"""Chat formatting with collapse of cumulative snapshots; DataFrame functions only.

A log often holds a conversation once for each turn that was added.  Every turn
extends a rolling hash of the turns up to it (sums of three 36-bit lanes of
position-dependent hashes, so a prefix's hash is a running sum).  The hashes of
all proper prefixes, made distinct before they are dealt, remove by an anti-join
each conversation that is a prefix of a longer one; of equal conversations the
smallest id stays.  Only what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

_LANE = (1 << 36) - 1  # so that a sum of 2^27 turns fits
LANES = ("p0", "p1", "p2")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n and the rolling hash after each of the n turns of a conversation.

    Turns are taken in the order of turn, role, text, nulls first; a null role or
    text counts as empty.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lanes = [F.sum(F.xxhash64(F.lit(i), "k", "role", "text").bitwiseAND(F.lit(_LANE))).over(upto).alias(p) for i, p in enumerate(LANES)]
    return t.select("conv_id", "k", "n", *lanes)


def maximal(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations) of the conversations that are no prefix of a longer one."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    p = scratch.write(prefixes(turns), "prefixes")  # numbers only: turns are dealt by conversation once for it
    whole = p.filter("k = n").groupBy("n", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    shorter = p.filter("k < n").groupBy(F.col("k").cast("bigint").alias("n"), *LANES).agg(F.lit(1).alias("one")).drop("one")
    kept = whole.join(shorter, ["n", *LANES], "left_anti")
    return kept.select("conv_id", F.col("n").cast("int").alias("n_turns"), "copies")


def render(turns: Column) -> Column:
    """ChatML of an array of (turn, role, text)."""
    one = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, one), "")


def formatted(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, n_turns, copies, rendered of every maximal conversation.

    Turns without a conv_id are one conversation; repeated turns are turns; an
    empty table gives an empty one; further columns are ignored.  A conversation
    is one value of the result, so its turns meet in one task.
    """
    # a plain key, so that join and aggregate share one exchange; no id has the null one's
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-"))
    kept = maximal(turns, scratch).select(key.alias("kept_key"), "n_turns", "copies")
    t = turns.select("conv_id", key.alias("key"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    whole = t.join(kept, F.col("key") == F.col("kept_key")).groupBy("key", "n_turns", "copies").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", "n_turns", "copies", render(F.col("turns")).alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rendered
  FROM conversations GROUP BY conv_id),
g AS (SELECT turns, rendered, min(conv_id) AS conv_id, count(*) AS copies FROM t GROUP BY turns, rendered)
SELECT conv_id, CAST(len(turns) AS INTEGER) AS n_turns, copies, rendered FROM g
WHERE NOT EXISTS (SELECT 1 FROM g AS o WHERE len(o.turns) > len(g.turns) AND o.turns[1:len(g.turns)] = g.turns)
"""
