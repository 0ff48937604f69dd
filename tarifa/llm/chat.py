"""Chat formatting: cumulative logs of one conversation collapse to the longest, which is then rendered.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

LANE = (1 << 40) - 1     # 40-bit lanes: running sums of 2^23 turns stay within a long


def ordered_turns(df: DataFrame) -> DataFrame:
    """Turns with their place ``k`` (from 1), the length ``n`` of their conversation and the rolling
    prefix hash (s1, s2) of turns 1..k. Each turn is hashed with its place, so the running sums of two
    40-bit lanes identify the sequence."""
    t = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                  F.coalesce("text", F.lit("")).alias("text")).where(F.col("conv_id").isNotNull())
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.struct("turn", "role", "text")
    t = (t.withColumn("k", F.dense_rank().over(w)).withColumn("before", F.lag(same).over(w))
         .where(~F.col("before").eqNullSafe(same)).drop("before"))
    return (t.withColumn("s1", F.sum(F.xxhash64("k", "role", "text").bitwiseAND(F.lit(LANE))).over(run))
            .withColumn("s2", F.sum(F.xxhash64(F.lit("lane"), "text", "role", "k").bitwiseAND(F.lit(LANE))).over(run))
            .withColumn("n", F.max("k").over(Window.partitionBy("conv_id"))))


def collapse_and_render(df: DataFrame, head: str = "<|im_start|>", tail: str = "<|im_end|>\n") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, text.

    A logged conversation is left out when its whole turn sequence (role and text) begins a longer one;
    of conversations with the same sequence the smallest conv_id stands for all and ``copies`` counts
    them. Turns are ordered by turn, role, text (nulls first); rows that repeat turn, role and text count
    once; a null role or text is an empty string; rows without conv_id belong to no conversation. Extra
    columns are ignored, an empty table gives an empty result.

    Prefixes and whole sequences are grouped before the anti-join, so a first turn or a conversation
    shared by a third of the log arrives there as one row."""
    turns = checkpoint(ordered_turns(df))
    key = ["k", "s1", "s2"]
    whole = (turns.where("k = n").groupBy(*key)
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    begun = turns.where("k < n").select(*key).distinct()
    kept = whole.join(begun, key, "left_anti").select("conv_id", "copies")
    line = F.concat(F.lit(head), "role", F.lit("\n"), "text", F.lit(tail))
    return (turns.join(kept, "conv_id").groupBy("conv_id")
            .agg(F.max("copies").alias("copies"), F.count("*").alias("n_turns"),
                 F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
            .select("conv_id", "n_turns", "copies", F.array_join("lines.line", "").alias("text")))


SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (
  SELECT conv_id, k, n,
         string_agg(role || chr(30) || text || chr(31), '') OVER (PARTITION BY conv_id ORDER BY k) AS pre FROM o),
whole AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY pre),
kept AS (SELECT * FROM whole WHERE pre NOT IN (SELECT pre FROM p WHERE k < n))
SELECT o.conv_id, count(*) AS n_turns, max(kept.copies) AS copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM o JOIN kept USING (conv_id) GROUP BY o.conv_id
"""
