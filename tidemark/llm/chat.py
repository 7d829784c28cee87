"""Chat formatting after collapsing cumulative snapshots of conversations.

A log that writes a conversation after each turn holds its beginnings again and again. Every turn's role
and text are hashed with the turn's place; the running exclusive-or of these hashes names each prefix of a
conversation. A conversation whose whole name is a shorter prefix's name in another one is dropped by an
anti-join; of equal conversations the one with the smallest conv_id stays. What stays is rendered.

Only hashes go through the windows and joins. Prefix names are made distinct, combined where they
are, before they are joined, so a first turn that a third of all conversations share is one row there.

Defined results: turns are in order of turn, then role, then the first ``KEY`` characters of the text
(nulls first in all), then a hash of the text, in hashing and rendering alike; equal turns of one conversation each count; a null role or text differs from
an empty one in hashing and renders empty; a row with a null conv_id belongs to no conversation that could
be named, so each is a conversation of one turn, with a null conv_id; an empty table gives no rows. Columns
other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import drop_written, written

#: How a turn is rendered.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
KEY = 64
ORDER = ["turn", "role", "_key", "_x", "_y"]


def hashed(turns: DataFrame) -> DataFrame:
    """Add what turns are ordered by: the beginning of the text and two hashes of role and text."""
    content = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    return turns.withColumn("_key", F.substring("text", 1, KEY)).withColumns({x: F.xxhash64(F.lit(seed), *content) for seed, x in ((1, "_x"), (2, "_y"))})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns of the prefix), a and b (two hashes of 64 bits), last (it is the whole)."""
    rows = hashed(turns).select("conv_id", *ORDER)
    names = [F.xxhash64("n", "_x").alias("a"), F.xxhash64("n", "_y").alias("b")]
    one = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER])
    placed = rows.where("conv_id is not null").withColumn("n", F.row_number().over(one)).select("conv_id", "n", *names)
    line = W.partitionBy("conv_id").orderBy("n")
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    named = placed.select("conv_id", "n", *[F.bit_xor(c).over(upto).alias(c) for c in ("a", "b")], F.lead(F.lit(True)).over(line).isNull().alias("last"))
    # Rows without a conv_id are conversations of one turn each, so no window holds them.
    unnamed = rows.where("conv_id is null").withColumn("n", F.lit(1)).select("conv_id", "n", *names, F.lit(True).alias("last"))
    return named.unionByName(unnamed)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (equal conversations), a and b of those that no longer one begins with."""
    found = written(prefixes(turns), "prefixes")
    whole = found.where("last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    shorter = found.where("not last").select("n", "a", "b").distinct()
    kept = written(whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies", "a", "b"), "maximal")
    drop_written(found)
    return kept


def rendered() -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(END))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, text: the turns of each conversation that has a conv_id as one text."""
    rows = hashed(turns.where("conv_id is not null")).withColumn("_one", rendered())
    # Of two structs the one with a null in the first place that differs comes first.
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "_one"))).alias("_all"))
    return by.select("conv_id", F.array_join(F.transform("_all", lambda t: t["_one"]), "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of every maximal conversation."""
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = maximal(turns)
    named = kept.where("conv_id is not null").select("conv_id", "n_turns", "copies")
    stay = turns.join(named.select("conv_id"), "conv_id", "left_semi")
    unnamed = hashed(turns.where("conv_id is null")).withColumns({"a": F.xxhash64(F.lit(1), "_x"), "b": F.xxhash64(F.lit(1), "_y")}).withColumn("text", rendered())
    unnamed = kept.where("conv_id is null").join(unnamed.select("a", "b", "text").dropDuplicates(["a", "b"]), ["a", "b"])
    return named.join(render(stay), "conv_id").unionByName(unnamed.select("conv_id", "n_turns", "copies", "text"))
