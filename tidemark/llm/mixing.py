"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Words are the unit. Every source has a target number of words. Its words, laid end to end shard after
shard and in doc_id order inside a shard, are cut into blocks of equal size; the last block of a
source alone may be shorter. Targets become whole numbers of blocks by highest quotients (divisors 1, 3,
5, ...), first over sources and then over the shards of each source. Inside a shard a seeded order of the
blocks says which are taken once more than the others.

A source that stops at its cap takes all of it; one that has less than a block is taken as often as comes
nearest its target; the others share the rest of the blocks. A source's quota is its size some times over,
the short block included, and so many of its full blocks once more, by quotients over its shards. Those of a
shard are never more than its full blocks, so nothing of a quota is lost.

A shard holds about ``SHARD_DOCS`` documents, or more where a source would have over ``MOST_SHARDS`` shards. No
window is larger than a shard, but for those over the tables of sources and of a source's shards.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of
its own and sorts last; a null doc_id sorts first in its shard, which is chosen by its text; repeated rows
are documents of their own in ``mix`` and one document in ``take``; an empty table gives an empty table.
Columns other than doc_id, text and source are ignored by ``mix`` and carried by ``take``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import drop_written, written

BLOCK_WORDS = 64
SHARD_DOCS = 2048
MOST_SHARDS = 1 << 16
WORD = r"[^\\x20\\x09-\\x0D]+"


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, to: str) -> DataFrame:
    """Add column ``to``: the seats of each party, by highest quotients weight / (2 s + 1).

    ``seats`` is the house of the party's group. Rounding weight / (total / seats) is the exact
    apportionment of a house of some other size; the method is house-monotone, so what is missing
    goes to the next highest quotients, and what is too much leaves by the lowest given ones. A
    party's share of either is at most its part of (missing + parties), which bounds the quotients
    looked at. Ties go by ``key``.
    """
    g = W.partitionBy(*group)
    base = (
        parties.withColumn("_sum", F.sum(weight).over(g))
        .withColumn("_n", F.count(F.lit(1)).over(g))
        .withColumn("_base", F.when(F.col("_sum") > 0, F.floor(F.col(seats) * F.col(weight) / F.col("_sum") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_off", F.col(seats) - F.sum("_base").over(g))
    )
    reach = F.ceil(F.col(weight) / F.col("_sum") * (F.abs("_off") + F.col("_n"))).cast("long") + 1
    steps = F.when(F.col("_off") > 0, reach).otherwise(F.least(reach, F.col("_base")))
    quotients = (
        base.where((F.col("_off") != 0) & (F.col(weight) > 0) & (steps > 0))
        .select(*group, *key, weight, "_base", "_off", F.explode(F.sequence(F.lit(1).cast("long"), steps)).alias("_j"))
        .withColumn("_s", F.when(F.col("_off") > 0, F.col("_base") + F.col("_j") - 1).otherwise(F.col("_base") - F.col("_j")))
        .withColumn("_q", F.col(weight) / (2 * F.col("_s") + 1))
        .withColumn("_rank", F.row_number().over(g.orderBy(F.when(F.col("_off") > 0, -F.col("_q")).otherwise(F.col("_q")), *key)))
        .where(F.col("_rank") <= F.abs("_off"))
        .groupBy(*group, *key)
        .agg(F.sum(F.signum("_off")).cast("long").alias("_more"))
    )
    on = list(dict.fromkeys([*group, *key]))
    return base.join(quotients, on, "left").withColumn(to, F.col("_base") + F.coalesce("_more", F.lit(0))).drop("_sum", "_n", "_base", "_off", "_more")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """One row a source: source_no (from 1, by code point, null last), source_size, docs, target."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    every, order = W.partitionBy("_one"), W.partitionBy("_one").orderBy("_ratio", "source_no")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    level = (
        by.withColumn("_one", F.lit(1))
        .withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", w)
        .withColumn("_cap", float(most) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", share * F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_no", "_level"))).over(every)["_level"])
    )
    # Sources stop at their cap in the order of cap by weight; the first level that lies under the
    # next cap is the one that the rest share.
    return level.withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap"))).select("source", "source_no", "source_size", "docs", "target", "_total")


def plan(docs: DataFrame, weights: list[int] = [3, 1, 2], share: float = 1.5, most: int = 2, seed: int = 42, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents and their places in their sources, blocks and how often each is taken)."""
    size = F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long")
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))), 1, 8), 16, 10).cast("long")
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("_same"), size.alias("size"), digest.alias("_digest"))
    sizes = written(sizes.dropDuplicates(["doc_id", "source", "_same"]) if distinct else sizes, "mix-sizes")

    full = F.floor(F.col("source_size") / block_words).cast("long")
    sources = source_targets(sizes, weights, share, most).withColumn("_full", full)
    sources = sources.withColumn("_own", (F.col("target") >= most * F.col("source_size")) | (F.col("_full") == 0))
    spent = F.coalesce(F.sum(F.when(F.col("_own"), F.col("target"))).over(W.partitionBy(F.lit(1))), F.lit(0.0))
    sources = sources.withColumn("_house", F.greatest(F.lit(0), F.round((F.col("_total") - spent) / block_words)).cast("long"))
    sources = sainte_lague(sources, ["_own"], ["source_no"], "target", "_house", "quota")
    words = F.least(F.col("quota") * block_words, most * F.col("source_size"))
    times = F.when(F.col("_own"), F.floor(F.col("target") / F.greatest(F.lit(1), F.col("source_size")) + 0.5)).otherwise(F.floor(words / F.greatest(F.lit(1), F.col("source_size")))).cast("long")
    sources = sources.withColumn("_times", times).withColumn("_rest", F.when(F.col("_own"), 0).otherwise(F.least(F.col("_full"), F.floor((words - F.col("_times") * F.col("source_size")) / block_words + 0.5))).cast("long"))
    sources = written(sources.select("source", "source_no", "source_size", "target", "_full", "_times", "_rest", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("docs") / shard_docs)).cast("long").alias("_shards")), "mix-sources")

    placed = (
        sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]), "inner")
        .drop(sources["source"])
        .withColumn("shard", F.col("_digest") % F.col("_shards"))
        .withColumn("_to", F.sum("size").over(W.partitionBy("source_no", "shard").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, 0)))
    )
    inside = written(placed.select("doc_id", "_same", "source", "size", "source_no", "source_size", "target", "shard", "_to"), "mix-placed")

    line = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = inside.groupBy("source_no", "shard").agg(F.max("_to").alias("_words")).withColumn("_start", F.coalesce(F.sum("_words").over(line), F.lit(0)))
    # A block belongs to the shard that its first word is in.
    begins = lambda at: F.least(F.col("_full"), F.ceil(at / block_words).cast("long"))
    shards = shards.join(sources.select("source_no", "_full", "_times", "_rest"), "source_no").withColumn("_first", begins(F.col("_start"))).withColumn("_many", begins(F.col("_start") + F.col("_words")) - F.col("_first"))
    shards = sainte_lague(shards, ["source_no"], ["shard"], "_many", "_rest", "_won").withColumn("_upto", F.coalesce(F.sum(F.col("_times") * F.col("_many") + F.col("_won")).over(line), F.lit(0)))
    shards = written(shards.select("source_no", "shard", "_start", "_first", "_many", "_times", "_won", "_upto"), "mix-shards")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        shards.where("_many > 0")
        .repartition(parts, "source_no", "shard")  # a shard's row becomes thousands of rows
        .select("source_no", "shard", "_times", "_won", "_upto", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_many") - 1)).alias("block"))
    )
    shard = W.partitionBy("source_no", "shard")
    lot = F.md5(F.concat_ws(":", F.lit(seed), "source_no", "shard", "block"))
    blocks = (
        blocks.withColumn("_rank", F.row_number().over(shard.orderBy(lot, "block")))
        .withColumn("times", F.col("_times") + (F.col("_rank") <= F.col("_won")).cast("long"))
        .withColumn("_before", F.col("_upto") + F.coalesce(F.sum("times").over(shard.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("source_no", "block", "times", "_before")
    )
    short = sources.where(F.col("source_size") > F.col("_full") * block_words)
    blocks = blocks.unionByName(short.select("source_no", F.col("_full").alias("block"), F.col("_times").alias("times"), (F.col("_times") * F.col("_full") + F.col("_rest")).alias("_before")))
    # Written, so that Spark knows the size and does not take it for that of the shards' few rows.
    blocks = written(blocks, "mix-blocks").hint("merge")
    drop_written(sizes)
    placed = inside.join(shards.select("source_no", "shard", "_start"), ["source_no", "shard"]).withColumn("_to", F.col("_to") + F.col("_start")).withColumn("_from", F.col("_to") - F.col("size"))
    return placed.select("doc_id", "_same", "source", "size", "source_no", "source_size", "target", "shard", "_from", "_to"), blocks


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, and its place in its source.

    ``taken``: words that the mix takes of the document, repeats counted; at most ``most`` (a whole
    number) times its size.
    """
    placed, blocks = plan(docs, block_words=block_words, **how)
    # A document takes what lies between its two ends, each looked up in the block that holds it.
    first, last = (blocks.select("source_no", *[F.col(c).alias(f"_{n}_{c}") for c in ("block", "times", "_before")]) for n in ("a", "b"))
    full = placed.where("size > 0").withColumn("_a_block", F.floor(F.col("_from") / block_words)).withColumn("_b_block", F.floor((F.col("_to") - 1) / block_words))
    upto = lambda n, at: F.col(f"_{n}__before") * block_words + F.col(f"_{n}_times") * (F.col(at) - F.col(f"_{n}_block") * block_words)
    taken = full.join(first, ["source_no", "_a_block"], "left").join(last, ["source_no", "_b_block"], "left").withColumn("taken", F.coalesce(upto("b", "_to") - upto("a", "_from"), F.lit(0)))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "shard", F.col("_from").alias("first_word")]
    return taken.select(*out).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def take(docs: DataFrame, block_words: int = BLOCK_WORDS, **how) -> DataFrame:
    """The mixed documents, with all columns of ``docs``: a row for each time round in which words of
    the document are taken, its text the words taken then, in order. A column n_chars follows the text.

    Rows that agree in doc_id, source and text are one document here; a document without words is not
    in the mix.
    """
    placed, blocks = plan(docs, block_words=block_words, distinct=True, **how)
    at = F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words))).alias("block")
    parts = placed.where("size > 0").select("doc_id", "_same", "source_no", "source", "_from", "_to", at).join(blocks, ["source_no", "block"]).where("times > 0")
    first = F.greatest(F.col("block") * block_words, F.col("_from")) - F.col("_from")
    end = F.least((F.col("block") + 1) * block_words, F.col("_to")) - F.col("_from")
    parts = parts.select("doc_id", "_same", "source", "times", first.cast("int").alias("s"), end.cast("int").alias("e"))
    parts = parts.select("doc_id", "_same", "source", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_round"), F.struct("s", "e").alias("_part"))
    rounds = parts.groupBy("doc_id", "_same", "source", "_round").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    # All columns of a document travel as one, so none of them can clash with those made here.
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.xxhash64("text").alias("_hash")).dropDuplicates(["_id", "_from", "_hash"])
    got = whole.join(rounds, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_hash").eqNullSafe(F.col("_same")) & F.col("_from").eqNullSafe(F.col("source")))
    got = got.withColumn("_words", F.expr("regexp_extract_all(_doc.text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))
    # The words are named twice, else Spark would find them anew for each part.
    got = got.withColumn("_text", F.expr("if(size(_words) = 0, '', array_join(flatten(transform(_parts, p -> slice(_words, p.s + 1, p.e - p.s))), ''))"))
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return got.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
