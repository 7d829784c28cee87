"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Every shingle of five words is hashed once (XXH64 over the words' hashes). The top seven bits of the hash
name one of 128 bins; each bin keeps its smallest hash. An empty bin borrows from a full one by
optimal densification: it goes through all bins in an order of its own, the same for every document,
and takes the first that is full. Of each bin the four lowest bits are kept, one hex digit a bin.
Two random bins agree in four bits one time in sixteen; ``likeness`` takes that out.

The next document by doc_id is found in ranges of rows: bounds are taken from a sample of at most about
``SAMPLED`` keys, so ranges hold about as many rows each whatever the ids are. They set which task
looks at a row and nothing else.

Defined results: a text of fewer than five words is one shingle of all its words; a text without
words (null, empty, blank) has the fingerprint ``-`` repeated, like itself (1) and like no other (0); null
doc_ids come last, rows of one doc_id follow each other by a hash of their texts, so equal rows lie side by
side; an empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BINS = 128
BITS = 4
WORDS = 5
SAMPLED = 1 << 16
MOST_RANGES = 20_000
RANGES_A_PARTITION = 16
SPACE = r"[\x20\x09-\x0D]+"
NONE = "-" * BINS


def probes(seed: int = 9) -> list[list[int]]:
    """For each bin the order in which it tries the others."""
    rnd = random.Random(seed)
    return [rnd.sample(range(BINS), BINS) for _ in range(BINS)]


def constant(value: list, kind: str) -> Column:
    """A nested list as one literal, which Spark parses once while it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def with_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add column ``to``, the fingerprint of the text in column ``text``."""
    keep = df.columns
    low, shift = 2**BITS - 1, 64 - BINS.bit_length() + 1
    # By round: where each bin looks in its first, second, ... try.
    rounds = constant([list(r) for r in zip(*probes())], "array<array<int>>").alias("_rounds")
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    rest = ", ".join(f"_w[i + {j}]" for j in range(1, WORDS))
    df = df.select(*keep, F.expr(f"sort_array(if(size(_w) >= {WORDS}, transform(slice(_w, 1, greatest(0, size(_w) - {WORDS - 1})), (x, i) -> xxhash64(x, {rest})), if(size(_w) > 0, array(xxhash64(_w)), cast(array() as array<bigint>))))").alias("_h"))
    df = df.select(*keep, F.expr(f"filter(_h, (x, i) -> i = 0 or shiftright(x, {shift}) != shiftright(_h[i - 1], {shift}))").alias("_m"))
    df = df.select(*keep, "_m", F.expr(f"transform(_m, x -> cast(shiftright(x, {shift}) + {BINS // 2} as int))").alias("_full"))
    df = df.select(*keep, "_m", F.expr(f"if(size(_full) = 0, cast(array() as array<int>), if(size(_full) = {BINS}, sequence(1, {BINS}), transform(sequence(0, {BINS - 1}), b -> cast(array_position(_full, b) as int))))").alias("_own"), rounds)
    borrow = lambda a, b, start: f"aggregate(sequence({a}, {b}), {start}, (now, k) -> if(array_contains(now, 0), transform(now, (p, b) -> if(p > 0, p, _own[_rounds[k][b]])), now))"
    df = df.select(*keep, "_m", "_own", F.expr(borrow(0, 7, "_own")).alias("_at"), "_rounds")
    df = df.select(*keep, "_m", F.expr(f"if(array_contains(_at, 0), {borrow(8, BINS - 1, '_at')}, _at)").alias("_at"))
    digit = f"substring('0123456789abcdef', cast(_m[p - 1] & {low} as int) + 1, 1)"
    return df.select(*keep, F.expr(f"if(size(_m) = 0, '{NONE}', array_join(transform(_at, p -> {digit}), ''))").alias(to))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness, 0 to 1, of two fingerprint columns."""
    chance = 2.0**-BITS
    same = F.expr(f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)") / F.lit(float(BINS))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == NONE) | (F.col(b) == NONE), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def ranges(docs: DataFrame) -> Column:
    """The number, from 0, of the range that a row's ``_key`` lies in. No range is empty."""
    every = max(1, docs.count() // SAMPLED)
    some = [tuple(r[0]) for r in docs.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).select("_key").distinct().orderBy("_key").collect()]
    n = min(MOST_RANGES, RANGES_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, len(some) // 2))
    # The least key of the sample lies in range 0, so that one is not empty; every other holds its bound.
    bounds = sorted({some[i * len(some) // n] for i in range(1, n)} - set(some[:1]))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = "struct<o:boolean,i:bigint,t:bigint>"
    named = lambda b: dict(zip("oit", b))
    upto = lambda c, key: F.size(F.filter(c, lambda b: b <= key))
    group = upto(constant([named(g[0]) for g in groups], f"array<{kind}>"), F.col("_key"))
    inside = constant([[named(b) for b in g] for g in groups], f"array<array<{kind}>>")
    return F.when(group == 0, 0).otherwise((group - 1) * step + upto(F.get(inside, group - 1), F.col("_key")))


def with_next(docs: DataFrame, carry: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``prepare(docs)`` with ``next_<c>`` for each column of ``carry``: its value in the next document by
    descending doc_id, and for the last document that of the first.

    A window looks inside each range of rows; the last row of a range is handed to the range after it. Rows
    are dealt to ranges once, before ``prepare`` adds to them.
    """
    docs = docs.withColumn("_key", F.struct(F.col("doc_id").isNotNull().alias("o"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("t")))
    docs = docs.withColumn("_range", ranges(docs.select("_key")))
    tops = docs.groupBy("_range").agg(F.max("_key").alias("_top"))
    n = tops.count()
    dealt = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_range")
    # This join and the window below read one and the same exchange.
    top = dealt.join(tops.hint("merge"), "_range").where("_key = _top").withColumn("_one", F.row_number().over(W.partitionBy("_range").orderBy("_key"))).where("_one = 1")
    top = prepare(top).select(((F.col("_range") + 1) % max(1, n)).cast("int").alias("_range"), *[F.col(c).alias(f"_top_{c}") for c in carry])
    inside, order = prepare(dealt), W.partitionBy("_range").orderBy("_key")
    names = [c for c in inside.columns if c not in ("_key", "_range")]
    for c in carry:
        inside = inside.withColumn(f"_lag_{c}", F.lag(c).over(order))
    inside = inside.withColumn("_head", F.lag(F.lit(True)).over(order).isNull())
    ends = inside.join(top.hint("merge"), "_range", "left")
    return ends.select(*names, *[F.when(F.col("_head"), F.col(f"_top_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"next_{c}") for c in carry])


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the start of the next
    document, and their likeness."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    docs = docs.select("doc_id", "n_chars", "edited", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"))
    docs = with_fingerprint(docs, "edited", "edited_fingerprint")
    return docs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
