"""Harmonic packing of documents into sequences of a fixed number of tokens.

A piece of n tokens is of class k = capacity // n: k pieces of its class fill a sequence. Documents are
cut freely: whole sequences first, then powers of two down to ``LEAST``, which fill their sequences
to the last token, then a tail. Every worker fills the sequences of each class by itself, k pieces
each, holding at most one open sequence a class.

What stays open at the end of a worker's rows is small: fewer than k pieces a class. Groups of
``WORKERS`` workers lay these end to end, longest first, and cut at the capacity, so one sequence
for each group has padding of any size.

Defined results: a null text is an empty one, so its document is the end id alone; rows with a null
doc_id and repeated rows are documents of their own; an empty table gives no pieces. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import tokens
from .scratch import written

CAPACITY = 2048
LEAST = 64
WORKERS = 16
PIECES = "worker long, sequence long, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"
_SCHEMA = pa.schema([("worker", pa.int64()), ("sequence", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= least and n >= least:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each)."""
    end_id = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        full, ready = 0, []
        waiting: dict[int, list] = defaultdict(list)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            keys = batch.column(0).to_pylist()
            each = encoder.each(texts)
            for a, b in tokens.some_at_a_time(texts):
                for key, ids in zip(keys[a:b], each):
                    ids += end_id
                    start, total = 0, len(ids) // 4
                    for length in cuts(total, capacity):
                        kind = capacity // length
                        held = waiting[kind]
                        held.append([worker, None, key, start, length, total, 0, ids[4 * start : 4 * (start + length)]])
                        start += length
                        if len(held) == kind:
                            offset = 0
                            for piece in held:
                                piece[1], piece[6] = full, offset
                                offset += piece[4]
                            full += 1
                            ready += held
                            del waiting[kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready) if ready else [[]] * 8, _SCHEMA)], schema=_SCHEMA)
                ready = []
        encoder.forget()
        rest = [piece for held in waiting.values() for piece in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rest) if rest else [[]] * 8, _SCHEMA)], schema=_SCHEMA)

    pieces = written(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")
    out = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    # Numbers of the workers' sequences are even, those of the groups' odd.
    whole = pieces.where("sequence is not null").withColumn("sequence_id", F.expr("shiftleft(worker, 33) + 2 * sequence")).select(*out)

    group = W.partitionBy("_group").orderBy(F.desc("length"), "worker", "doc_id", "start").rowsBetween(W.unboundedPreceding, 0)
    rest = pieces.where("sequence is null").withColumn("_group", F.expr(f"worker div {WORKERS}")).withColumn("_at", F.sum("length").over(group) - F.col("length"))
    first = F.expr(f"least(length, {capacity} - _at % {capacity})")
    rest = rest.withColumn("_first", first).withColumn("_part", F.explode(F.expr("if(_first < length, array(0, 1), array(0))")))
    rest = rest.withColumn("_skip", F.expr("if(_part = 0, 0, _first)")).withColumn("_len", F.expr("if(_part = 0, _first, length - _first)"))
    rest = rest.select(
        "doc_id",
        (F.col("start") + F.col("_skip")).alias("start"),
        F.col("_len").alias("length"),
        "doc_tokens",
        F.expr(f"shiftleft(_group, 33) + 2 * ((_at + _skip) div {capacity}) + 1").alias("sequence_id"),
        F.expr(f"(_at + _skip) % {capacity}").alias("offset"),
        F.expr("substring(ids, cast(4 * _skip + 1 as int), cast(4 * _len as int))").alias("ids"),
    )
    return whole.unionByName(rest)
