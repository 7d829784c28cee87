"""Token ids in canonical length-limited Huffman codes, in independent blocks.

The code is made once from the counts of all ids. A file is a Parquet table whose rows are blocks of
whole documents in ascending doc_id; each document starts at a byte. Of every ``STEP`` ids a block
keeps the bits they take, so a reader can start at any of these checkpoints. The decoder looks up
``MAX_BITS`` bits at a time in a table, in step for all checkpoints of some blocks.

Ids are counted, coded and decoded where the rows are. The driver sees the counts, one row an id of
the vocabulary, and the lengths of the codes made of them.

Defined results: a null text is an empty one, so only the end id is written; a null doc_id sorts
first; repeated rows are written each; an empty table gives an empty file. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import tokens
from .scratch import drop_written, written

MAX_BITS = 18
STEP = 64
BLOCK_IDS = 1 << 17
IDS = "doc_id long, ids binary"
BLOCKS = "part int, block int, first_id long, n_ids long, doc_ids array<bigint>, doc_lengths binary, step_bits binary, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol, 0 where the count is 0: the package-merge method."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    used = used[np.lexsort((used, counts[used]))]
    leaves = counts[used].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([leaves, merged[0:even:2] + merged[1:even:2]])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < len(leaves))
    take = 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        code <<= length - before
        before = length
        has = np.flatnonzero(lengths == length)
        codes[has] = code + np.arange(len(has), dtype=np.uint64)
        code += len(has)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For every ``MAX_BITS`` bits: the symbol of the code they begin with, times 32, plus its length."""
    table = np.zeros(1 << MAX_BITS, np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    entry = (used.astype(np.uint32) << 5) | lengths[used]
    filled = np.repeat(entry, np.left_shift(1, MAX_BITS - lengths[used].astype(np.int64)))
    table[: len(filled)] = filled
    return table


def encode(ids: np.ndarray, doc_lengths: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Payload of the documents whose ids lie end to end, the bytes each takes, and the bits of
    every ``STEP`` ids of each. No document may be empty."""
    n = lengths[ids].astype(np.int64)
    first = np.cumsum(doc_lengths) - doc_lengths
    doc_bytes = (np.add.reduceat(n, first) + 7) // 8
    shift = (np.cumsum(doc_bytes) - doc_bytes) * 8
    before = np.cumsum(n) - n
    at = before + np.repeat(shift - before[first], doc_lengths)
    wide = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    word = at >> 5
    words = np.zeros(int(doc_bytes.sum()) // 4 + 3, np.uint64)
    runs = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[runs]] = np.add.reduceat(wide >> np.uint64(32), runs)
    words[word[runs] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
    place = np.arange(len(ids)) - np.repeat(first, doc_lengths)
    steps = np.add.reduceat(n, np.flatnonzero(place % STEP == 0)).astype("<u2")
    return words.astype(">u4").tobytes()[: int(doc_bytes.sum())], doc_bytes, steps


def decode(payload: bytes, doc_lengths: np.ndarray, steps: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of the documents, end to end."""
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    seen = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    lanes = -(-doc_lengths // STEP)
    head = np.cumsum(lanes) - lanes
    bits = steps.astype(np.int64)
    doc_bytes = (np.add.reduceat(bits, head) + 7) // 8
    before = np.cumsum(bits) - bits
    at = before + np.repeat((np.cumsum(doc_bytes) - doc_bytes) * 8 - before[head], lanes)
    place = np.arange(len(bits)) - np.repeat(head, lanes)
    n = np.minimum(STEP, np.repeat(doc_lengths, lanes) - place * STEP)
    to = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    at, to, n = at[order], to[order], n[order]
    ids = np.empty(int(doc_lengths.sum()), np.uint32)
    for i in range(STEP):
        live = int(np.searchsorted(-n, -i))
        if not live:
            break
        at, to = at[:live], to[:live]
        entry = table[(seen[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)]
        ids[to + i] = entry >> 5
        at = at + (entry & 31)
    return ids


def id_type(tokenizer: str, end: int) -> str:
    """numpy's name of the narrowest type that holds all ids: 16 bits, or 32 for a larger vocabulary."""
    return "<u2" if max(tokens.vocabulary_size(tokenizer), end + 1) <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, ids (little-endian, of ``id_type``) with the end id."""
    kind = id_type(tokenizer, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            ids = encoder.each(texts)
            for a, b in tokens.some_at_a_time(texts):
                found = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)).astype(kind).tobytes() for x in islice(ids, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], ["doc_id", "ids"])
        encoder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, IDS)


def count_ids(ids: DataFrame, kind: str = "<u2") -> np.ndarray:
    """How often each id occurs; the driver gets one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            values = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            if len(values):
                some = np.bincount(np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
                total = np.pad(total, (0, max(0, len(some) - len(total))))
                total[: len(some)] += some
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([1, *(row["id"] + 1 for row in rows)]), np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_blocks(ids: DataFrame, lengths: np.ndarray, kind: str = "<u2", name: str = "huffman") -> DataFrame:
    """Write the blocks in ascending doc_id; ``part`` numbers the ranges of doc_id in that order."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)).astype(np.int64) if parts > 1 else np.array([], np.int64)
    codes = canonical_codes(lengths)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            part = np.where(keys.is_null(), 0, np.searchsorted(bounds, keys.fill_null(0).to_numpy(zero_copy_only=False), side="left"))
            values = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(1)]
            for a in range(0, len(values), 256):
                some = values[a : a + 256]
                sizes = np.array([len(x) for x in some])
                payload, doc_bytes, steps = encode(np.concatenate(some), sizes, lengths, codes)
                b, s = np.append(0, np.cumsum(doc_bytes)), np.append(0, np.cumsum(-(-sizes // STEP)))
                rows = range(len(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[a : a + 256], pa.int32()), keys.slice(a, len(some)), pa.array(sizes, pa.int64()), pa.array([steps[s[i] : s[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([payload[b[i] : b[i + 1]] for i in rows], pa.binary())],
                    ["part", "doc_id", "n", "steps", "payload"],
                )

    def block(part, no, first, rows):
        return {"part": part, "block": no, "first_id": first, "n_ids": sum(r[1] for r in rows), "doc_ids": [r[0] for r in rows], "doc_lengths": np.array([r[1] for r in rows], "<u4").tobytes(), "step_bits": b"".join(r[2] for r in rows), "payload": b"".join(r[3] for r in rows)}

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.binary()), ("step_bits", pa.binary()), ("payload", pa.binary())])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, first, size, rows = None, 0, 0, 0, []
        for batch in batches:
            for p, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and (p != part or size >= BLOCK_IDS):
                    yield pa.RecordBatch.from_pylist([block(part, no, first, rows)], schema)
                    no, first, size, rows = no + 1, first + size, 0, []
                if p != part:
                    part, no, first = p, 0, 0
                rows.append(row)
                size += row[1]
        if rows:
            yield pa.RecordBatch.from_pylist([block(part, no, first, rows)], schema)

    dealt = ids.mapInArrow(coded, "part int, doc_id long, n long, steps binary, payload binary")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "payload")
    return written(dealt.mapInArrow(blocked, BLOCKS), name)


def read_blocks(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian, 32 bits each)."""
    table = decode_table(lengths)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_start", F.sum("_n").over(W.orderBy("part")) - F.col("_n")).select("part", "_start")
    placed = blocks.join(parts, "part").select(F.expr("_start + first_id").alias("start"), "doc_ids", "doc_lengths", "step_bits", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, sizes, steps, payload in zip(*[c.to_pylist() for c in batch.columns]):
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                data = decode(payload, sizes, np.frombuffer(steps, "<u2"), table).astype("<u4").tobytes()
                to = np.append(0, np.cumsum(sizes))
                found = [data[4 * to[i] : 4 * to[i + 1]] for i in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + to[:-1], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "start", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def store(docs: DataFrame, tokenizer: str, end: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Tokenize, code and write; the blocks and the code lengths that read them."""
    ids, kind = written(token_ids(docs, tokenizer, end), "ids"), id_type(tokenizer, end)
    lengths = code_lengths(count_ids(ids, kind))
    blocks = write_blocks(ids, lengths, kind)
    drop_written(ids)
    return blocks, lengths
