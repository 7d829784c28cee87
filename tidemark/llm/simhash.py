"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of the
word shingles, repeats counted. Two fingerprints that differ in ``DISTANCE`` = 2 bits at most are linked.
Cut into two halves, one half differs by one bit at most. So each half is indexed 32 times, each time
without one of its bits; fingerprints that are linked share one such signature, and those that share
one are compared.

Documents of one fingerprint are one node. A signature's nodes lie together in a task, sorted, and
are compared there, ``RUN`` at most; of each connected set one link fewer than nodes is kept. A longer run
passes through unheld, and its nodes are linked by all 2,016 ways of leaving out two of the 64 bits:
equal in one of them means linked, no comparison needed, and no more than four nodes meet. Both ways
are exact.

Defined results: a null, empty or blank text has fingerprint 0 and is linked like any other; a text of
fewer words than a shingle is one shingle; null doc_ids belong to the component of their fingerprint and
never name one with others in it; repeated rows are one component; an empty table gives no rows.
Columns other than doc_id and text are ignored.

``nearcopies`` builds on this the pipeline's removal of near copies by likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import written

DISTANCE = 2
RUN = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z alone change, and ASCII white space alone parts words
    if not parts:
        return 0
    line, ends, at = b" ".join(parts), [], 0
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    of = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [of(line, 42)]
    else:
        starts = [0, *ends]
        hashes = [of(line[s : e - 1], 42) for s, e in zip(starts, ends[words - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Each bit as over half of the hashes have it, as a signed 64-bit integer; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, words) for x in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def run_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (unsigned, different) that are near each other."""
    root = np.arange(len(fps))
    out = []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= distance)
        for r, j in dict(zip(root[near][::-1].tolist(), near[::-1].tolist())).items():
            if r != root[i]:
                out.append((int(fps[j].view(np.int64)), int(fps[i].view(np.int64))))
                root[root == root[i]] = r
    return out


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links enough to connect all fingerprints (column fp, different) that are near each other."""
    spark = nodes.sparkSession
    masks = F.array(*[F.lit(np.uint64(~(1 << bit) & (0xFFFFFFFF if bit < 32 else 0xFFFFFFFF << 32) & (2**64 - 1)).astype(np.int64).item()) for bit in range(64)])
    signed = nodes.select("fp", F.posexplode(masks).alias("bit", "_mask")).select("bit", F.col("fp").bitwiseAND(F.col("_mask")).alias("rest"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64),) * 3
        long_run = None  # the signature whose nodes pass through

        def told(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def close(bit, rest, fp, last: bool):
            """Handle all ended runs; the rows of the one that may go on."""
            nonlocal long_run
            if not len(fp):
                return (bit, rest, fp), [], []
            heads = np.flatnonzero(np.append(True, (np.diff(bit) != 0) | (np.diff(rest) != 0)))
            ends = np.append(heads[1:], len(fp))
            a, b = [], []
            whole = len(heads) if last else len(heads) - 1
            many = np.flatnonzero(ends[:whole] - heads[:whole] > 1)
            if long_run is not None:
                if (bit[0], rest[0]) == long_run:
                    a += fp[: ends[0]].tolist()
                    many = many[many != 0]
                    if whole > 0:
                        long_run = None
                    else:
                        return (bit[:0], rest[:0], fp[:0]), a, [None] * len(a)
                else:
                    long_run = None
                b += [None] * len(a)
            for i in many:
                some = fp[heads[i] : ends[i]]
                if len(some) > RUN:
                    a += some.tolist()
                    b += [None] * len(some)
                else:
                    for x, y in run_links(some.view(np.uint64)):
                        a.append(x)
                        b.append(y)
            at = len(fp) if last else heads[-1]
            if not last and len(fp) - at > RUN:
                long_run = (bit[-1], rest[-1])
                a += fp[at:].tolist()
                b += [None] * (len(fp) - at)
                at = len(fp)
            return (bit[at:], rest[at:], fp[at:]), a, b

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held, a, b = close(*[np.concatenate([x, y]) for x, y in zip(held, new)], False)
            yield told(a, b)
        _, a, b = close(*held, True)
        yield told(a, b)

    found = written(signed.repartition(parts, "bit", "rest").sortWithinPartitions("bit", "rest", "fp").mapInArrow(run, "a long, b long"), "near")
    many = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    pairs = F.array(*[F.lit(np.uint64((2**64 - 1) & ~(1 << i) & ~(1 << j)).astype(np.int64).item()) for i in range(64) for j in range(i)])
    exact = many.select("fp", F.posexplode(pairs).alias("_pair", "_mask")).groupBy("_pair", F.col("fp").bitwiseAND(F.col("_mask")).alias("_rest"))
    exact = exact.agg(F.collect_list("fp").alias("_some")).where("size(_some) > 1").select(F.array_min("_some").alias("a"), F.explode("_some").alias("b")).where("a != b").distinct()
    return found.where("b is not null").unionByName(exact)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    prints = written(fingerprints(docs, words), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(names, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
