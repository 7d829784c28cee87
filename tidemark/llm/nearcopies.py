"""Near copies by likeness: texts whose sets of five-word shingles are alike by 0.8 or more, connected.

Three steps give links, all of them verified on the sets themselves:

1. SimHash (``simhash``): fingerprints of the five-word shingles, linked by deletion variants; texts of one
   fingerprint are linked to one of them. That connects what is all but equal.
2. Texts that share a shingle of their prefixes and lie side by side in order of size. Of two sets of
   this likeness the first 20 % in an order that all share have a shingle in common, whatever the edits
   are; the order is rare ones first, so common passages and lines hardly bring texts together. Each text is compared
   with the ``PARTNERS`` smaller ones that it lies beside most often, enough to connect a group and linear in it.
3. What the first two have connected is one root. All texts of different roots that share a
   shingle of their prefixes meet. So every link between two components is looked at: the result is exact. Parities of
   the sets go with them where they meet, and rule out most pairs there (no near one).

At a likeness of 0.8 fingerprints of 64 bits differ in about 10, which deletion variants alone cannot find;
that is what steps 2 and 3 are for.

A shingle that many texts share is dealt over tasks: by range in step 2. In step 3 shingles all of whose
texts are of one root are dropped by an aggregation; of one with more than ``RUN`` texts those of its
largest root and the others are cut into parts of about ``RUN``, and each part of one kind meets each of the
others in a task of its own.

Equal texts are one node, named by a 64-bit hash; where two different texts have one name (told by a
second hash), both stay out of the comparison and stay in the result.

Defined results: null, empty and blank texts are equal; a text of fewer than five words is one shingle; of a
group the row with the smallest doc_id stays, one with a null doc_id only if all have none; rows of one
doc_id with different texts are different documents; of repeated rows one stays; an empty table gives no rows. All
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import simhash
from .components import components
from .scratch import drop_written, written
from .substrings import shingles_of
from .tokens import some_at_a_time

LIKENESS = 0.8
SAMPLE = 20_000
COMMON = 4
LISTED = 1 << 18
RUN = 1 << 16
BLOCK = 1 << 18
BITS = 1 << 26
PARTNERS = 3
#: Places of the parities that go with a text wherever it meets others.
MARK = 512
PAIRS = "a long, b long"


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's five-word shingles, repeats included; a text of fewer words is one shingle."""
    return next(hashes_of([text]))


def hashes_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """``shingle_hashes`` of each text."""
    for s, e in some_at_a_time(texts):
        for text, found in zip(texts[s:e], shingles_of(texts[s:e])):
            if not len(found):
                words = (text or "").encode().split()
                found = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
            yield found


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that a sample of the texts has ``COMMON`` times or more, rarer ones first. The
    sample sets the order of shingles only: any order gives the same pairs."""
    every = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.unique(x) for x in hashes_of(batch.column(0).to_pylist())] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["x"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text").mapInArrow(run, "x long")
    often = some.groupBy("x").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "x").limit(LISTED)
    return np.array([r.x for r in reversed(often.collect())], np.int64).view(np.uint64)


def prefix(x: np.ndarray, sorted_common: np.ndarray, places: np.ndarray, likeness: float = LIKENESS) -> np.ndarray:
    """Of a set of shingles those that come first in an order that all texts share, rare ones before common
    ones: so many that two sets of this likeness have one of them in common."""
    rank = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    if len(sorted_common):
        at = np.minimum(np.searchsorted(sorted_common, x), len(sorted_common) - 1)
        rank = np.where(sorted_common[at] == x, np.uint64(1 << 63) + places[at].astype(np.uint64), rank)
    length = len(x) - int(np.ceil(likeness * len(x) - 1e-9)) + 1
    # Two shingles of equal rank keep the order of their hashes.
    return x[np.argsort(rank, kind="stable")[:length]].view(np.int64)


def parities(x: np.ndarray) -> bytes:
    """Bits, a power of two of them and one a shingle or more: whether an odd number of shingles falls on each."""
    size = 1 << max(6, int(len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def mark(x: np.ndarray) -> bytes:
    """Parities of a set on ``MARK`` places, whatever its size."""
    return np.packbits(np.bincount((x & np.uint64(MARK - 1)).astype(np.int64), minlength=MARK).astype(np.uint8) & 1).tobytes()


def odd_places(x: bytes, y: bytes) -> int:
    """On how many places the parities of two sets differ, the larger folded to the smaller: each has a shingle at least that
    only one of the sets has."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    small = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, small), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def sketches(texts: DataFrame) -> DataFrame:
    """node, fp (SimHash of the shingles), n (size of their set), xs (its prefix), odd (its parities), mark (those on ``MARK`` places) of
    every text. Blank texts have one shingle, the same for all."""
    common = common_shingles(texts)
    order = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[order], order))  # ``LISTED`` numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hashes in hashes_of(batch.column(1).to_pylist()):
                x = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
                out.append((simhash.majority(hashes), len(x), prefix(x, *shared.value), parities(x), mark(x)))
            fps, sizes, xs, odd, marks = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(xs, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.array(marks, pa.binary())], ["node", "fp", "n", "xs", "odd", "mark"])

    # Texts are sketched where they are; of equal ones the sketches are, and one is kept.
    found = texts.select("node", "text").mapInArrow(run, "node long, fp long, n int, xs array<bigint>, odd binary, mark binary")
    return written(found.dropDuplicates(["node"]), "sketches")


def by_fingerprint(found: DataFrame) -> DataFrame:
    """a, b: texts of one fingerprint and the least of them, and the least ones of fingerprints that SimHash links."""
    first = written(found.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    same = found.join(first.where("n > 1").hint("merge"), "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first.select("fp"))
    a, b = (first.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")).hint("merge") for c in "ab")
    return same.unionByName(near.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def within_reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the rows (key, n, node, at) x and y that share a shingle can be near: what is left of both after it has to be enough."""
    nx, ny = x[:, 1], y[:, 1]
    both = np.minimum(nx - x[:, 3], ny - y[:, 3])
    return (np.minimum(nx, ny) >= LIKENESS * np.maximum(nx, ny) - 1e-9) & (both >= LIKENESS / (1 + LIKENESS) * (nx + ny) - 1e-6) & (x[:, 2] != y[:, 2])


def may_be_near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of nodes of rows x and y of which ``within_reach`` holds."""
    ok = within_reach(x, y)
    return np.stack([x[ok, 2], y[ok, 2]], 1)


def side_by_side(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b of texts next to each other under a shingle of their prefixes, in order of size; node, key, n, at of
    the shingles that several texts may share)."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = found.select(F.explode(F.arrays_zip("xs", F.sequence(F.lit(0), F.size("xs") - 1).alias("i"))).alias("x"), "n", "node").select(F.col("x.xs").alias("key"), "n", "node", F.col("x.i").alias("at"))
    names = ["kind", "a", "b", "key", "n", "at"]

    def told(kind: int, a, b=None, key=None, n=None, at=None) -> pa.RecordBatch:
        size = len(a)
        full = [pa.array(np.full(size, kind, np.int32)), *[pa.array(c, pa.int64()) if c is not None else pa.nulls(size, pa.int64()) for c in (a, b, key, n, at)]]
        return pa.RecordBatch.from_arrays(full, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = before = None
        held, edge, count = np.zeros((0, 4), np.int64), True, 0  # rows of the last run that are not told yet; whether it touches an edge
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if before is None:
                yield told(2, rows[:1, 2], [TaskContext.get().partitionId()], rows[:1, 0], rows[:1, 1], rows[:1, 3])
            new, old = rows, 0
            if before is not None:
                rows, old = np.concatenate([first[None], before[None], rows]), 2
            heads = np.maximum.accumulate(np.where(np.append(True, rows[1:, 0] != rows[:-1, 0]), np.arange(len(rows)), 0))
            here = np.arange(old, len(rows))
            here = here[heads[here] < here]
            pair = may_be_near(rows[np.concatenate([heads[here], here - 1])], rows[np.concatenate([here, here])])
            pair, often = np.unique(pair, axis=0, return_counts=True)
            yield told(0, pair[:, 0], pair[:, 1], None, often)
            first, before = rows[heads[-1]], rows[-1]
            # Runs of more than one row, or at an edge, go to the next step.
            all_ = np.concatenate([held, new])
            starts = np.flatnonzero(np.append(True, all_[1:, 0] != all_[:-1, 0]))
            ends = np.append(starts[1:], len(all_))
            sizes = ends - starts
            sizes[0] += count
            busy = sizes > 1
            busy[0] |= edge
            whole = np.repeat(busy, ends - starts)
            if len(starts) > 1:
                count, edge = 0, False
            last = starts[-1]
            if busy[-1]:  # rows of a long run need not be held
                count, last = int(sizes[-1]), len(all_)
            out = all_[:last][whole[:last]]
            yield told(1, out[:, 2], None, out[:, 0], out[:, 1], out[:, 3])
            held = all_[last:]
        if before is not None:
            yield told(1, held[:, 2], None, held[:, 0], held[:, 1], held[:, 3])
            yield told(3, before[None][:, 2], [TaskContext.get().partitionId()], before[None][:, 0], before[None][:, 1], before[None][:, 3])

    got = written(rows.repartitionByRange(parts, "key", "n", "node").sortWithinPartitions("key", "n", "node").mapInArrow(run, "kind int, a long, b long, key long, n long, at long"), "side-by-side")
    # The last row of a part and the first of the next one: two rows a part.
    edges = sorted((r.b, r.kind, r.key, r.n, r.a, r.at) for r in got.where("kind > 1").collect())
    joints = [may_be_near(np.array([x[2:]]), np.array([y[2:]])) for x, y in zip(edges, edges[1:]) if x[1] == 3 and x[2] == y[2]]
    joints = spark.createDataFrame([tuple(map(int, p)) for j in joints for p in j], PAIRS)
    pairs = got.where("kind = 0").select("a", "b", "n").unionByName(joints.withColumn("n", F.lit(1).cast("long"))).groupBy("a", "b").agg(F.sum("n").alias("_n"))
    # b is the larger of two texts, so these links lead from each text of a group to smaller ones. The next step sees all others.
    most = W.partitionBy("b").orderBy(F.desc("_n"), "a")
    return pairs.withColumn("_rank", F.row_number().over(most)).where(F.col("_rank") <= PARTNERS).select("a", "b"), got.where("kind = 1").select(F.col("a").alias("node"), "key", "n", "at")


def across(busy: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: texts (node, key, n, at, root) of different roots that share a shingle and can be near, also by their marks in
    ``found``: all of them."""
    parts = int(busy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = busy.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("_rows")).where("_lo != _hi")
    several = written(several.select("key", "_rows"), "several-roots")
    rows = busy.join(several.hint("merge"), "key").join(found.select("node", "mark").hint("merge"), "node")
    names = ["cell", "n", "node", "at", "root", "side", "mark"]
    dealt = rows.where(F.col("_rows") <= RUN).select(F.col("key").alias("cell"), "n", "node", "at", "root", F.lit(2).alias("side"), "mark")
    long_ = several.where(F.col("_rows") > RUN)
    if not long_.isEmpty():
        hot = written(rows.where(F.col("_rows") > RUN), "long-runs")
        largest = hot.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("_top"))
        hot = hot.join(largest, "key").withColumn("_own", F.col("root") == F.col("_top.root"))
        own, others = (F.greatest(F.lit(1), F.ceil(c / RUN)).cast("int") for c in (F.col("_top.count"), F.col("_rows") - F.col("_top.count")))
        hot = hot.select("key", "n", "node", "at", "root", "mark", "_own", own.alias("_c"), others.alias("_d")).withColumn("_i", F.pmod(F.xxhash64("node"), F.when(F.col("_own"), F.col("_c")).otherwise(F.col("_d"))).cast("int"))
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("_j")
        keep = ["key", "n", "node", "at", "root", "mark", "_i"]
        cell = lambda kind, u, v: F.xxhash64(F.lit(kind), "key", u, v).alias("cell")
        rest = ["n", "node", "at", "root"]
        big = hot.where("_own").select(*keep, each("_d")).select(cell("own", "_i", "_j"), *rest, F.lit(0).alias("side"), "mark")
        small = hot.where("not _own").select(*keep, each("_c")).select(cell("own", "_j", "_i"), *rest, F.lit(1).alias("side"), "mark")
        among = hot.where("not _own").select(*keep, each("_d")).select(cell("others", F.least("_i", "_j"), F.greatest("_i", "_j")), *rest, F.expr("case when _i = _j then 2 when _i < _j then 0 else 1 end").alias("side"), "mark")
        dealt = dealt.unionByName(big).unionByName(small).unionByName(among)

    def crossed(run: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All pairs of a cell (in order of size) that are of different roots, and of different sides if it has two."""
        run, marks = run[:, :6], run[:, 6:]
        if run[:, 4].min() == run[:, 4].max():
            return
        # A row meets those before it from this size on.
        low = np.searchsorted(run[:, 1], np.ceil(LIKENESS * run[:, 1] - 1e-9))
        counts = np.arange(len(run)) - low
        at = 0
        while at < len(run):
            end = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), BLOCK, side="right")) + at)
            y = np.repeat(np.arange(at, end), counts[at:end])
            x = np.arange(len(y)) - np.repeat(np.cumsum(counts[at:end]) - counts[at:end], counts[at:end]) + low[y]
            use = (run[x, 4] != run[y, 4]) & ((run[x, 5] != run[y, 5]) | (run[x, 5] == 2))
            if use.any():
                x, y = x[use], y[use]
                near = within_reach(run[x], run[y])
                x, y = x[near], y[near]
                apart = np.bitwise_count((marks[x] ^ marks[y]).view(np.uint64)).sum(1, dtype=np.int64)
                near = apart <= (1 - LIKENESS) / (1 + LIKENESS) * (run[x, 1] + run[y, 1]) + 1e-6
                pair = run[np.stack([x[near], y[near]], 1), 2]
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not len(batch):
                continue
            marks = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int64).reshape(len(batch), -1)
            rows = np.column_stack([*[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:6]], marks])
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            if held and held[0][0, 0] != rows[0, 0]:
                yield from crossed(np.concatenate(held))
                held = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield from crossed(np.concatenate([*held, rows[s:e]]) if held else rows[s:e])
                held = []
            held.append(rows[starts[-1] :])
        if held:
            yield from crossed(np.concatenate(held))

    return dealt.select(*names).repartition(parts, "cell").sortWithinPartitions("cell", "n", "node").mapInArrow(run, PAIRS).distinct()


def may_be_among(nodes: DataFrame) -> Callable[[str], Column]:
    """A filter that all of these different nodes pass, and of others one in 16 or fewer up to ``BITS`` / 16 nodes: a bit for
    each by its last bits (nodes are hashes). ``BITS`` bits at most are sent, whatever the number of nodes."""
    bits = min(BITS, 1 << max(10, int(16 * nodes.count()).bit_length()))
    place = F.col("node").bitwiseAND(bits - 1)
    words = nodes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("set")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    known = nodes.sparkSession.sparkContext.broadcast(table)

    def told(node: pa.Array) -> pa.Array:
        at = node.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
        return pa.array((known.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0)

    return F.arrow_udf(told, "boolean")


def not_ruled_out(candidates: DataFrame, found: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Pairs a, b without those whose parities differ on more places than sets of this likeness have shingles apart. Parities
    have a bit where a set has 64, so few sets need travel after that; no pair that is near goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[2:]])
            keep = [odd_places(x, y) <= (1 - likeness) / (1 + likeness) * (n + m) + 1e-6 for n, m, x, y in rows]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (found.select(F.col("node").alias(c), F.col("n").alias(f"_n{c}"), F.col("odd").alias(f"_odd{c}")).hint("merge") for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_na", "_nb", "_odda", "_oddb").mapInArrow(run, PAIRS)


def verified(candidates: DataFrame, texts: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Of the pairs a, b of nodes those whose five-word shingles are alike by ``likeness`` or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(x).tobytes() for x in hashes_of(batch.column(1).to_pylist())], pa.binary())], ["node", "x"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= likeness * max(len(x), len(y)) else 0
                keep.append(both >= likeness * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    candidates = written(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    wanted = written(candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    # Few texts are wanted, so the others are left where they are. Equal ones meet by the join and are one after it.
    some = texts.select("node", "text").where(may_be_among(wanted)("node"))
    known = written(some.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(sets, "node long, x binary"), "shingle-sets")
    both = candidates.join(known.withColumnsRenamed({"node": "a", "x": "_x"}), "a").join(known.withColumnsRenamed({"node": "b", "x": "_y"}), "b")
    out = written(both.select("a", "b", "_x", "_y").mapInArrow(near, PAIRS), "near")
    drop_written(candidates, wanted, known)
    return out


def copy_links(texts: DataFrame) -> DataFrame:
    """a, b: links enough to connect all nodes of ``texts`` (node, text) that are alike by ``LIKENESS`` or more."""
    found = sketches(texts)
    pairs, busy = side_by_side(found)
    near = verified(not_ruled_out(by_fingerprint(found).unionByName(pairs), found), texts)
    roots = components(near).withColumnsRenamed({"node": "_node", "root": "_root"})
    rooted = written(busy.join(roots.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "key", "n", "at", F.coalesce("_root", "node").alias("root")), "rooted")
    more = verified(not_ruled_out(across(rooted, found), found), texts)
    drop_written(found, rooted)
    return near.unionByName(more)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: the one with the smallest doc_id.

    Tables of hashes grow with the documents, so they are joined by sorting at every size. Whole texts are shuffled
    to make the sets of candidates and to keep those that stay.
    """
    plain = F.when(F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "", "").otherwise(F.coalesce("text", F.lit("")))
    names = [F.xxhash64(F.lit(seed), plain) for seed in (1, 2)]
    marked = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", names[0].alias("node"), names[1].alias("_check"))
    different = written(marked.groupBy("node", "_check").agg(F.min("doc_id").alias("least")), "different-texts")
    # Of texts that share a name none is compared.
    alone = different.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("node")
    links = copy_links(marked.select("node", "text"))
    roots = components(links).withColumnsRenamed({"node": "_node", "root": "_root"})
    rooted = different.join(alone.withColumn("_alone", F.lit(True)).hint("merge"), "node", "left").join(roots.hint("merge"), F.col("node") == F.col("_node"), "left")
    group = F.when(F.col("_alone"), F.struct(F.coalesce("_root", "node").alias("g"), F.lit(0).cast("long").alias("h"))).otherwise(F.struct(F.col("node").alias("g"), F.col("_check").alias("h")))
    stay = rooted.groupBy(group.alias("_group")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node", "_check")).alias("_first"))
    stay = written(stay.select(F.col("_first.node").alias("_k"), F.col("_first._check").alias("_c"), F.col("_first.least").alias("_least")), "staying")
    drop_written(different)
    # Joined by the text alone (the least doc_id is no key of the join), so that repeated rows lie together and whole texts travel once.
    on = (F.col("node") == F.col("_k")) & (F.col("_check") == F.col("_c"))
    kept = marked.join(stay.hint("merge"), on).where(F.when(F.col("_least").isNull(), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("_least"))).dropDuplicates(["node", "_check"])
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
