"""Near-duplicate passages by compact windows over min-hashes.

A text is its sequence of five-word shingles. For one hash function, the position c of the least hash in
a range is the same for every range [i, j] with l <= i <= c <= j <= r: one compact window (l, c, r), a node
of the Cartesian tree of the hashes. Only windows of ``LEAST`` = 46 shingles (50 words) or more matter.
Two passages share a signature under a function if their windows have the same least hash.

For each signature the windows lie together in order of (doc_id, c). With each go the least hashes of the other functions
in 35 shingles around c, placed in four ways (ten bits each): any exact passage holds one of these places, so there all
functions agree, and near ones agree in most. ``AGREE`` of ``FUNCTIONS`` = 4 functions have to agree, the window's own among them,
so of windows that share a phrase only most go where they meet and are not written.

Up to four windows of a signature meet all to all. Of more, each meets the first and the one before it of its neighbourhoods: of
those with equal least hashes of all functions in a place of 35, and with an equal least one of 22 on one side. That is linear
however many documents share a passage. Windows that agree in all of such a place are of one class, as are those that
hang together by such ones; the first of each class meets the first of every other class of the signature, so
different texts meet however many there are. That is quadratic in the classes, in memory a block at a time.

Signatures that a sample of the documents shows to be frequent are split over tasks by document. What stands first
and last in each neighbourhood of a split is handed on and tied in the same way, by neighbourhood, so the
neighbourhoods of a split signature hang together as those of any other. The sample decides on tasks only.

Ties of the same two documents are intervals; those that overlap are one. The passages that remain are fetched, a text once, and
verified: maximal stretches of the later document, of LEAST shingles or more, of which enough occur in the earlier one
for a likeness of 0.8.

Defined results: null and blank texts and texts of under 50 words have no passages; rows with a null
doc_id have none either; rows of one doc_id are one document, whose passages repeat only if they do
at LEAST shingles' distance; an empty table gives no rows. ``passages`` ignores columns other than doc_id and text,
``without`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import drop_written, written
from .tokens import some_at_a_time

WORDS = 5
LEAST = 46
FUNCTIONS = 4
AGREE = 3
LIKENESS = 0.8
SLACK = 64
AROUND = [f"near{i}" for i in range(6)]
#: Of these the first ones are of 35 shingles around a window's place: how many lie before it. The bit of those that stand for a class.
LEFT = (0, 11, 23, 34)
PLACEMENTS = len(LEFT)
REACH = 35
FIELD = 10
CLASS = len(AROUND) + 1
PAIRS = 1 << 18
RUN = 1 << 18
SAMPLE = 20_000
OFTEN = 16
SPLIT = 1 << 14
GRID = 64
SIDE = 22
BYTES = 1 << 20
ROUNDS = 48
ODD = np.uint64(0x9E3779B97F4A7C15)
MIXED = np.uint64(xxhash.xxh64_intdigest(b"mix", 7) | 1)
#: A random number for each byte, and which bytes part words.
_of_byte = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) for i in range(256)], np.uint64)
_white = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Shingles of the smallest passage that have to occur in the other.
ENOUGH = int(np.ceil(LEAST * 2 * LIKENESS / (1 + LIKENESS) - 1e-9))
#: One odd multiplier and one shift a function, from the hash of its number.
MIX = [xxhash.xxh64_intdigest(bytes([i]), 7) | 1 for i in range(FUNCTIONS)]


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word: a polynomial of random numbers that stand for its bytes."""
    return hashed((text or "").encode())[0]


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and at which byte it starts."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_white[data], [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, i = [], 0
    while i < len(starts):  # a block of bytes at a time, however long the text is
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BYTES, side="right")))
        lengths = ends[i:j] - starts[i:j]
        first = np.cumsum(lengths) - lengths
        place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        some = data[place + np.repeat(starts[i:j], lengths)]
        powers = np.cumprod(np.full(lengths.max(), ODD))
        out.append(np.add.reduceat(_of_byte[some] * powers[place], first))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64), starts


def shingles(text: str | None) -> np.ndarray:
    """Hash of each run of five words: a polynomial of the words' hashes, its bits mixed."""
    return of_words(word_hashes(text))


def shingles_of(texts: list[str | None]) -> list[np.ndarray]:
    """``shingles`` of each text, of many in one go."""
    out = []
    for s, e in some_at_a_time(texts, BYTES // 4):
        some = [(text or "").encode() for text in texts[s:e]]
        each, starts = hashed(b"\n".join(some))
        x, first = of_words(each), 0
        for end in np.searchsorted(starts, np.cumsum([len(t) + 1 for t in some])).tolist():
            out.append(x[first : max(first, end - WORDS + 1)])
            first = end
    return out


def of_words(each: np.ndarray) -> np.ndarray:
    """Hash of each run of five words of which these are the hashes."""
    n = len(each) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = (each ^ (each >> np.uint64(32))) * MIXED
    each ^= each >> np.uint64(29)
    x = each[:n]
    for i in range(1, WORDS):
        x = x * ODD + each[i : i + n]
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * MIXED
    return x ^ (x >> np.uint64(32))


def mixed(hashes: np.ndarray, function: int) -> np.ndarray:
    x = hashes * np.uint64(MIX[function])
    return (x ^ (x >> np.uint64(29))) * np.uint64(MIX[(function + 1) % FUNCTIONS])


def slide(x: np.ndarray, width: int, least_or_most: np.ufunc) -> np.ndarray:
    """Of each ``width`` places in a row the least or the greatest."""
    k = 1
    while 2 * k <= width:
        x = least_or_most(x[:-k], x[k:])
        k *= 2
    return least_or_most(x[: len(x) - width + k], x[width - k :]) if k < width else x


def leasts(hashes: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the least hash of each function (rows) in the ``REACH`` shingles that end at each place, and the least one of the ``SIDE``
    that do.

    ``hashes`` holds the documents end to end with a gap of ``REACH`` or more before, between and after them."""
    out = []
    for f in range(FUNCTIONS):
        x = mixed(hashes, f)
        x[gap] = 2**64 - 1
        out.append(((slide(np.pad(x, (REACH - 1, 0), constant_values=2**64 - 1), REACH, np.minimum) >> np.uint64(20)) & np.uint64((1 << FIELD) - 1)).astype(np.int32))
    side = slide(np.pad(x, (SIDE - 1, 0), constant_values=2**64 - 1), SIDE, np.minimum)
    return np.stack(out), (side >> np.uint64(32)).astype(np.uint32).view(np.int32)


def around(c: np.ndarray, function: int, of_all: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Six numbers (rows) for each of these places: the bits of the other functions in the 35 shingles around it, placed in four
    ways, and the least of 22 on each side."""
    others = of_all[[g for g in range(FUNCTIONS) if g != function]]
    out = []
    for left in LEFT:
        some = others[:, c - left + REACH - 1]
        out.append(sum(x << (FIELD * k) for k, x in enumerate(some)))
    return np.stack([*out, side[c - 1], side[c + SIDE]])


def agreeing(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """How many functions agree around windows of one signature, by their ``PLACEMENTS`` numbers: its own, and those with an
    equal least hash in one of the places."""
    apart = b ^ a
    bits = (1 << FIELD) - 1
    return 1 + sum(((apart & (bits << (FIELD * k))) == 0).any(1).astype(np.int64) for k in range(FUNCTIONS - 1))


def wide_windows(h: np.ndarray, gap: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows l, c, r of all compact windows of this width or more of sequences that lie end to end, a gap before and after each;
    of equal hashes the first is the least.

    A shingle has one if it is the least of any ``least`` in a row. The nodes above such a node of the tree are as wide, so
    the tree of these alone is made.
    """
    if len(h) < least:
        return np.zeros((0, 3), np.int64)
    h = np.where(gap, np.uint64(0), h)
    highest = slide(np.pad(slide(h, least, np.minimum), least - 1), least, np.maximum)
    edge = gap & ~(np.append(False, gap[:-1]) & np.append(gap[1:], False))
    at = np.flatnonzero((highest == h) & ~gap | edge)
    blank, values = gap[at], (h[at] ^ np.uint64(1 << 63)).view(np.int64)
    values[blank] = np.iinfo(np.int64).min
    # Each looks for the nearest lower one on both sides by the way of those it passes, all at once.
    here = np.arange(len(at))
    before, after = here - 1, here + 1
    for near in (before, after):
        left = np.flatnonzero(~blank)
        for _ in range(ROUNDS):
            left = left[(values[near[left]] >= values[left]) & ~blank[near[left]]]
            if not len(left):
                break
            near[left] = near[near[left]]
        else:  # many in ascending order; a stack takes one pass whatever the hashes are
            levels = [v - b for v, b in zip(values.tolist(), blank.tolist())]
            return np.array(_by_stack(levels, least, at.tolist()), np.int64).reshape(-1, 3)
    # An equal one before it bounds a window too.
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    before[order[1:][same]] = np.maximum(before[order[1:][same]], order[:-1][same])
    c = np.flatnonzero(~blank)
    found = np.stack([at[before[c]] + 1, at[c], at[after[c]] - 1], 1)
    return found[found[:, 2] - found[:, 0] + 1 >= least]


def compact_windows(h: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(l, c, r) of all compact windows of one sequence."""
    gap = np.zeros(len(h) + 2, bool)
    gap[[0, -1]] = True
    return [tuple(w) for w in (wide_windows(np.pad(h, 1), gap, least) - 1).tolist()]


def _by_stack(h: list[int] | np.ndarray, least: int, at: list[int] | None = None) -> list[tuple[int, int, int]]:
    """The same of values at these places, the last of them a gap; of all, if no places are given."""
    out, open_, below = [], [], []
    values = h if at is not None else [*h.tolist(), -1]
    for i, v in zip(at or range(len(values)), values):
        while open_ and below[-1] > v:
            below.pop()
            c = open_.pop()
            l = open_[-1] + 1 if open_ else 0
            if i - l >= least:
                out.append((l, c, i - 1))
        open_.append(i)
        below.append(v)
    return out


def all_windows(texts: list[tuple[int, str | None]]) -> np.ndarray:
    """key, doc_id, l, c, r and what is around c, of every compact window of these documents."""
    out = []
    for s, e in some_at_a_time([text for _, text in texts]):
        some = [(doc_id, text) for doc_id, text in texts[s:e] if doc_id is not None]
        some = [(doc_id, x) for (doc_id, _), x in zip(some, shingles_of([text for _, text in some])) if len(x) >= LEAST]
        if not some:
            continue
        lengths = np.array([len(x) for _, x in some])
        starts = np.cumsum(lengths + REACH) - lengths
        blank = np.zeros(REACH, np.uint64)
        hashes = np.concatenate([blank, *[y for _, x in some for y in (x, blank)]])
        gap = np.ones(len(hashes), bool)
        # A place in the gap before a document counts as the document's.
        doc = np.minimum(np.searchsorted(starts + lengths, np.arange(len(hashes)), side="right"), len(some) - 1)
        first, end = starts[doc], (starts + lengths)[doc]
        gap[(np.arange(len(hashes)) >= first) & (np.arange(len(hashes)) < end)] = False
        beside = leasts(hashes, gap)
        ids = np.array([doc_id for doc_id, _ in some], np.int64)
        for f in range(FUNCTIONS):
            h = mixed(hashes, f)
            found = wide_windows(h, gap)
            c = found[:, 1]
            keys = ((h[c] & np.uint64(2**64 - FUNCTIONS)) | np.uint64(f)).view(np.int64)
            out.append(np.column_stack([keys, ids[doc[c]], found - first[c][:, None], around(c, f, *beside).T]))
    return np.concatenate(out) if out else np.zeros((0, 5 + len(AROUND)), np.int64)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (sorted) that a sample of the documents has ``OFTEN`` times or more and that hold more than ``SPLIT`` windows
    of all documents if the sample is right, and into how many parts each is split."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(all_windows(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))[:, 0])], ["key"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(run, "key long")
    rows = some.groupBy("key").count().where(F.col("count") > max(OFTEN, SPLIT // every)).orderBy("key").collect()
    return np.array([r["key"] for r in rows], np.int64), np.array([-(-r["count"] * every // SPLIT) for r in rows], np.int64)


def windows(docs: DataFrame) -> DataFrame:
    """key (function and least hash), part (of a frequent key, from 1; 0 else), doc_id, l, c, r of every compact
    window, and what is around c."""
    names = ["key", "doc_id", "l", "c", "r", *AROUND, "part"]
    often, parts = frequent(docs)
    known = docs.sparkSession.sparkContext.broadcast((often, parts))  # a sample of ``SAMPLE`` documents bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, parts = known.value
        for batch in batches:
            for a in range(0, len(batch), 512):
                rows = all_windows(list(zip(batch.column(0)[a : a + 512].to_pylist(), batch.column(1)[a : a + 512].to_pylist())))
                part = np.zeros(len(rows), np.int32)
                if len(often) and len(rows):
                    at = np.minimum(np.searchsorted(often, rows[:, 0]), len(often) - 1)
                    mine = (rows[:, 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    part = np.where(often[at] == rows[:, 0], mine.astype(np.int64) % parts[at] + 1, 0).astype(np.int32)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), *[pa.array(c.astype(np.int32)) for c in rows[:, 2:].T], pa.array(part)], names)

    return docs.mapInArrow(run, "key long, doc_id long, l int, c int, r int, " + ", ".join(f"{x} int" for x in AROUND) + ", part int")


def run_starts(rows: np.ndarray) -> np.ndarray:
    """Where runs of one key and part begin."""
    return np.flatnonzero(np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, -1] != rows[:-1, -1]))[: len(rows)])


def neighbourhoods(rows: np.ndarray, head: np.ndarray, columns: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of these columns: places of the rows, those of one run (that starts at ``head``) and value together and in order,
    and which of them are the first of theirs."""
    for k in columns:
        order = np.lexsort((rows[:, k], head))
        yield order, np.append(True, (head[order[1:]] != head[order[:-1]]) | (rows[order[1:], k] != rows[order[:-1], k]))[: len(order)]


def tied(rows: np.ndarray, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the windows to tie, a before b and b from ``old`` on, and the first window of each class of the runs
    of more than four. Rows in order of key, part, doc_id and c."""
    here = np.arange(len(rows))
    heads = run_starts(rows)
    lengths = np.diff(np.append(heads, len(rows)))
    head, length = np.repeat(heads, lengths), np.repeat(lengths, lengths)
    out = [np.stack([o, here], 1)[(o >= head) & (o < here)] for o in (head, here - 1)]
    out.append(np.stack([here - 2, here], 1)[(here - 2 >= head) & (length <= 4)])
    many = here[length > 4]
    near = list(neighbourhoods(rows[many], head[many], range(5, rows.shape[1] - 1)))
    for order, new in near:
        order = many[order]
        firsts = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        out += [np.stack([firsts, order], 1)[~new], np.stack([order[:-1], order[1:]], 1)[~new[1:]]]
    code = np.concatenate(out)
    code = code[code[:, 1] >= old]
    code = np.unique(code[:, 1] * max(1, len(rows)) + code[:, 0])
    return np.stack([code % max(1, len(rows)), code // max(1, len(rows))], 1), many[first_copies(near[:PLACEMENTS])]


def first_copies(near: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Places of the rows that are the first of their class. Those of one neighbourhood are of one class."""
    least = np.arange(len(near[0][0]))
    sizes = [(order, starts, np.diff(np.append(starts, len(order)))) for order, new in near if len(starts := np.flatnonzero(new))]
    while sizes:
        before = least
        for order, starts, n in sizes:
            least = least.copy()
            least[order] = np.repeat(np.minimum.reduceat(least[order], starts), n)
        least = least[least]
        if np.array_equal(least, before):
            break
    return np.flatnonzero(least == np.arange(len(least)))


def all_pairs(run: np.ndarray, old: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of all pairs of one run, x before y and y from ``old`` on; ``run`` ascends. About ``PAIRS`` at a time."""
    place = np.arange(len(run)) - np.searchsorted(run, run)
    place[:old] = 0
    upto, i = np.cumsum(place), old
    while i < len(run):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
        n = place[i:j]
        y = np.repeat(np.arange(i, j), n)
        if len(y):
            yield np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n) + y - np.repeat(n, n), y
        i = j


def ends_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of one run that are the first or last of a neighbourhood or the first of a class, and of
    which: bit k + 1 for neighbourhood k, bit ``CLASS`` for the first of a class."""
    of = np.zeros(len(rows), np.int64)
    of[first_copies(list(neighbourhoods(rows, np.zeros(len(rows)), range(5, 5 + PLACEMENTS))))] |= 1 << CLASS
    for k, x in enumerate(rows[:, 5:-1].T):
        for ends in (np.unique(x, return_index=True)[1], len(x) - 1 - np.unique(x[::-1], return_index=True)[1]):
            of[ends] |= 2 << k
    at = np.flatnonzero(of)
    return at, of[at]


#: As they are written: x is of f and off.
TIES = ["b", "a", "x", "lo", "hi"]


def told(b: np.ndarray, a: np.ndarray, f: np.ndarray, agree: int, near: int = 5) -> np.ndarray:
    """Ties of windows (…, doc_id, l, c, r in columns 1 to 4) b and a around which ``agree`` functions do (what is around them is in
    columns ``near`` on) and that overlap enough."""
    if agree > 1:
        ok = agreeing(b[:, near : near + PLACEMENTS], a[:, near : near + PLACEMENTS]) >= agree
        b, a, f = b[ok], a[ok], f[ok]
    lo = b[:, 3] - np.minimum(b[:, 3] - b[:, 2], a[:, 3] - a[:, 2])
    hi = b[:, 3] + np.minimum(b[:, 4] - b[:, 3], a[:, 4] - a[:, 3])
    off = b[:, 3] - a[:, 3]
    ok = (hi - lo + 1 >= LEAST) & ((a[:, 1] != b[:, 1]) | (off >= LEAST))
    return np.stack([b[:, 1], a[:, 1], off * FUNCTIONS + f, lo, hi], 1)[ok]


def ties(found: DataFrame, agree: int = 1) -> DataFrame:
    """b, a, f, off, lo, hi: the later and the earlier document, the function, by how much b's place is
    further on, and where in b both windows reach; of windows around which ``agree`` functions do."""
    spark = found.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    handed = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray, old: int, closed: bool) -> Iterator[pa.RecordBatch]:
            """Ties of the rows from ``old`` on (those before have had theirs), and the ends of split runs that are over."""
            got, firsts = tied(rows, old)
            starts, some = run_starts(rows), rows[firsts, : 5 + PLACEMENTS]
            for x, y in all_pairs(np.searchsorted(starts, firsts, side="right"), int(np.searchsorted(firsts, old))):
                x = told(some[y], some[x], some[y, 0] & (FUNCTIONS - 1), agree)
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in x.T], pa.nulls(len(x), handed)], [*TIES, "ends"])
            x = told(rows[got[:, 1]], rows[got[:, 0]], rows[got[:, 1], 0] & (FUNCTIONS - 1), agree)
            ends = []
            if closed and (rows[:, -1] > 0).any():
                for s, e in zip(starts, np.append(starts[1:], len(rows))):
                    if rows[s, -1]:
                        at, of = ends_of(rows[s:e])
                        ends += np.column_stack([rows[s:e][at, :-1], of]).tolist()
            nothing = pa.nulls(len(ends), pa.int64())
            columns = [pa.concat_arrays([pa.array(c, pa.int64()), nothing]) for c in x.T]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(x), handed), pa.array(ends, handed)])], [*TIES, "ends"])

        held, size, old = [], 0, 0  # the rows of the run that may go on
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], 1)
            same = lambda x: x[0] == rows[0, 0] and x[-1] == rows[0, -1]  # noqa: B023, E731
            if same(rows[-1]) and (not held or same(held[0][0])):
                held.append(rows)
                size += len(rows)
                if size - old > RUN:  # what later windows can be tied to stays: the last and first of each neighbourhood
                    rows = np.concatenate(held)
                    yield from out(rows, old, False)
                    held = [rows[ends_of(rows)[0]]]
                    size = old = len(held[0])
                continue
            rows = np.concatenate([*held, rows])
            last = int(run_starts(rows)[-1])
            yield from out(rows[:last], old, True)
            held, size, old = [rows[last:]], len(rows) - last, 0
        if held:
            yield from out(np.concatenate(held), old, True)

    kinds = ", ".join(f"{c} long" for c in TIES)
    dealt = found.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "doc_id", "c")
    got = written(dealt.mapInArrow(run, f"{kinds}, ends array<bigint>"), "ties")

    # The ends of a frequent signature's parts: a run for each of its neighbourhoods and one for its classes.
    row = lambda i: F.col("ends")[i]
    each = F.explode(F.filter(F.sequence(F.lit(1), F.lit(CLASS)), lambda k: F.call_function("shiftright", F.col("ends")[5 + len(AROUND)], k) % 2 != 0)).alias("k")
    ends = got.where("ends is not null").select("ends", each)
    ends = ends.select(F.xxhash64(row(0), "k", F.when(F.col("k").between(1, len(AROUND)), F.get("ends", F.col("k") + 4))).alias("run"), *[row(i).alias(n) for i, n in ((1, "doc_id"), (2, "l"), (3, "c"), (4, "r"))], row(0).bitwiseAND(FUNCTIONS - 1).alias("f"), *[row(5 + i).alias(AROUND[i]) for i in range(PLACEMENTS)], (F.col("k") == CLASS).alias("classes"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each with the first of its run and the one before it; of classes the first ones of all, as in one part."""
        first = before = None
        held: list[np.ndarray] = []  # the run of classes that may go on: a row for each class and part

        def classes() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            x = rows[first_copies(list(neighbourhoods(rows, np.zeros(len(rows)), range(6, 6 + PLACEMENTS))))]
            for a, b in all_pairs(np.zeros(len(x), np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in told(x[b], x[a], x[b, 5], agree, 6).T], TIES)

        for batch in batches:
            alike, batch = batch.column(10), batch.select(range(10))
            some = batch.filter(alike)
            if len(some):
                rows = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in some.columns], 1)
                for run in np.split(rows, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1):
                    if held and held[0][0, 0] != run[0, 0]:
                        yield from classes()
                        held = []
                    held.append(run)
            batch = batch.filter(pc.invert(alike))
            if not len(batch):
                continue
            rows, old = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], 1), 0
            if before is not None:
                rows, old = np.concatenate([first[None], before[None], rows]), 2
            heads = np.maximum.accumulate(np.where(np.append(True, rows[1:, 0] != rows[:-1, 0]), np.arange(len(rows)), 0))
            here = np.arange(old, len(rows))
            here = here[heads[here] < here]
            x, y = np.concatenate([heads[here], here - 1]), np.concatenate([here, here])
            out = told(rows[y], rows[x], rows[y, 5], agree, 6)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.T], TIES)
            first, before = rows[heads[-1]], rows[-1]
        if held:
            yield from classes()

    more = ends.repartition(parts, "run").sortWithinPartitions("run", "doc_id", "c").mapInArrow(joined, kinds)
    out = got.where("ends is null").select(*TIES).unionByName(more)
    out = out.select("b", "a", F.col("x").bitwiseAND(FUNCTIONS - 1).alias("f"), F.shiftright("x", FUNCTIONS.bit_length() - 1).alias("off"), "lo", "hi")
    out._written = got._written
    return out


def candidates(tied: DataFrame) -> DataFrame:
    """b, a, lo, hi, a_lo, a_hi: stretches of two documents that are tied; those of the same
    two that overlap are one. Ends are on a grid of ``GRID`` shingles, so that the same ones recur."""
    line = W.partitionBy("b", "a").orderBy("lo", "hi", "off")
    tied = tied.withColumn("_upto", F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))).withColumn("_group", F.sum(F.when(F.col("lo") > F.col("_upto"), 1).otherwise(0)).over(line))
    one = tied.groupBy("b", "a", "_group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("lo") - F.col("off")).alias("a_lo"), F.max(F.col("hi") - F.col("off")).alias("a_hi"))
    down = lambda c: (F.floor(F.greatest(F.lit(0), F.col(c)) / GRID) * GRID).alias(c)
    up = lambda c: (F.floor(F.col(c) / GRID) * GRID + GRID - 1).alias(c)
    return one.select("b", "a", down("lo"), up("hi"), down("a_lo"), up("a_hi")).distinct()


def stretches(hit: np.ndarray, least: int = LEAST, share: float = 2 * LIKENESS / (1 + LIKENESS)) -> list[tuple[int, int]]:
    """Runs [s, e) of positions, ``least`` long or more, of which ``share`` are hit; from left to right,
    each as long as it can be, with hits at both ends."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    # What a run of positions has above its share is a difference of two of these sums.
    above = np.concatenate([[0.0], np.cumsum(hit - share)]) + 1e-9 * np.arange(len(hit) + 1)
    best = np.maximum.accumulate(above[ends][::-1])[::-1]
    out, at = [], 0
    for s in starts.tolist():
        if s < at:
            continue
        far = int(np.searchsorted(-best, -above[s], side="right")) - 1
        if far >= 0 and ends[far] - s >= least:
            out.append((s, int(ends[far])))
            at = out[-1][1]
    return out


def verify(b: np.ndarray, a: np.ndarray, order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(start, end in b, start, end in a, likeness) of the passages of b that are near ones of a; ``order`` sorts a."""
    order = np.argsort(a, kind="stable") if order is None else order
    at = np.searchsorted(a[order], b)
    at = order[np.minimum(at, len(a) - 1)] if len(a) else at
    hit = a[at] == b if len(a) else np.zeros(len(b), bool)
    if np.count_nonzero(hit) < ENOUGH:  # too few for any passage
        return []

    def near(s: int, e: int, at: np.ndarray, hit: np.ndarray) -> tuple | None:
        where = at[s:e][hit[s:e]] - (np.arange(s, e)[hit[s:e]] - s)  # diagonal of each shingle found
        start = max(0, int(np.median(where)))
        end = min(len(a), start + e - s)
        x, y = different(b[s:e]), different(a[start:end])
        union = len(different(np.concatenate([x, y])))
        both = len(x) + len(y) - union
        return (s, e, start, end, both / union) if union and both / union >= LIKENESS else None

    out = []
    for s, e in stretches(hit):
        if found := near(s, e, at, hit):
            out.append(found)
    left = hit.copy()  # shingles found that no passage holds yet
    for s, e, *_ in out:
        left[s:e] = False
    if not left.any():
        return out
    # Hits of several places can join up or hide one another, so each band of diagonals is tried by itself.
    found, known = [], None
    for low in bands(b, a, order, left):
        known = known or ranked(b, a)
        at, hit = in_band(b, a, low, low + SLACK, known)
        found += [f for s, e in stretches(hit) if (f := near(s, e, at, hit))]
    for f in sorted(found, key=lambda f: (f[0] - f[1], f)):
        if left[f[0] : f[1]].any():
            out.append(f)
            left[f[0] : f[1]] = False
    return sorted(out)


def different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def bands(b: np.ndarray, a: np.ndarray, places: np.ndarray, left: np.ndarray) -> list[int]:
    """Where the bands of ``SLACK`` diagonals (place in a less that in b) start that have enough equal shingles
    for a passage, one of those ``left`` in b among them; each overlaps the next by half. ``places`` sorts a."""
    half = SLACK // 2
    values = a[places]
    lows, highs = np.searchsorted(values, b), np.searchsorted(values, b, "right")
    counts = highs - lows
    total = np.zeros((len(a) + len(b)) // half + 3, np.int64)
    new = np.zeros(len(total), bool)
    upto, i = np.cumsum(counts), 0
    while i < len(b):  # a block of b at a time, as equal shingles may be many
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + (1 << 20), "right")))
        n = counts[i:j]
        which = np.repeat(lows[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        of = np.repeat(np.arange(i, j), n)
        band = (places[which] - of + len(b)) // half
        total += np.bincount(band, minlength=len(total))
        new[band[left[of]]] = True
        i = j
    return (np.flatnonzero((total[:-1] + total[1:] >= ENOUGH) & (new[:-1] | new[1:])) * half - len(b)).tolist()


def ranked(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a by value, the number of each value of b among those of a, and whether a has it."""
    values, rank = np.unique(a, return_inverse=True)
    r = np.minimum(np.searchsorted(values, b), len(values) - 1)
    return np.sort(rank * (len(a) + 1) + np.arange(len(a))), r, values[r] == b


def in_band(b: np.ndarray, a: np.ndarray, low: int, high: int, of_all: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle of b its place in a on these diagonals (the first), and whether there is one; ``of_all`` is ``ranked``."""
    known, r, has = of_all
    wide = len(a) + 1
    first = np.clip(np.arange(len(b)) + low, 0, len(a))
    at = known[np.minimum(np.searchsorted(known, r * wide + first), len(known) - 1)]
    hit = has & (at // wide == r) & (at % wide >= first) & (at % wide < np.arange(len(b)) + high)
    return at % wide, hit


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word of each repeated passage, first_doc_id, first_start_word,
    first_end_word of an earlier occurrence, and likeness."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    found = ties(windows(docs), AGREE)
    pairs = written(candidates(found), "candidates")
    drop_written(found)
    need = pairs.select(F.col("b").alias("doc_id"), "lo", "hi").unionByName(pairs.select(F.col("a").alias("doc_id"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")))
    # A document's ranges are few and different, however many others it is compared with; its text travels once.
    need = need.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_ranges, texts = (c.to_pylist() for c in batch.columns)
            for i, j in some_at_a_time(texts):
                rows = []
                for doc_id, ranges, x in zip(ids[i:j], all_ranges[i:j], shingles_of(texts[i:j])):
                    hashes = (x >> np.uint64(32)).astype("<u4")
                    rows += [(doc_id, r["lo"], r["hi"], hashes[r["lo"] : r["hi"] + 1].tobytes()) for r in ranges]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "lo", "hi", "x"])

    # The stretches grow with the documents, so they are joined by sorting at every size.
    cut = written(docs.join(need.hint("merge"), "doc_id").select("doc_id", "ranges", "text").mapInArrow(slices, "doc_id long, lo long, hi long, x binary"), "slices")
    b = cut.select(F.col("doc_id").alias("b"), "lo", "hi", F.col("x").alias("b_x"))
    a = cut.select(F.col("doc_id").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.col("x").alias("a_x"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = y = order = None  # the same stretch of the earlier document comes many times in a row
        for batch in batches:
            out = []
            for b, a, b_lo, a_lo, b_x, a_x in zip(*[c.to_pylist() for c in batch.columns]):
                if a_x != before:
                    before, y = a_x, np.frombuffer(a_x, "<u4")
                    order = np.argsort(y, kind="stable")
                for s, e, start, end, like in verify(np.frombuffer(b_x, "<u4"), y, order):
                    row = (b, b_lo + s, b_lo + e + WORDS - 1, a, a_lo + start, a_lo + end + WORDS - 1, like)
                    if row[:2] > row[3:5]:  # a stretch of one document can meet itself or what comes after it
                        out.append(row)
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], ["doc_id", "start_word", "end_word", "first_doc_id", "first_start_word", "first_end_word", "likeness"])

    both = pairs.join(b.hint("merge"), ["b", "lo", "hi"]).join(a.hint("merge"), ["a", "a_lo", "a_hi"]).select("b", "a", "lo", "a_lo", "b_x", "a_x")
    done = both.mapInArrow(check, "doc_id long, start_word long, end_word long, first_doc_id long, first_start_word long, first_end_word long, likeness double")
    # What lies in one and the same place of two tied stretches is reported once.
    return done.distinct()


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; the first occurrence of each stays.
    A text of which nothing is left goes with its row. A column n_chars follows the text."""
    names = docs.columns
    free = lambda name: name if name not in names else free(f"{name}_")
    spans_, id_ = free("_spans"), free("_id")
    spans = found.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(F.struct(F.col("start_word"), F.col("end_word"))).alias(spans_))
    cut = docs.join(spans.hint("merge"), docs["doc_id"] == spans[id_], "left").drop(id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts without a passage pass as they are, in the same job: two branches would shuffle all texts twice.
            columns = {n: batch.column(n) for n in names}
            touched = pc.is_valid(batch.column(spans_))
            some = batch.filter(touched)
            texts = [cut_words(t, [(s["start_word"], s["end_word"]) for s in spans]) for t, spans in zip(some.column("text").to_pylist(), some.column(spans_).to_pylist())]
            new = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array([len(t) for t in texts], pa.int64())} if "n_chars" in names else {})
            keep = pc.replace_with_mask(pa.repeat(True, len(batch)), touched, pa.array([bool(_WORD.search(t.encode())) for t in texts], pa.bool_()))
            for n, values in new.items():
                columns[n] = pc.replace_with_mask(columns[n], touched, values.cast(columns[n].type))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names).filter(keep)

    return cut.mapInArrow(run, docs.schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in these spans, and without the white space after each of them."""
    data, keep, at = text.encode(), [], 0
    starts = [m.start() for m in _WORD.finditer(data)]
    starts.append(len(data))
    for s, e in sorted(spans):
        if starts[s] > at:
            keep.append(data[at : starts[s]])
        at = max(at, starts[min(e, len(starts) - 1)])
    return b"".join([*keep, data[at:]]).decode()


def _words():
    import re

    return re.compile(rb"[^ \t\n\r\x0b\x0c]+")


_WORD = _words()
