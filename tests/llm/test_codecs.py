import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import flac, huffman, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# FLAC


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-128, 127), min_size=1, max_size=300), st.integers(1, 64))
def test_flac_round_trip_of_any_samples(values, block):
    x = np.array(values)
    assert (flac.decode(flac.encode(x, block=max(16, block)))[0] == x).all()


@pytest.mark.parametrize("kind", ["noise", "zero", "tone", "walk", "smooth"])
@pytest.mark.parametrize("n", [1, 5, 4096, 9001])
def test_flac_round_trip(kind, n):
    rng = np.random.default_rng(0)
    x = {"noise": rng.integers(-128, 128, n), "zero": np.zeros(n, int), "tone": (100 * np.sin(np.arange(n) / 9)).astype(int), "walk": np.cumsum(rng.integers(-1, 2, n)).clip(-128, 127), "smooth": np.cumsum(np.cumsum(rng.integers(-1, 2, n))).clip(-128, 127)}[kind]
    assert (flac.decode(flac.encode(x))[0] == x).all()


def test_flac_of_16_bits_is_smaller_than_pcm_and_seekable():
    x = (9000 * np.sin(np.arange(20_000) / 15) + np.random.default_rng(1).normal(0, 30, 20_000)).astype(int)
    data = flac.encode(x, 16)
    assert len(data) < 0.6 * 2 * len(x)
    for first, block in flac.decode_blocks(data):
        assert (block[0] == x[first : first + flac.BLOCK]).all()


def test_flac_reads_from_any_sample():
    x = np.cumsum(np.random.default_rng(2).integers(-1, 2, 20_000)).clip(-128, 127)
    data = flac.encode(x)
    assert [p[0] for p in flac.read_metadata(data)[0]["seek"]] == list(range(0, 20_000, flac.BLOCK))
    for since, count in ((0, 10), (4095, 2), (8192, 4096), (12_345, 7000), (19_999, 5), (5, 0)):
        assert (flac.pcm(data, since, count)[0] == x[since : since + count]).all()
    broken = bytearray(data)
    broken[len(flac.MAGIC) + 4 + 34 + 4 + 18 + 7] ^= 1  # the second point's sample
    with pytest.raises(flac.FlacError):
        flac.pcm(bytes(broken), 5000, 10)


def bits(*parts):
    return flac.put_bits(list(parts))


@pytest.mark.parametrize("mode,left,right", [(1, [5, -3, 7, 7], [1, 2, 3, 4]), (8, [5, -3, 7, 7], [1, 2, 3, 4]), (9, [5, -3, 7, 7], [1, 2, 3, 4]), (10, [5, -3, 7, 7], [1, 2, 3, 5])])
def test_flac_stereo_and_wasted_bits(mode, left, right):
    side = [a - b for a, b in zip(left, right)]
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    first, second = {1: (left, right), 8: (left, side), 9: (side, right), 10: (mid, side)}[mode]
    wide = lambda i: 8 + ((mode, i) in ((8, 1), (9, 0), (10, 1)))
    sub = [np.concatenate([bits((2, 8)), *[bits((v & (1 << wide(i)) - 1, wide(i))) for v in xs]]) for i, xs in enumerate((first, second))]
    head = bytes([0xFF, 0xF8, 0x60, mode << 4 | 2]) + b"\0" + bytes([3])
    head += bytes([flac.crc(head, 8, 7)])
    frame = head + np.packbits(np.concatenate(sub)).tobytes()
    frame += flac.crc(frame, 16, 0x8005).to_bytes(2, "big")
    x, at, end = flac.read_frame(frame, 0, {"block": 4, "depth": 8})
    assert x.tolist() == [left, right] and (at, end) == (0, len(frame))
    wasted = np.concatenate([bits((3, 8), (0, 1), (1, 1)), *[bits((v & 63, 6)) for v in (1, -2, 3)]])
    assert flac.read_subframe(flac.Reader(wasted), 3, 8).tolist() == [4, -8, 12]


def test_flac_fixed_orders_partitions_and_escapes():
    for order in range(5):
        x = np.cumsum(np.cumsum(np.arange(40) % 7 - 3)) % 50
        r = np.diff(x, order)
        head = bits((0, 1), (8 | order, 6), (0, 1), *[(int(v) & 0xFFFF, 16) for v in x[:order]], (1, 2), (1, 4))
        half = 20 - order
        body = [bits((6, 5)), flac.rice_bits(flac.fold(r[:half]), 6), bits((31, 5), (12, 5)), *[bits((int(v) & 4095, 12)) for v in r[half:]]]
        assert (flac.read_subframe(flac.Reader(np.concatenate([head, *body])), 40, 16) == x).all()


def test_flac_finds_damage():
    data = bytearray(flac.encode_payload(b"some text of some length " * 30))
    for at in (len(data) - 1, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode(bytes(bad))
    with pytest.raises(flac.FlacError):
        flac.decode(b"RIFF" + bytes(data[4:]))
    assert flac.crc(b"123456789", 16, 0x8005) == 0xFEE8 and flac.crc(b"123456789", 8, 7) == 0xF4
    assert [flac.utf8_number(n) for n in (0, 127, 128, 0x800)] == [b"\0", b"\x7f", b"\xc2\x80", b"\xe0\xa0\x80"]


def test_flac_of_texts(odd):
    got = flac.describe(flac.store(odd)).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == 11
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.pcm_blocks == -(-len(payload) // flac.BLOCK) and r.offsets_crc32 == zlib.crc32(np.arange(0, len(payload), flac.BLOCK).astype("<u8").tobytes())
        x = [b - 128 for b in payload]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"n={len(x)};mean={sum(x) / len(x):.4f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f};crossings={crossings}"
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (6, 7)}) == 1
    pcm = flac.pcm_blocks(flac.store(odd).where("doc_id = 6")).orderBy("first_sample").collect()
    assert b"".join(bytes(r.pcm) for r in pcm).rstrip(b"\0").decode() == texts[6] and pcm[1].first_sample == flac.BLOCK
    assert flac.describe(flac.store(odd.limit(0))).count() == 0


# tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aéΩ字 \n\t.,'s1!?%\x1c\x85 　́ª<|>", "<|endoftext|>", "<|endoftext"]), max_size=14).map("".join), max_size=20))
def test_tokens_are_the_librarys(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(PATH).encode(texts)] == library(texts)


def test_tokens_after_the_store_was_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", 20)
    e = tokens.Encoder(PATH)
    for texts in (["one two three. four,"], [f"w{i} x{i}%" for i in range(50)], ["one <|endoftext|> two"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library(texts)


def test_parts_met_again_stay_in_a_full_store(monkeypatch):
    monkeypatch.setattr(tokens, "LIMIT", 20)
    e, learned = tokens.Encoder(PATH), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda parts: (learned.extend(parts := list(parts)), learn(parts)))
    for i in range(20):
        e.encode([" ".join(["x", "one", *[f"w{i}a{k}" for k in range(5)]])])
    assert learned.count("one") == 1 and len(e._known) + len(getattr(e, "_older", {})) <= 2 * (20 + 7)


def test_a_part_of_many_texts_is_looked_up_once(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    texts = ["", " ", " a", "a ", "one two  three\n", "one\ntwo three. <", "one <|endoftext|> two", *["so one two three. four,"] * 50, "\u3000 a b", "é one"]
    e, seen = tokens.Encoder(PATH), []

    class Store(dict):
        def __getitem__(self, part):
            seen.append(part)
            return dict.__getitem__(self, part)

    e._known = Store()
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == library(texts)
    assert seen.count("three.") == 1 and len(e._known) > 0
    e.forget()
    assert not e._known and not e._older and e.encode(["one"])[0] == np.array(library(["one"])[0], "<u4").tobytes()


def test_a_worker_gives_the_memory_of_the_store_back():
    import re
    from pathlib import Path

    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
    e = tokens.Encoder(PATH)
    sum(map(len, e.each([" ".join(f"word{k}of{i}" for k in range(500)) for i in range(500)])))
    before = held()
    e.forget()
    assert held() < before - 30


def test_batches_of_texts_are_small_while_a_table_is_written(spark):
    import pyarrow as pa

    from tidemark.llm.scratch import written

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], ["n", "b"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = written(spark.range(0, 3000, 1, 1).select(F.lit("x" * 5000).alias("text")).mapInArrow(run, "n long, b long"), "batches").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.b for r in rows) < 5_000_000 and spark.conf.get(name) == before


# Huffman


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60), st.integers(6, 18))
def test_code_lengths_are_a_best_code(counts, most):
    lengths = huffman.code_lengths(np.array(counts), most)
    used = np.flatnonzero(counts)
    if len(used) > 1:
        assert lengths.max() <= most and abs(sum(2.0 ** -int(n) for n in lengths[used]) - 1) < 1e-12
    if len(used) > 1 and most == 18:
        import heapq

        heap, cost = [counts[i] for i in used], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert int((lengths.astype(int) * np.array(counts)).sum()) >= cost


def test_huffman_round_trip_and_limits():
    rng = np.random.default_rng(2)
    counts = np.zeros(1 << 16, np.int64)
    counts[:30] = [2**i for i in range(30)]  # an unlimited code would have 29 bits
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == huffman.MAX_BITS
    sizes = np.array([1, 63, 64, 65, 5000, 1])
    ids = rng.integers(0, 30, sizes.sum())
    payload, doc_bytes, steps = huffman.encode(ids, sizes, lengths, huffman.canonical_codes(lengths))
    assert (huffman.decode(payload, sizes, steps, huffman.decode_table(lengths)) == ids).all()
    at = int(doc_bytes[:4].sum())  # a document alone, from its checkpoint on
    alone = huffman.decode(payload[at : at + int(doc_bytes[4])], sizes[4:5], steps[1 + 1 + 1 + 2 : 1 + 1 + 1 + 2 + 79], huffman.decode_table(lengths))
    assert (alone == ids[193:5193]).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(100, int), 6)


def test_huffman_file(odd):
    blocks, lengths = huffman.store(odd, PATH, end=0)
    got = huffman.read_blocks(blocks, lengths).collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    want, start = [], 0
    for r, ids in zip(rows, library([r.text for r in rows])):
        want.append((r.doc_id, start, [*ids, 0]))
        start += len(ids) + 1
    key = lambda x: x[1]
    assert sorted([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got], key=key) == want
    blocks, lengths = huffman.store(odd.limit(0), PATH)
    assert huffman.read_blocks(blocks, lengths).count() == 0


# packing


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20_000))
def test_cuts_cover_a_document(n):
    out = packing.cuts(n)
    assert sum(out) == n and all(0 < x <= packing.CAPACITY for x in out) and len(out) <= n // packing.CAPACITY + 6


def test_packing(odd):
    got = packing.pack(odd.repartition(3), PATH).withColumn("crc", F.crc32("ids")).collect()
    rows = odd.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), tuple([*ids, 1])) for r, ids in zip(rows, library([r.text for r in rows])))
    tokens_of = sorted((str(r.doc_id), r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert sum(len(x[2]) for x in tokens_of) == sum(len(w[1]) for w in want)
    by_sequence = {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    assert padding < packing.CAPACITY
    for doc, ids in want:
        parts = [(s, x) for d, s, x in tokens_of if d == doc]
        if doc != "7":  # a repeated row has its pieces twice
            assert [t for _, x in sorted(parts) for t in x] == list(ids)
    assert packing.pack(odd.limit(0), PATH).count() == 0
