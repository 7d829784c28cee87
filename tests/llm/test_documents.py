import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, components, fingerprints, mixing, nearcopies, quality, simhash, substrings, surface, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# components


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (2, 1), (10, 9), (9, 8), (8, 7), (7, 6), (20, 5), (None, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 7: 6, 8: 6, 9: 6, 10: 6, 20: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_links(spark):
    rng = np.random.default_rng(3)
    links = rng.integers(0, 300, (220, 2)).tolist()
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in range(300) if find(x) != x}


# SimHash


def plain_fingerprint(text):
    w = [x for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_fingerprints_and_components(odd):
    rows = odd.select("doc_id", "text").collect()
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = {(r.doc_id, plain_fingerprint(r.text)) for r in rows}
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in got} == want
    by = {r.doc_id: r.component_id for r in got}
    assert (by[1], by[2], by[3], by[6], by[7], by[None]) == (1, 1, 1, 6, 6, None)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("run", [2048, 2])
def test_simhash_links_all_near_fingerprints(spark, monkeypatch, run):
    """With runs of two at most, all longer ones take the way of two left-out bits."""
    monkeypatch.setattr(simhash, "RUN", run)
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(12):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert all((fps[signed.index(r.a)] ^ fps[signed.index(r.b)]).bit_count() <= 2 for r in found)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    got = {x: roots.get(x, x) for x in signed}
    want = plain_components(fps)
    assert len(set(got.values())) == len(set(want))
    for i in range(len(fps)):
        assert got[signed[i]] == got[signed[want[i]]]


def near_copies(seed=0, n=40, words=200):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[vocabulary[i] for i in rng.zipf(1.3, words) % 4000] for _ in range(n)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(0, n, 2):
        copy = list(base[i])
        for at in rng.integers(0, words, 3):
            copy[at] = f"new{i}x{at}"
        rows.append((1000 + i, " ".join(copy)))
    return rows


def test_near_copies_go_and_others_stay(docs_of):
    rows = near_copies()
    rows += [(2000, rows[1][1]), (2001, rows[1][1]), (None, rows[1][1]), (None, "alone"), (None, "alone"), (3000, None), (3001, "")]
    kept = nearcopies.deduplicate(docs_of(rows))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r[0] for r in got if r[0] is not None) == [*range(40), 3000] and [r for r in got if r[0] is None] == [(None, "alone")]
    assert nearcopies.deduplicate(docs_of([])).count() == 0


def test_a_large_group_of_near_copies(docs_of, monkeypatch):
    monkeypatch.setattr(nearcopies, "RUN", 8)
    base = [f"word{i}" for i in range(150)]
    rows = [(i, " ".join(w if j != i else f"x{i}" for j, w in enumerate(base))) for i in range(60)]
    assert [r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()] == [0]


def brute_kept(rows):
    """doc_ids that stay: the smallest of each set connected by a likeness of 0.8 of five-word shingles."""
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if root[i] != root[j] and (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted({rows[r][0] for r in root})


def templates(seed, n=150, copies=10):
    """Documents of one template, mostly less alike than 0.8, and copies of some with one word changed."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(480)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in range(20, 480, 30):
            words[at] = f"slot{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    for k, i in enumerate(rng.choice(n, copies, replace=False)):
        words = rows[i][1].split()
        words[int(rng.integers(0, 480))] = f"edit{k}"
        rows.append((1000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies_among_template_documents(docs_of, seed):
    rows = templates(seed)
    want = brute_kept(rows)
    assert len(want) > 100 and max(want) < 1000
    assert sorted(r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()) == want


def block_edits(seed=0, n=20, words=300):
    rng = np.random.default_rng(seed)
    text = lambda k: [f"w{i}" for i in rng.zipf(1.3, k) % 4000]
    rows, later = [], 0
    for i in range(n):
        x = text(words)
        rows.append((i, " ".join(x)))
        at = int(rng.integers(0, words - 60))
        for y in (x + text(words // 10), x[: words * 9 // 10], x + text(words * 18 // 100), x[:at] + text(15) + x[at + 15 :], text(30) + x, x[: words * 84 // 100]):
            rows.append((1000 + (later := later + 1), " ".join(y)))
    return rows


def test_copies_with_blocks_added_removed_and_replaced(docs_of):
    rows = block_edits()
    want = brute_kept(rows)
    assert want == list(range(20))
    assert sorted(r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()) == want


@pytest.mark.parametrize("run", [3, 40])
def test_long_runs_are_cut_into_cells(docs_of, monkeypatch, run):
    """Shingles with more texts than a run holds, ordered first: all pairs of different roots still meet."""
    monkeypatch.setattr(nearcopies, "RUN", run)
    monkeypatch.setattr(nearcopies, "prefix", lambda x, *_: x.view(np.int64))
    rows = templates(3, 40, 6) + [(k + 3000, t) for k, t in block_edits(2, 3)]
    assert sorted(r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()) == brute_kept(rows)


def test_texts_travel_once_and_few_to_be_verified(spark, docs_of):
    plan = nearcopies.deduplicate(docs_of([(1, "a b c"), (2, "a b c"), (3, None)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the texts and those that stay
    nodes = spark.range(4000).select(F.xxhash64("id").alias("node"))
    passed = nodes.where(nearcopies.may_be_among(nodes.limit(0))("node")).count(), nodes.where(nearcopies.may_be_among(nodes)("node")).count()
    other = spark.range(4000, 8000).select(F.xxhash64("id").alias("node"))
    assert passed == (0, 4000) and other.where(nearcopies.may_be_among(nodes)("node")).count() < 400


def test_parities_rule_out_no_near_pair():
    rng = np.random.default_rng(5)
    gone = 0
    for n in (1, 2, 60, 500, 3000):
        for share in (0, 0.3, 0.79, 0.8, 0.9, 1):
            for m in (n, int(n * 1.2)):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                y = np.unique(np.concatenate([x[: int(share * n)], rng.integers(0, 2**63, m - int(share * n)).astype(np.uint64)]))
                both = len(np.intersect1d(x, y))
                apart = len(x) + len(y) - 2 * both
                places = nearcopies.odd_places(nearcopies.parities(x), nearcopies.parities(y))
                assert places <= apart and places % 2 == apart % 2
                gone += n >= 60 and share < 0.5 and places > (len(x) + len(y)) / 9
    assert gone == 12


def test_copies_of_other_columns_and_repeated_ids(docs_of):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (1, "a b c d e f g"), (3, None), (4, " \t")]
    docs = docs_of(rows).withColumns({c: F.lit(c) for c in ("_k", "_l", "node", "_check", "_doc", "a", "b", "least")})
    got = nearcopies.deduplicate(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.where("doc_id < 3").collect()) == [(1, "a b c d e f g"), (1, "h i j k l m n")]
    assert [r.doc_id for r in got.where("doc_id > 2").collect()] == [3] and got.first()["_k"] == "_k"


@pytest.mark.parametrize("common", [1, 4, 10**9])
def test_prefixes_meet_at_the_likeness_whatever_the_order(docs_of, monkeypatch, common):
    monkeypatch.setattr(nearcopies, "COMMON", common)
    rows = block_edits(1, 6) + [(k + 5000, t) for k, t in templates(2, 30, 5)]
    assert sorted(r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()) == brute_kept(rows)


# passages


def test_compact_windows_cover_every_range_once():
    rng = np.random.default_rng(1)
    for values in (rng.permutation(70), rng.integers(0, 4, 70), np.zeros(60, int), np.arange(80), np.arange(80)[::-1]):
        h = values.astype(np.uint64)
        for made in (substrings.compact_windows(h, 20), substrings._by_stack(h, 20)):
            for i in range(len(h)):
                for j in range(i + 19, len(h)):
                    has = [c for l, c, r in made if l <= i <= c <= j <= r]
                    assert has == [i + int(h[i : j + 1].argmin())]


@pytest.mark.parametrize("rounds", [48, 1])
def test_windows_of_many_documents_at_once(monkeypatch, rounds):
    monkeypatch.setattr(substrings, "ROUNDS", rounds)
    monkeypatch.setattr(substrings, "BYTES", 100)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, n)) for n, vocabulary in ((300, 1000), (49, 1000), (50, 1000), (200, 1), (200, 2), (400, 5))]
    got = substrings.all_windows([*enumerate(texts), (None, texts[0]), (90, None), (91, "")])
    want = []
    for k, text in enumerate(texts):
        x = substrings.shingles(text)
        for f in range(substrings.FUNCTIONS):
            h = substrings.mixed(x, f)
            want += [(k, l, c, r) for l, c, r in (substrings._by_stack(h, substrings.LEAST) if len(h) else [])]
    assert sorted(map(tuple, got[:, 1:5].tolist())) == sorted(want) and {k for k, *_ in want} == {0, 2, 3, 4, 5}
    assert not len(substrings.all_windows([]))


def test_words_hash_as_they_part():
    for text in ("", " ", "a", " a  b\tc\nd\x0be\x0cf\rg\u00a0h \u00e9t\u00e9 ", "x" * 300 + " b"):
        words = text.encode().split()
        got = substrings.word_hashes(text)
        assert len(got) == len(words) and got.tolist() == [substrings.word_hashes(w.decode())[0] for w in words]
    assert len(set(substrings.word_hashes("ab ba aab aba baa a b").tolist())) == 7


def test_stretches():
    hit = np.array([0] * 30 + [1] * 50 + [0] * 5 + [1] * 60 + [0] * 60 + [1] * 40)
    assert substrings.stretches(hit) == [(30, 145)]
    assert substrings.stretches(np.zeros(100)) == [] and substrings.stretches(np.ones(46)) == [(0, 46)]


def passage_docs():
    rng = np.random.default_rng(7)
    text = lambda n, tag: [f"{tag}{i}" for i in rng.integers(0, 10**6, n)]
    shared, edited = text(80, "p"), None
    edited = [w if i != 40 else f"edit{i}" for i, w in enumerate(shared)]
    short, line = text(30, "q"), text(12, "l")
    docs = {1: text(60, "a") + shared + text(40, "b"), 2: text(30, "c") + edited + text(70, "d"), 3: text(50, "e") + short, 4: short + text(50, "f"), 5: shared[:60], 8: text(30, "h") + shared + text(60, "i") + shared}
    for i in range(100, 140):
        docs[i] = text(40, f"x{i}") + line + text(40, f"y{i}")
    return docs


def test_passages(docs_of):
    docs = passage_docs()
    got = substrings.passages(docs_of([(k, " ".join(w)) for k, w in docs.items()] + [(50, None), (51, ""), (None, " ".join(docs[1]))])).collect()
    by = {}
    for r in got:
        assert r.end_word - r.start_word >= 50 and (r.first_doc_id, r.first_start_word) < (r.doc_id, r.start_word)
        x, y = (set(substrings.shingles(" ".join(docs[d][s:e])).tolist()) for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.first_doc_id, r.first_start_word, r.first_end_word)))
        assert len(x & y) / len(x | y) == pytest.approx(r.likeness) and r.likeness >= 0.8
        by.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    assert set(by) == {2, 5, 8}
    assert (30, 110) in by[2] and (0, 60) in by[5] and {(30, 110), (170, 250)} <= set(by[8])
    assert substrings.passages(docs_of([])).count() == 0


def test_edited_passages_in_other_places():
    rng = np.random.default_rng(8)
    p1, p2, q1, q2, between = (rng.integers(0, 2**32, n).astype("<u4") for n in (76, 76, 76, 76, 60))
    for p, q in ((p1, q1), (p2, q2)):
        q[:] = p
        q[36:41] = rng.integers(0, 2**32, 5)  # one word edited
    joint = rng.integers(0, 2**32, 4).astype("<u4")
    b = np.concatenate([q1, joint, q2])
    for a in (np.concatenate([p1, between, p2]), np.concatenate([p2, between, p1])):
        got = substrings.verify(b, a)
        assert [(s, e) for s, e, *_ in got] == [(0, 76), (80, 156)] and all(like >= 0.8 for *_, like in got)
        for s, _, start, *_ in got:
            assert b[s] == a[start]
    line = np.full(200, 7, "<u4")
    assert substrings.verify(line, line) and substrings.verify(b, np.zeros(0, "<u4")) == []


def test_exact_passages_among_template_variants(docs_of):
    rng = np.random.default_rng(4)
    rows, want, k = [], set(), 0
    for g in range(20):
        base = [f"g{g}t{i}" for i in range(80)]

        def variant():
            words = list(base)
            for at in range(10, 80, 20):
                words[at] = f"slot{rng.integers(0, 10**6)}"
            return words

        copy = variant()
        for n, words in enumerate([*[variant() for _ in range(5)], copy, *[variant() for _ in range(40)], copy]):
            extra = [[f"x{rng.integers(0, 10**9)}" for _ in range(20)] for _ in range(2)]
            rows.append((k, " ".join([*extra[0], *words, *extra[1]])))
            if n == 46:
                want.add(k)
            k += 1
    found = substrings.passages(docs_of(rows)).collect()
    assert want <= {r.doc_id for r in found if r.end_word - r.start_word >= 80}


@pytest.mark.parametrize("run", [8, 10**6])
@pytest.mark.parametrize("split", [5, 1 << 14])
def test_ties_in_parts(docs_of, monkeypatch, run, split):
    """A frequent signature in parts, in tasks and in memory: all repeats are found."""
    monkeypatch.setattr(substrings, "RUN", run)
    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "OFTEN", 4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"d{k}x{i}" for i in range(30)) + " " + passage) for k in range(40)]
    assert (len(substrings.frequent(docs_of(rows).select("doc_id", "text"))[0]) > 0) == (split == 5)
    assert {r.doc_id for r in substrings.passages(docs_of(rows)).collect()} == set(range(1, 40))


def covered(found):
    """Words of each document that lie in a passage."""
    words = {}
    for k, s, e in found:
        words.setdefault(k, set()).update(range(s, e))
    return words


def passages_by_brute_force(rows):
    """Every document against every earlier one and itself, without windows."""
    hashes, out = [(k, (substrings.shingles(t) >> np.uint64(32)).astype("<u4")) for k, t in rows], []
    for i, (k, b) in enumerate(hashes):
        for _, a in hashes[:i]:
            out += [(k, s, e + 4) for s, e, *_ in substrings.verify(b, a)]
    return covered(out)


def test_passages_against_brute_force(docs_of, monkeypatch):
    rng = np.random.default_rng(16)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    shared, rows = [text(int(n)) for n in rng.integers(55, 200, 12)], []
    for k in range(70):
        words = text(int(rng.integers(20, 120)))
        for _ in range(int(rng.integers(0, 3))):
            passage = list(shared[int(rng.integers(0, 12))])
            if rng.random() < 0.5:
                passage[int(rng.integers(0, len(passage)))] = f"edit{k}"
            words += passage + text(int(rng.integers(5, 60)))
        rows.append((k, " ".join(words)))
    want = passages_by_brute_force(rows)
    for split in (1 << 14, 4):
        monkeypatch.setattr(substrings, "SPLIT", split)
        monkeypatch.setattr(substrings, "OFTEN", 3)
        got = covered((r.doc_id, r.start_word, r.end_word) for r in substrings.passages(docs_of(rows)).collect())
        both = sum(len(w & got.get(k, set())) for k, w in want.items())
        assert both >= 0.95 * sum(map(len, want.values())) and sum(map(len, got.values())) <= 1.05 * both


def test_a_long_near_copy_is_one_passage(docs_of):
    """Windows that reach over several places, far apart, and stretches that overlap are joined."""
    base = [f"w{i}" for i in range(20_000)]
    copy = [w if i % 400 else f"x{i}" for i, w in enumerate(base)]
    got = substrings.passages(docs_of([(1, " ".join(base)), (2, " ".join(copy))])).collect()
    assert len(got) == 1 and got[0].end_word - got[0].start_word >= 19_990
    tie = [(2, 1, 0, 0, 0, 12_287), (2, 1, 1, 0, 5000, 5200)]
    from pyspark.sql import SparkSession

    frame = SparkSession.active().createDataFrame(tie, "b long, a long, f long, off long, lo long, hi long")
    assert [(r.lo, r.hi) for r in substrings.candidates(frame).collect()] == [(0, 12_287)]


def test_clashing_names_of_other_columns(docs_of):
    docs = docs_of([(k, " ".join(w)) for k, w in passage_docs().items()])
    odd_names = docs.withColumns({c: F.lit(c) for c in ("_spans", "_id", "_parts", "_words", "_doc", "_hash", "_same", "shard")})
    left = substrings.without(odd_names, substrings.passages(odd_names))
    assert left.columns == odd_names.columns and {r["_spans"] for r in left.collect()} == {"_spans"}
    plain = {(r.doc_id, r.text) for r in substrings.without(docs, substrings.passages(docs)).collect()}
    assert {(r.doc_id, r.text) for r in left.collect()} == plain
    mixed = mixing.take(odd_names)
    assert mixed.columns == odd_names.columns and sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted((r.doc_id, r.text) for r in mixing.take(docs).collect())


def test_passages_are_cut_out(docs_of):
    docs = docs_of([(k, " ".join(w)) for k, w in passage_docs().items()] + [(50, None), (51, "")])
    left = {r.doc_id: r for r in substrings.without(docs, substrings.passages(docs)).collect()}
    words = passage_docs()
    assert 5 not in left and left[50].text is None and left[51].text == "" and left[1].text == " ".join(words[1])
    assert left[2].text == " ".join(words[2][:30] + words[2][110:]) and left[2].n_chars == len(left[2].text)
    assert left[8].text.split() == words[8][:30] + words[8][110:170]
    assert len(left) == len(words) - 1 + 2
    assert substrings.cut_words(" é b\n c d ", [(1, 3)]) == " é d "


# fingerprints


def brute_fingerprint(text):
    words = WORD.findall(text or "")
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    bins = {}
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), 42).to_bytes(8, "little"), h)
        signed = h - (1 << 64) if h >> 63 else h
        b = (signed >> 57) + 64
        bins[b] = min(bins.get(b, signed), signed)
    if not bins:
        return fingerprints.NONE
    probes = fingerprints.probes()
    return "".join("0123456789abcdef"[bins[b if b in bins else next(x for x in probes[b] if x in bins)] & 15] for b in range(128))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if fingerprints.NONE in (a, b):
        return 0.0
    same = sum(x == y for x, y in zip(a, b)) / 128
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_against_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES_A_PARTITION", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i) * 7 - 50, " ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(0, 300)))) for i in range(40)] + [(1000, None), (1001, "é 字"), (5000, " ")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs_of(rows)).collect()}
    line = sorted(((k, t or "") for k, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (k, text), (_, after) in zip(line, line[1:] + line[:1]):
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_fingerprint(text), brute_fingerprint(edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint)), pytest.approx(brute_likeness(r.fingerprint, brute_fingerprint(after))))


@pytest.mark.parametrize("ids", [[-(2**62) - 5, 3, 2**62 + 9], [*range(60), 10**15], [None] * 40 + [7] * 30, [5, 5, 5]])
def test_next_documents_whatever_the_ids(docs_of, monkeypatch, ids):
    """Wide, clustered, null and repeated ids: each document's next one is that of a plain sort."""
    monkeypatch.setattr(fingerprints, "RANGES_A_PARTITION", 4)
    rng = np.random.default_rng(14)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 99, 12))) for k in ids]
    got = fingerprints.fingerprint_pairs(docs_of(rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    want = []
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        want.append((k, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in got)


def test_fingerprints_of_odd_rows(odd, docs_of):
    assert fingerprints.fingerprint_pairs(odd).count() == 11
    assert fingerprints.fingerprint_pairs(docs_of([])).count() == 0
    one = fingerprints.fingerprint_pairs(docs_of([(3, "a b c d e f g h i")])).first()
    assert one.near_next == 1.0


def test_likeness_is_near_that_of_the_sets(docs_of):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 900)]
    for share in (0.2, 0.5, 0.8):
        n = int(600 * share)
        rows = [(1, " ".join(words[:600])), (0, " ".join(words[:n] + [w + "x" for w in words[n:600]]))]
        r = fingerprints.fingerprint_pairs(docs_of(rows)).where("doc_id = 1").first()
        true = n / (1200 - n)
        assert abs(r.near_next - true) < 0.15


# mixing


def test_sainte_lague(spark):
    rng = np.random.default_rng(6)
    for seats in (0, 1, 7, 100, 1003):
        w = [*rng.integers(0, 1000, 9).tolist(), 5000, 1]
        df = spark.createDataFrame([(1, i, float(x), seats) for i, x in enumerate(w)], "g int, k int, w double, n long")
        got = {r.k: r.got for r in mixing.sainte_lague(df, ["g"], ["k"], "w", "n", "got").collect()}
        want = [0] * len(w)
        for _ in range(seats):
            want[max(range(len(w)), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(len(w))] == want


def test_mixing_of_odd_rows(odd, docs_of):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    sources = {r.source: r for r in rows}
    total = sum(r["size"] for r in rows)
    assert sum(r.target for r in sources.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(docs_of([])).count() == 0 and mixing.take(docs_of([])).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")])).where("taken = 0").count() == 2


def test_mixed_words_come_near_the_targets_and_agree(docs_of):
    rng = np.random.default_rng(9)
    rows = [(i, "\n".join(" ".join(f"d{i}x{j}y{k}" for k in range(10)) for j in range(int(rng.integers(1, 40)))), f"s{i % 5 if i % 3 else 0}") for i in range(300)]
    docs = docs_of(rows)
    first, again = (sorted(map(tuple, mixing.mix(d, shard_docs=64).select("doc_id", "target", "taken", "source").collect())) for d in (docs, docs.repartition(5)))
    assert first == again
    for s in {r[3] for r in first}:
        own = [r for r in first if r[3] == s]
        assert abs(sum(r[2] for r in own) - own[0][1]) < 64 * 8
    taken = {r[0]: r[2] for r in first}
    words = {}
    for r in mixing.take(docs, shard_docs=64).collect():
        found = WORD.findall(r.text)
        assert len(set(found)) == len(found) and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(found)
    assert words == {k: v for k, v in taken.items() if v}


# classifiers


def test_surface():
    assert (surface.surface(None) == 0).all() and (surface.surface("") == 0).all()
    assert np.isfinite(surface.surface(" \n\t")).all() and np.isfinite(surface.surface("\x01é字" * 9)).all()


def graded(n=1200):
    rng = np.random.default_rng(10)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(60)]
        low, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = rng.choice(["nasty", "vile", "awful"])
        text = " ".join(f"{w}%%" if low else w for w in words)
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    return docs, labels + [(0, 0, 0), (None, 1, 1), (3, None, None)]


@pytest.mark.parametrize(("parts", "run"), [(0, 1 << 18), (3, 1 << 18), (0, 4)])
def test_windows_of_a_signature_all_meet_but_for_copies(spark, monkeypatch, parts, run):
    monkeypatch.setattr(substrings, "RUN", run)
    # Nine different windows and three copies of the fifth, under one signature.
    rows = [(8, d, 0, 100, 200, *[100 * d + k for k in range(6)], d % parts + 1 if parts else 0) for d in range(1, 10)]
    rows += [(8, d, 0, 100, 200, 500, *[100 * d + k for k in range(1, 6)], d % parts + 1 if parts else 0) for d in (11, 12, 13)]
    names = "key long, doc_id long, l int, c int, r int, " + ", ".join(f"{x} int" for x in substrings.AROUND) + ", part int"
    got = {(r.a, r.b) for r in substrings.ties(spark.createDataFrame(rows, names)).collect()}
    assert {(a, b) for b in range(1, 10) for a in range(1, b)} <= got
    assert all(any((a, b) in got for a in (5, 11, 12)) for b in (11, 12, 13))


def test_quality_learns_from_positives_and_unlabelled(spark, docs_of):
    docs, labels = graded()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = docs_of([*docs, (5000, None), (5001, ""), (None, "no id")])
    got = quality.classify(frame, labels).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    out = [i for i, _ in docs if by[i].held_out]
    assert np.mean([by[i].predicted == int(i % 5 != 0) for i in out]) > 0.97
    import zlib

    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in docs)
    kept = quality.accepted(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.classify(frame, labels.limit(0)).where("score = 0.5").count() == 1203
    assert quality.classify(docs_of([]), labels).count() == 0


def test_held_out_labels_change_no_score(spark, docs_of):
    docs, labels = graded(400)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    frame = docs_of(docs)
    assert sorted(map(tuple, quality.classify(frame, labels).collect())) == sorted(map(tuple, quality.classify(frame, turned).collect()))


def test_risk_is_not_negative():
    rng = np.random.default_rng(11)
    p, u = rng.normal(2, 1, (300, 3)), np.vstack([rng.normal(2, 1, (350, 3)), rng.normal(-2, 1, (150, 3))])
    w = quality.fit(p, u, 0.7)
    right = (np.hstack([u, np.ones((500, 1))]) @ w > 0) == (np.arange(500) < 350)
    assert right.mean() > 0.97


def test_prior_is_that_of_a_mixture():
    rng = np.random.default_rng(17)
    bins = lambda z: np.bincount(quality.bins_of(z), minlength=quality.BINS)
    for share in (0.3, 0.6, 0.9):
        n = int(20_000 * share)
        documents = np.concatenate([rng.normal(3, 1, n), rng.normal(-3, 1, 20_000 - n)])
        assert abs(quality.prior_of(bins(rng.normal(3, 1, 2000)), bins(documents)) - share) < 0.06
    assert quality.prior_of(np.zeros(quality.BINS, int), bins(documents)) == 0.5


def test_quality_against_plain_steps(spark, docs_of):
    """The fit, one row and one feature at a time, and the scores of the registered way."""
    rng = np.random.default_rng(18)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    w, m, v = [0.0] * 4, [0.0] * 4, [0.0] * 4
    for t in range(1, 26):
        sig = lambda x: 1 / (1 + np.exp(-(sum(a * b for a, b in zip(w, [*x, 1.0])))))  # noqa: B023, E731
        risk_u, risk_p = (float(np.mean([-np.log(1 - sig(x)) for x in some])) for some in (u, p))
        grad = []
        for j in range(4):
            at = lambda x: [*x, 1.0][j]  # noqa: B023, E731
            plus = 0.6 * np.mean([(sig(x) - 1) * at(x) for x in p])
            minus = np.mean([sig(x) * at(x) for x in u]) - 0.6 * np.mean([sig(x) * at(x) for x in p])
            grad.append((plus + minus if risk_u - 0.6 * risk_p >= 0 else -minus) + (1e-4 * w[j] if j < 3 else 0))
        for j in range(4):
            m[j], v[j] = 0.9 * m[j] + 0.1 * grad[j], 0.999 * v[j] + 0.001 * grad[j] ** 2
            w[j] -= 0.05 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(quality.fit(p, u, 0.6, steps=25), w)
    model = rng.normal(0, 1, surface.SIZE + 1)
    rows = [(i, f"text {i} " * (i + 1)) for i in range(9)] + [(10, None)]
    got = {r.doc_id: r.score for r in quality.score(docs_of(rows).select("doc_id", "text"), model).collect()}
    for k, text in rows:
        z = sum(float(a) * float(b) for a, b in zip(surface.surface(text), model)) + model[-1]
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_toxicity_chain(spark, docs_of):
    docs, labels = graded()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs_of([*docs, (5000, None), (5001, ""), (None, "no id")]), labels).collect()
    by = {r.doc_id: r for r in got}
    out = [i for i, _ in docs if by[i].held_out]
    assert np.mean([by[i].predicted == int(i % 4 == 1) for i in out]) > 0.97
    assert np.mean([(by[i].p_low_quality >= 0.5) == (i % 5 == 0) for i in out]) > 0.97
    assert len(got) == 1203 and toxicity.classify(docs_of([]), labels).count() == 0
    assert toxicity.classify(docs_of(docs[:5]), labels.limit(0)).count() == 5


def test_the_highest_of_each_mark_holds(spark, docs_of):
    seen = []
    docs, labels = graded(300)
    apart = [(k, q, None) for k, q, _ in labels] + [(k, None, t) for k, _, t in labels] + [(k, 1, 0) for k, _, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    for some in (labels, apart):
        got = toxicity.classify(docs_of(docs), spark.createDataFrame(some, schema)).orderBy("doc_id").collect()
        seen.append([(r.doc_id, round(r.p_low_quality, 6), round(r.p_toxic, 6), r.predicted) for r in got])
    assert seen[0] == seen[1]


def test_chain_against_plain_steps():
    """A chain of two made by hand: models of one category, their outputs out of fold as a feature of the next."""
    rng = np.random.default_rng(15)
    n = 90
    surfaces, rows = rng.normal(0, 1, (n, surface.SIZE)).astype(np.float32), [rng.integers(0, 40, 6) for _ in range(n)]
    first = (surfaces[:, 0] > 0).astype(int)
    marks, folds = np.stack([first, first ^ (rng.random(n) < 0.1)], 1), np.arange(n) % 3
    models = toxicity.fit_chain(surfaces, rows, marks, folds)
    out = np.zeros((n, 1))
    for i in range(n):
        rest = [j for j in range(n) if folds[j] != folds[i]]
        model = toxicity.fit_one(surfaces[rest], [rows[j] for j in rest], np.zeros((len(rest), 0)), marks[rest, 0].astype(float))
        out[i] = toxicity.apply_one(model, surfaces[i : i + 1], [rows[i]], np.zeros((1, 0)))
    later = toxicity.fit_one(surfaces, rows, out, marks[:, 1].astype(float))
    assert np.allclose(later[1], models[1][1]) and (later[0] == models[1][0]).all()
    # Newton's method ends where the gradient of the penalised loss is nothing.
    x = np.hstack([surfaces, toxicity.has_words(rows, later[0]), out, np.ones((n, 1))]).astype(float)
    s = 1 / (1 + np.exp(-x @ later[1]))
    assert np.abs(x.T @ (s - marks[:, 1]) + np.append(np.ones(x.shape[1] - 1), 1e-6) * later[1]).max() < 1e-2


def test_cuts():
    y, z = np.array([1, 1, 0, 1, 0, 0]), np.array([3.0, 2.0, 1.0, 1.0, 0.0, -1.0])
    assert toxicity.best_cut(y, z) == 1.5 and toxicity.best_cut(1 - y, z) == 0.0 and toxicity.best_cut(np.zeros(3), z[:3]) == 0.0


def test_folds_of_ids_that_share_a_remainder():
    assert set(toxicity.fold_of(range(0, 300, 3))) == {0, 1, 2}


def test_later_models_meet_out_of_fold_outputs():
    """Earlier marks that are noise must not look known to a later model."""
    rng = np.random.default_rng(12)
    n = 600
    surfaces, rows = rng.normal(0, 1, (n, surface.SIZE)).astype(np.float32), [np.array([], np.int64)] * n
    noise = rng.integers(0, 2, n)
    models = toxicity.fit_chain(surfaces, rows, np.stack([noise, noise], 1), np.arange(n) % 3)
    assert models[1][1][surface.SIZE] < 0.2  # the weight of the earlier log-odds


# chats


def brute_chats(turns):
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t, r, x))
    by = {c: [(r, x) for t, r, x in sorted(v, key=lambda y: y[0])] for c, v in by.items()}
    out = []
    for c, v in by.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in by.values())
        equal = [d for d, w in by.items() if w == v]
        if not longer and c == min(equal):
            out.append((c, len(v), len(equal), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)))
    return sorted(out)


def test_chats_against_brute_force(spark):
    rng = np.random.default_rng(13)
    turns = []
    for c in range(60):
        for t in range(int(rng.integers(1, 6))):
            turns.append((c, t, ["user", "assistant"][t % 2], f"x{rng.integers(0, 2)}"))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "a": F.lit("z"), "last": F.lit(0)})
    assert sorted(map(tuple, chat.format_chats(df.repartition(5)).collect())) == brute_chats(turns)


def test_chats_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (3, None, None, "x"), (3, 0, "user", "y"), (None, 0, "user", "z"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "user", "q")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[None].copies == 1 and got[3].text.startswith("<|im_start|>\nx") and got[4].n_turns == 2
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_snapshots_that_end_inside_a_tie_and_turns_without_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = []
    for c in range(0, 40, 2):
        first, second = (c, 1, "assistant", f"a{c}"), (c, 1, "user", f"u{c}")
        rows += [first, second, (c + 1, 1, "assistant", f"a{c}")]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 5, "user", "y"), (100, 0, "user", "y"), (100, 1, "user", "z")]
    got = chat.format_chats(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.conv_id for r in got if r.conv_id is not None) == [*range(0, 40, 2), 100]
    assert sorted((r.copies, r.n_turns, r.text) for r in got if r.conv_id is None) == [(2, 1, "<|im_start|>user\nx<|im_end|>\n")]
    assert all(r.text == f"<|im_start|>assistant\na{r.conv_id}<|im_end|>\n<|im_start|>user\nu{r.conv_id}<|im_end|>\n" for r in got if r.conv_id is not None and r.conv_id < 100)


# what groups of near copies and of texts that share a line make


def near_group(n=60):
    base = [f"word{i}" for i in range(150)]
    return [(i, " ".join(w if j not in (i, i + 40) else f"x{i}y{j}" for j, w in enumerate(base))) for i in range(n)]


def sharing_a_line(n=60):
    rng = np.random.default_rng(3)
    some = lambda: [f"w{x}" for x in rng.integers(0, 10**6, 80)]
    return [(i, " ".join([*some(), *[f"line{k}" for k in range(12)], *some()])) for i in range(n)]


def rows_written(monkeypatch, module):
    made, write = {}, module.written

    def counted(df, name):
        back = write(df, name)
        made[name] = made.get(name, 0) + back.count()
        return back

    monkeypatch.setattr(module, "written", counted)
    return made


def test_links_of_near_copies_grow_as_their_number(docs_of):
    texts = docs_of(near_group()).select(F.xxhash64("doc_id").alias("node"), "text")
    pairs = nearcopies.side_by_side(nearcopies.sketches(texts))[0].distinct().count()
    assert 59 <= pairs <= 3 * 60
    assert [r.doc_id for r in nearcopies.deduplicate(docs_of(near_group())).collect()] == [0]


def test_texts_that_share_a_line_part_where_they_meet(docs_of, monkeypatch):
    monkeypatch.setattr(nearcopies, "prefix", lambda x, *_: x.view(np.int64))
    made = rows_written(monkeypatch, nearcopies)
    rows = sharing_a_line() + [(k + 100, f"{t} more") for k, t in sharing_a_line(3)]
    assert sorted(r.doc_id for r in nearcopies.deduplicate(docs_of(rows)).collect()) == list(range(60))
    assert made["candidates"] <= 20
    texts = docs_of(sharing_a_line()).select(F.xxhash64("doc_id").alias("node"), "text")
    found = nearcopies.sketches(texts)
    busy = nearcopies.side_by_side(found)[1].withColumns({"root": F.col("node"), "at": F.lit(0).cast("long")})
    assert nearcopies.across(busy, found).count() == 0


def test_ties_of_a_shared_line_are_few_and_those_of_copies_in_proportion(docs_of, monkeypatch):
    made = rows_written(monkeypatch, substrings)
    assert substrings.passages(docs_of(sharing_a_line())).count() == 0 and made["ties"] < 60
    made.clear()
    got = substrings.passages(docs_of(near_group())).collect()
    assert {r.doc_id for r in got} == set(range(1, 60)) and made["candidates"] <= 10 * 60
