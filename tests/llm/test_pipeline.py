"""The pipeline over a small corpus, each stage against what it has to do."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidemark.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmno"), rng.integers(2, 9))) for _ in range(3000)]
    text = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    shared = text(90)
    docs, labels = [], []
    for i in range(400):
        words, low = text(int(rng.integers(60, 160))), i % 6 == 5
        if i in (10, 20, 30):
            words = words[:30] + shared + words[30:]
        docs.append((i, " ".join(f"{w}%%" if low else w for w in words), f"s{i % 4}"))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not low), 0))
    base = docs[40][1].split()
    docs += [(500, docs[40][1], "s0"), (501, " ".join(["changed", *base[1:]]), "s1"), (502, None, "s1"), (None, "no id " + docs[1][1], None)]
    sf = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(k, t, "en", s, None if t is None else len(t)) for k, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, corpus), f"test-{name}")
        out[name] = docs
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "simhash", "substrings", "mixing", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_low_quality_goes(stages):
    kept = {r.doc_id for r in stages["quality"].select("doc_id").collect()}
    low = {i for i in range(400) if i % 6 == 5}
    assert len(kept & low) <= 2 and len(set(range(400)) - low - kept) <= 5


def test_copies_go(stages):
    before, after = ({r.doc_id for r in stages[n].select("doc_id").collect()} for n in ("quality", "simhash"))
    assert before - after <= {500, 501} and {500, 501} & after == set() and 40 in after


def test_repeated_passages_go(stages):
    before, after = ({r.doc_id: r.text for r in stages[n].collect()} for n in ("simhash", "substrings"))
    changed = {k for k in before if after.get(k) != before[k]}
    assert {20, 30} <= changed and 10 not in changed and len(changed) <= 4
    assert len(WORD.findall(before[20])) - len(WORD.findall(after[20])) == 90


def test_mixed_words_are_the_documents_words(stages):
    before = {r.doc_id: (r.source, WORD.findall(r.text or "")) for r in stages["substrings"].collect()}
    rows = stages["mixing"].collect()
    taken = Counter()
    for r in rows:
        words = WORD.findall(r.text)
        assert not Counter(words) - Counter(before[r.doc_id][1]) and r.n_chars == len(r.text)
        taken[before[r.doc_id][0]] += len(words)
    total = sum(len(w) for _, w in before.values())
    assert abs(sum(taken.values()) - 1.5 * total) < 64 * 6
    assert max(Counter(r.doc_id for r in rows).values()) <= 2


def test_packed_ids_are_the_mixed_texts(stages):
    encoder = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages["mixing"].collect():
        ids = encoder.encode([r.text])[0]
        want += Counter({(r.doc_id, len(ids) // 4 + 1): len(ids) // 4 + 1})
    got = Counter()
    for r in stages["packing"].collect():
        assert len(r.ids) == 4 * r.length
        got += Counter({(r.doc_id, r.doc_tokens): r.length})
    assert got == want


def test_run_gives_the_last_stages_rows(spark, corpus, stages):
    row = lambda df: sorted(map(str, df.select("doc_id", "start", "length", "doc_tokens", "ids").collect()))
    assert row(corpus_pipeline.run(spark, corpus)) == row(stages["packing"])
