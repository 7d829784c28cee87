"""Toxicity categories by a classifier chain of linear models.

Categories are predicted in order; the log-odds of the earlier ones are features of the later ones. In
learning, these come from models that have not seen the row (``FOLDS`` folds), so a later model meets
earlier outputs of the quality that it will meet in use. Each model is a logistic regression, fitted by
Newton's method, over the surface of the text and the words that go with its category.

The table of labels has one toxicity mark beside that of quality, so the chain of the query is: low_quality
(quality 0), then toxic (toxic 1). They are not functions of each other (of 3,980 labelled documents at sf0.1, 12 % of
those of low quality are toxic and 11 % of the others). ``classify`` takes any chain of marks. A document
is predicted to be of a category from that log-odds on which gave the best F1 out of fold
at a precision of 0.9 or more.

Learning sees about ``SAMPLE`` labelled rows, picked by a hash of doc_id, none of them held out
(crc32(doc_id) mod 3 is 1); scoring sees the whole of every text.

Defined results: a null text is scored as an empty one; a null doc_id has no label; of several labels
of a document the highest of each mark holds, a null mark is 0; a category of which the labels have one value
scores that share; without labels every probability is 0.5; an empty table gives no rows. Columns other than those
named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import held_out, share_of
from .scratch import drop_written, written
from .surface import SIZE, surface

SAMPLE = 16_000
FOLDS = 3
PRECISION = 0.9
BUCKETS = 1 << 17
WORDS = 256


def chain() -> dict[str, Column]:
    """Name and mark (0 or 1) of each category, in order."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low.cast("int"), "toxic": toxic.cast("int")}


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the different words of a text, in lower case, without punctuation at their ends."""
    words = {w.strip(b".,;:!?\"'()[]{}|#$%&*-_") for w in (text or "").lower().encode().split()}
    return np.unique(np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words)))


def pick_words(rows: list[np.ndarray], y: np.ndarray, most: int = WORDS) -> np.ndarray:
    """Buckets whose share of rows differs most between marks, in standard errors; those of 5 rows or more."""
    def count(some):
        return np.bincount(np.concatenate([rows[i] for i in some]) if len(some) else np.zeros(0, np.int64), minlength=BUCKETS).astype(float)

    yes, no = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = count(yes), count(no)
    share = (a + b) / len(y)
    z = np.abs(a / len(yes) - b / len(no)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / len(yes) + 1 / len(no)))
    z[(a + b) < 5] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 3])


def has_words(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    column = np.full(BUCKETS, -1)
    column[words] = np.arange(len(words))
    out = np.zeros((len(rows), len(words)), np.float32)
    for i, row in enumerate(rows):
        at = column[row]
        out[i, at[at >= 0]] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s - y) + keep * w
        step = np.linalg.solve((x * np.maximum(s * (1 - s), 1e-6)[:, None]).T @ x + np.diag(keep), grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def fit_one(surfaces, rows, before, y):
    """(words, weights): the weights are of the surface, the words, the earlier log-odds and the bias."""
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(0, np.int64), np.append(np.zeros(SIZE + before.shape[1]), np.log(share / (1 - share)))
    words = pick_words(rows, y)
    return words, logistic(np.hstack([surfaces, has_words(rows, words), before]), y)


def apply_one(model, surfaces, rows, before):
    words, w = model[:2]
    return odds(np.hstack([surfaces, has_words(rows, words), before]), w)


def best_cut(y: np.ndarray, z: np.ndarray) -> float:
    """The log-odds that part the rows with the best F1 of those above which ``PRECISION`` of the rows are marked,
    halfway between two rows; 0 if there are none."""
    if y.min() == y.max():
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[np.cumsum(y) < PRECISION * np.arange(1, len(y) + 1)] = 0
    f1[:-1][z[:-1] == z[1:]] = 0  # equal log-odds cannot be parted
    at = int(np.argmax(f1))
    if not f1[at]:
        return 0.0
    return float((z[at] + z[min(at + 1, len(z) - 1)]) / 2)


def fit_chain(surfaces: np.ndarray, rows: list[np.ndarray], marks: np.ndarray, folds: np.ndarray) -> list:
    """(words, weights, cut) a category; what later ones see of earlier ones is out of fold."""
    models, before = [], np.zeros((len(rows), 0))
    for c in range(marks.shape[1]):
        y, out = marks[:, c].astype(float), np.zeros(len(rows))
        for f in range(FOLDS):
            rest, own = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(rest) and len(own):
                model = fit_one(surfaces[rest], [rows[i] for i in rest], before[rest], y[rest])
                out[own] = apply_one(model, surfaces[own], [rows[i] for i in own], before[own])
        models.append((*fit_one(surfaces, rows, before, y), best_cut(y, out)))
        before = np.hstack([before, out[:, None]])
    return models


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list:
    marks = [F.coalesce(F.max(m), F.lit(0)).alias(f"_m{i}") for i, m in enumerate(categories.values())]
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(*marks)
    known = known.select("doc_id", F.array(*[f"_m{i}" for i in range(len(marks))]).alias("marks"))
    n = known.count()
    nothing = [(np.zeros(0, np.int64), np.zeros(SIZE + c + 1), 0.0) for c in range(len(categories))]
    if not n:
        return nothing
    # At most about ``sample`` rows: a parameter bounds what is broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(known.where(share_of(n, sample, 3))), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("marks"), pa.array([surface(x).tobytes() for x in texts], pa.binary()), pa.array([buckets(x).astype("<i4").tobytes() for x in texts], pa.binary())],
                ["doc_id", "marks", "x", "words"],
            )

    rows = written(texts.select("doc_id", "marks", "text").mapInArrow(featured, "doc_id long, marks array<int>, x binary, words binary"), "toxicity-sample")

    def fitted(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "x", "words"], ignore_index=True)
        surfaces = np.frombuffer(b"".join(df["x"]), np.float32).reshape(len(df), SIZE)
        models = fit_chain(surfaces, [np.frombuffer(x, "<i4") for x in df["words"]], np.array(df["marks"].tolist()), fold_of(df["doc_id"]))
        return pd.DataFrame({"c": range(len(models)), "words": [m[0].tolist() for m in models], "w": [m[1].tolist() for m in models], "cut": [m[2] for m in models]})

    found = rows.groupBy(F.lit(1).alias("_all")).applyInPandas(fitted, "c int, words array<long>, w array<double>, cut double").collect()
    drop_written(rows)
    return [(np.array(r["words"], np.int64), np.array(r["w"]), r["cut"]) for r in sorted(found, key=lambda r: r["c"])] or nothing


def fold_of(doc_ids) -> np.ndarray:
    """A document's fold, by a hash of its id, so that no pattern in the ids makes a fold empty."""
    return np.array([zlib.crc32(f"fold {int(k)}".encode()) % FOLDS for k in doc_ids])


def score(docs: DataFrame, models: list, names: list[str]) -> DataFrame:
    """doc_id, p_<category> and is_<category> (from its cut on) of every document."""
    columns = [f"p_{n}" for n in names] + [f"is_{n}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[list] = [[] for _ in names]
            for a in range(0, len(texts), 512):
                some = texts[a : a + 512]
                surfaces, rows, before = np.stack([surface(x) for x in some]), [buckets(x) for x in some], np.zeros((len(some), 0))
                for c, model in enumerate(models):
                    z = apply_one(model, surfaces, rows, before)
                    before = np.hstack([before, z[:, None]])
                    found[c] += z.tolist()
            odds_of = [np.array(z, float) for z in found]
            p, marks = [pa.array(1 / (1 + np.exp(-z))) for z in odds_of], [pa.array((z >= m[2]).astype(np.int32)) for z, m in zip(odds_of, models)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *p, *marks], ["doc_id", *columns])

    kinds = ", ".join(f"{c} {'double' if c.startswith('p_') else 'int'}" for c in columns)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {kinds}")


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, held_out, the probability of each category, score (that of the last one) and predicted."""
    categories = categories or chain()
    scored = score(docs, learn(docs, labels, categories), list(categories))
    last = list(categories)[-1]
    return scored.select("doc_id", held_out().alias("held_out"), *[f"p_{n}" for n in categories], F.col(f"p_{last}").alias("score"), F.col(f"is_{last}").alias("predicted"))
