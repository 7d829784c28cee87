"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

A linear model g over the surface of a text minimises

    p R+(g; positives) + max(0, R-(g; unlabelled) - p R-(g; positives))

with the logistic loss. Where the second part falls below zero, the step goes against its gradient, as
the method asks. Positives are trusted (label 1); unlabelled text is text of the corpus whatever its label.
No label but 1 is ever looked at.

The class prior p is estimated from positives and unlabelled text: a first model, fitted on half of both,
ranks the other half of the positives and all documents that it has not seen. Above a threshold c lies a share
q_p(c) of the positives and q_u(c) of the documents, and if only positives reach c, q_u / q_p is the prior. The
threshold with the least upper confidence bound of that ratio gives it, less two standard errors: a prior too
high holds the risk's second part below zero and the model back, one a little too low costs next to nothing.

Rows whose crc32(doc_id) mod 3 is 1 are held out: neither their labels nor their texts are learned from.
A fit sees about ``POSITIVES`` labelled rows and ``UNLABELLED`` others, picked by a hash of doc_id, both
parameters; the prior is a statistic of all documents; scoring sees every row, and no input but its text.

Defined results: a null text is scored as an empty one; a null doc_id counts as the text ``null`` in the
remainder and carries no label; a document with several labels is a positive if all of them are 1; without
positives every score is 0.5; an empty table gives no rows. Columns other than those named are ignored by
``classify`` and kept by ``accepted``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_written, written
from .surface import SIZE, surface

POSITIVES = 8_000
UNLABELLED = 16_000
STEPS = 600
BINS = 4096
REACH = 24.0
DELTA, GAMMA = 0.1, 0.01


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def share_of(rows: int, most: int, salt: int):
    """True for about ``most`` of ``rows`` rows, by a hash of doc_id."""
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(1, rows)) * (1 << 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias; Adam on whole batches."""
    add = lambda x: np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    p, u = add(positive), add(unlabelled)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    mass = np.append(np.ones(p.shape[1] - 1), 0)
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-(p @ w))), 1 / (1 + np.exp(-(u @ w)))
        loss = lambda s: -np.log(np.maximum(1e-12, 1 - s)).mean()
        rest = loss(su) - prior * loss(sp)
        of_rest = su @ u / len(u) - prior * (sp @ p) / len(p)
        grad = prior * ((sp - 1) @ p) / len(p) + of_rest if rest >= 0 else -of_rest
        grad = grad + decay * mass * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def bins_of(z: np.ndarray) -> np.ndarray:
    """Bins of log-odds, between -REACH and REACH."""
    return np.clip((z + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def prior_of(positives: np.ndarray, documents: np.ndarray) -> float:
    """The class prior from counts of held-back positives and of documents by bin of their log-odds."""
    n_p, n_u = positives.sum(), documents.sum()
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = np.cumsum(positives[::-1]) / n_p, np.cumsum(documents[::-1]) / n_u
    q_p, q_u = q_p[q_p > 0], q_u[q_p > 0]
    doubt = (1 + GAMMA) * (np.sqrt(np.log(4 / DELTA) / (2 * n_u)) + np.sqrt(np.log(4 / DELTA) / (2 * n_p)))
    best = int(np.argmin((q_u + doubt) / q_p))
    prior = min(1.0, q_u[best] / q_p[best])
    return float(np.clip(prior - 2 * np.sqrt(prior * (1 - prior) * (1 / n_u + 1 / n_p)), 0.01, 0.99))


def log_odds(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    return np.array([float(surface(x) @ model[:-1]) for x in texts]) + model[-1]


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray:
    """The model: weights, one for each feature, and the bias."""
    docs = docs.select("doc_id", "text").where(~held_out())
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = known.count()
    if not good:
        return np.zeros(SIZE + 1)
    trusted = known.where(share_of(good, positives, 1)).select("doc_id", F.lit(True).alias("_positive"))
    half, drawn = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(2)) == 0, share_of(docs.count(), unlabelled, 2)
    # At most about ``positives`` ids: a parameter bounds what is broadcast.
    marked = docs.join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("_positive", F.lit(False)).alias("_positive"), drawn.alias("_unlabelled"), half.alias("_half"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [surface(x).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["x", "_positive", "_unlabelled", "_half"])

    sample = written(marked.where("_positive or _unlabelled").mapInArrow(featured, "x binary, _positive boolean, _unlabelled boolean, _half boolean"), "quality-sample")

    def read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_values("x", ignore_index=True)
        x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), SIZE)
        return x[rows["_positive"].to_numpy(bool)], x[rows["_unlabelled"].to_numpy(bool)]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        """A model of one half, and the other half's positives by bin."""
        p, u = read(rows[rows["_half"]])
        back = read(rows[~rows["_half"]])[0]
        w = fit(p, u, 0.5) if len(p) and len(u) else np.zeros(SIZE + 1)
        return pd.DataFrame({"w": [w.tolist()], "n": [np.bincount(bins_of(back @ w[:-1] + w[-1]), minlength=BINS).tolist()]})

    one = sample.groupBy(F.lit(1).alias("_all"))
    begun = one.applyInPandas(first, "w array<double>, n array<long>").first()
    if begun is None:
        return np.zeros(SIZE + 1)
    rough = np.array(begun["w"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += np.bincount(bins_of(log_odds(batch.column(0).to_pylist(), rough)), minlength=BINS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bin", "n"])

    rest = marked.where(~(F.col("_half") & (F.col("_positive") | F.col("_unlabelled")))).select("text").mapInArrow(counted, "bin long, n long")
    documents = np.zeros(BINS, np.int64)
    for row in rest.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        documents[row["bin"]] = row["n"]
    prior = prior_of(np.array(begun["n"]), documents)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        p, u = read(rows)
        return pd.DataFrame({"w": [(fit(p, u, prior) if len(p) and len(u) else np.zeros(SIZE + 1)).tolist()]})

    model = np.array(one.applyInPandas(fitted, "w array<double>").first()["w"])
    drop_written(sample)
    return model


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """All columns of ``docs`` that the caller selects beside text, and ``score`` in place of text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = log_odds(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*rest, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = log_odds(batch.column("text").to_pylist(), model)
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
