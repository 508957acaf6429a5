"""Quality classifier from positive and unlabelled texts.

Trusted positives are documents labelled good; the unlabelled sample is web text, good or bad.  A
linear model minimises the non-negative unbiased risk (Kiryo et al., 2017) with a class
prior estimated from the data.  Features are character and word statistics of the whole text.
"""

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import let_go, slices, texts

#: At most so many rows of each kind are learnt from, those of smallest hash.
SAMPLE_ROWS = 6_000
#: Parts in which they come to the driver.
PARTS = 8
CHUNK_BYTES = 1 << 20
THRESHOLD = 0.3

# Classes of bytes: 0 other, 1 space, 2 line end, 3 small letter, 4 capital, 5 digit, 6 sentence mark,
# 7 quote or bracket, 8 other sign, 9 first byte of a longer character, 10 byte inside one
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:?!"]] = 6
_CLASS[[ord(c) for c in "\"'()[]{}<>"]] = 7
_CLASS[[ord(c) for c in "#$%&*+-/=@\\^_`|~"]] = 8
_CLASS[192:] = 9
_CLASS[128:192] = 10
_CLASSES = 11
#: Pairs of neighbouring classes besides the classes themselves, and six figures of size and repetition.
FEATURES = _CLASSES + _CLASSES * _CLASSES + 6


def features(items: list[str]) -> np.ndarray:
    """One row per text; empty texts have zeros."""
    raw = [t.encode("utf-8", "surrogatepass") for t in items]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    rows = np.zeros((len(raw), FEATURES))
    if not sizes.sum():
        return rows
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    n = np.maximum(sizes, 1)[:, None]
    single = np.bincount(owner * _CLASSES + kinds, minlength=len(raw) * _CLASSES).reshape(len(raw), -1)
    same = owner[1:] == owner[:-1]
    code = owner[1:] * (_CLASSES * _CLASSES) + kinds[:-1] * _CLASSES + kinds[1:]
    pair = np.bincount(code[same], minlength=len(raw) * _CLASSES * _CLASSES).reshape(len(raw), -1)
    rows[:, :_CLASSES] = single / n
    rows[:, _CLASSES:-6] = pair / n
    rows[:, -6] = np.log1p(sizes)
    rows[:, -5] = (single[:, 1] + single[:, 2] + 1) / n[:, 0]
    rows[:, -4] = np.log1p(single[:, 2])
    for row, text in zip(rows, raw):
        own, lines = text.split(), text.split(b"\n")
        row[-3] = sum(map(eq, own, own[1:])) / max(1, len(own))  # words that repeat the one before
        row[-2] = np.log1p(len(set(own))) / np.log1p(max(1, len(own)))
        row[-1] = len(set(lines)) / len(lines)
    return np.sqrt(np.maximum(rows, 0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = bent(rows, self.mean, self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bent(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in deviations of the positives, and how far each lies above and below what is usual there."""
    z = (rows - mean) / scale
    return np.concatenate([np.clip(z, -2, 2), np.log1p(np.maximum(z - 1, 0)), np.log1p(np.maximum(-z - 1, 0))], axis=1)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows.

    Scores of a model that tells positives from unlabelled rows; the prior is the smallest ratio of the
    unlabelled share to the positive share above a score (Blum and Scott), each with two of its
    standard errors added, over scores that half of the positives reach.
    """
    grid = np.quantile(positive, np.linspace(0, 0.5, 51))
    above = lambda x: 1 - np.searchsorted(np.sort(x), grid, "left") / len(x)
    a, u = above(positive), np.maximum(above(unlabelled), 1 / len(unlabelled))
    error = np.sqrt((1 - u) / (u * len(unlabelled)) + (1 - a) / (a * len(positive)))
    return float(np.clip((u / a * (1 + 2 * error)).min(), 0.05, 0.98))


def _fit_logistic(x, y, w, steps=300, rate=0.05, ridge=1e-3):
    """Weighted logistic regression by Adam on whole arrays."""
    return _adam(lambda z: w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y), x, steps, rate, ridge)


def _adam(slope, x, steps, rate, ridge):
    weights = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = slope(x @ weights[:-1] + weights[-1])
        grad = np.append(x.T @ g + ridge * weights[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        weights -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return weights


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative risk prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic loss."""
    mean, scale = positive.mean(axis=0), np.maximum(positive.std(axis=0), 1e-3)
    p, u = bent(positive, mean, scale), bent(unlabelled, mean, scale)
    if prior is None:
        half = len(p) // 2, len(u) // 2  # the prior is read off rows that the telling model has not seen
        x = np.concatenate([p[:half[0]], u[:half[1]]])
        y = np.concatenate([np.ones(half[0]), np.zeros(half[1])])
        w = np.concatenate([np.full(half[0], 0.5 / max(1, half[0])), np.full(half[1], 0.5 / max(1, half[1]))])
        told = _fit_logistic(x, y, w)
        prior = estimated_prior(p[half[0]:] @ told[:-1], u[half[1]:] @ told[:-1])
    x = np.concatenate([p, u])
    n, m = len(p), len(u)

    def slope(z):
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # loss of calling positive: -log s; negative: -log(1 - s)
        below = -np.log(np.maximum(1 - s, 1e-12))
        negative = below[n:].mean() - prior * below[:n].mean()
        g = np.empty_like(z)
        if negative >= 0:
            g[:n] = prior / n * (s[:n] - 1) - prior / n * s[:n]
            g[n:] = s[n:] / m
        else:  # the negative part has gone below its bound: step back along it alone
            g[:n] = prior / n * s[:n]
            g[n:] = -s[n:] / m
        return g

    fitted = _adam(slope, x, 1500, 0.05, 1e-4)
    return Model(mean, scale, fitted[:-1], float(fitted[-1]), prior)


def _texts_of(rows: DataFrame, ids: DataFrame) -> list[str]:
    """Texts of the sampled ``ids``, one each: of repeated rows the smallest text."""
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return [r["text"] for r in sorted(found.coalesce(PARTS).toLocalIterator(), key=lambda r: r["doc_id"])]  # a job for each


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` positives and as many unlabelled texts, all outside the held-out fifth.

    Documents whose crc32(doc_id) mod 5 is 0 are neither positives nor unlabelled rows; null doc_ids take no
    part.  Repeated or contradicting labels of a document: it is trusted only if all are 1.  Without any trusted
    positive the model scores 0.5 everywhere.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & fold)
    trusted = labels.select(F.col("doc_id").cast("long"), "quality").where(F.col("doc_id").isNotNull() & fold & F.col("quality").isNotNull())
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    # which positives: decided on the narrow label table, then only their texts are read
    named = trusted.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows)
    positive = _texts_of(rows, named)
    web = rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows)
    unlabelled = _texts_of(rows, web.distinct())
    if not positive or not unlabelled:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 * FEATURES), 0.0, 0.5)
    return train(*(np.concatenate([features(x[i:i + 100]) for i in range(0, len(x), 100)]) for x in (positive, unlabelled)))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row; a null text is an empty one, held_out of a null doc_id false."""
    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            score = model.score(features(texts(batch)))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            held = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold, all columns as they are."""
    def run(batches):
        let_go()
        for batch in slices(batches, CHUNK_BYTES):
            yield batch.filter(pa.array(model.score(features(texts(batch))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
