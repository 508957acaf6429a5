import random
import zlib

import numpy as np
import pytest

from quietlog.llm import quality
from tests.llm.rows import by_id, docs, jobs


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(300)]
    texts, good = [], []
    for _ in range(1500):
        own = rng.choices(words, k=rng.randint(30, 200))
        bad = rng.random() < 0.25
        texts.append(" ".join(w.upper() + "!!" for w in own) if bad else ". ".join(" ".join(own[i:i + 9]).capitalize() for i in range(0, len(own), 9)) + ".")
        good.append(0 if bad else 1)
    return texts, good


def test_held_out_accuracy_and_prior(spark, corpus):
    texts, good = corpus
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(good) if i % 2], "doc_id long, quality int, toxic int")
    frame = docs(spark, texts, extra=["score", "quality"])
    model = quality.fit(frame, labels)
    assert 0.65 < model.prior < 0.85
    rows = by_id(quality.scores(frame, model))
    held = [i for i in rows if rows[i][0]["held_out"]]
    assert set(held) == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([rows[i][0]["predicted"] == good[i] for i in held]) > 0.94
    assert all(rows[i][0]["predicted"] == int(rows[i][0]["score"] >= 0.3) for i in rows)
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i][0]["predicted"]}


def test_odd_rows(spark, corpus):
    texts, _ = corpus
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, None), (None, 1), (4, 1), (6, 1), (7, 1)], "doc_id long, quality int")
    frame = docs(spark, [*texts[:40], None, "", "x" * 200_000, texts[0]], [*range(42), None, 0])
    model = quality.fit(frame, labels)
    rows = quality.scores(frame, model).collect()
    assert len(rows) == 44 and all(0 <= r["score"] <= 1 for r in rows) and not [r for r in rows if r["doc_id"] is None][0]["held_out"]
    none = quality.fit(frame, labels.where("false"))
    assert {r["score"] for r in quality.scores(frame, none).collect()} == {0.5}
    assert quality.scores(docs(spark, []), quality.fit(docs(spark, []), labels)).count() == 0


def test_features_are_bounded():
    rows = quality.features(["", "A", "é" * 10, "a\n" * 1000, "\n"])
    assert rows.shape == (5, quality.FEATURES) and np.isfinite(rows).all() and not rows[0, :-6].any()


def test_jobs_do_not_grow_with_partitions(spark, corpus):
    texts, good = corpus
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id long, quality int")
    frame = docs(spark, texts[:300])
    (few, n), (many, m) = (jobs(spark, parts, lambda: quality.fit(frame, labels)) for parts in (4, 48))
    assert np.array_equal(few.weights, many.weights) and few.bias == many.bias and few.prior == many.prior
    assert 0 < m < n + 30
