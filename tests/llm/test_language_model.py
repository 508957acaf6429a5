import collections
import math
import random
import zlib

import numpy as np
import pytest

from quietlog.llm import language_model as m
from tests.llm.rows import docs


def words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


class Slow:
    def __init__(self, rows):
        self.one, self.two = collections.Counter(), collections.defaultdict(collections.Counter)
        for doc_id, text in rows:
            if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
                own = words(text)
                self.one.update(own)
                for h, w in zip([b"\n", *own], own):
                    self.two[h][w] += 1
        counts = lambda values: [0, *(sum(v == r for v in values) for r in range(1, m.DISCOUNTED + 2))]
        self.words = m.Words.of(sum(self.one.values()), len(self.one), counts(list(self.one.values())))
        self.discount = m.discounts(counts([c for f in self.two.values() for c in f.values()]))

    def single(self, w):
        return float(self.words.probability(np.array([self.one[w]]))[0])

    def chance(self, h, w):
        if h not in self.two:
            return self.single(w)
        follow = self.two[h]
        left = sum((1 - self.discount[c]) * c for c in follow.values() if c <= m.DISCOUNTED)
        divisor = sum(follow.values()) + (left <= 0)
        if follow[w]:
            return (self.discount[follow[w]] if follow[w] <= m.DISCOUNTED else 1) * follow[w] / divisor
        return (left if left > 0 else 1) / divisor / (1 - sum(self.single(x) for x in follow if follow[x])) * self.single(w)


@pytest.mark.parametrize("block,bucket", [(2_000_000, 3_000_000), (300, 500)])
def test_against_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(m, "BLOCK_TOKENS", block)
    monkeypatch.setattr(m, "BUCKET_TOKENS", bucket)
    rng = random.Random(8)
    vocabulary = ["the"] * 60 + [f"w{i}" for i in range(80)] + ["É", "The"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 60]))) + rng.choice(["", f" only{i}"]) for i in range(120)]
    texts += [None, "", "the " * 5000]
    ids = [*range(len(texts) - 2), None, 3]
    rows = list(zip(ids, texts))
    slow = Slow(rows)
    got = m.scores(docs(spark, texts, ids, extra=["block", "score"])).collect()
    expected = []
    for doc_id, text in rows:
        own = words(text)
        expected.append((str(doc_id), doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2, len(own), sum(w in slow.one for w in own),
                         slow.words.total, sum(math.log10((slow.one[w] + 1) / (slow.words.total + slow.words.distinct + 1)) for w in own),
                         sum(math.log10(slow.chance(h, w)) for h, w in zip([b"\n", *own], own))))
    have = sorted((str(r[0]), *r[1:]) for r in got)
    for a, b in zip(have, sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    # exactly normalised: the chances behind a history, with one unknown word, add up to one
    for h in [b"\n", b"the", b"w1", b"nowhere"]:
        assert sum(slow.chance(h, w) for w in [*slow.one, b"unknown word"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    assert m.scores(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = m.scores(docs(spark, ["a b"], [held])).first()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_discounts_lie_between_zero_and_one():
    rng = random.Random(9)
    for _ in range(200):
        d = m.discounts([0, *(rng.choice([0, 1, 5, 100, 10_000]) for _ in range(m.DISCOUNTED + 1))])
        assert all(0 < x < 1 for x in d[1:])
    falling = m.discounts([0, 1000, 400, 220, 140, 100, 75])
    assert list(falling[1:]) == sorted(falling[1:])
