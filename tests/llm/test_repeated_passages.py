import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quietlog.llm import registry, repeated_passages
from tests.llm.rows import docs

SF = "/root/testdata/sf0.001"


def slow(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) per text."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def got(frame):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect())


def expected(ids, texts, length):
    return sorted((i is not None, i or 0, *row) for i, row in zip(ids, slow(texts, length)))


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 7)))
    words = [word() for _ in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passages = [say(length // 3) for _ in range(6)] + ["=" * length * 3, "ab" * length, "line of text\n" * (length // 4)]
    texts = [None, "", "x" * (length - 1), "y" * length, "z" * (length + 1)]
    for _ in range(60):
        parts = [say(rng.randrange(1, 30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:a + rng.choice([length - 2, length - 1, length, length + 1, 2 * length])], say(rng.randrange(0, 20))]
        texts.append(rng.choice([" ", ""]).join(parts))
    texts += [texts[7]] * 4 + [texts[8], texts[8][:-1] + "!", "!" + texts[9], texts[9][:len(texts[9]) // 2] + "?" + texts[9][len(texts[9]) // 2:]]
    texts.append(say(4000))
    texts.append(texts[-1][5:9000] + say(50) + texts[-1][:300])
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("length, phrase", [(16, 6), (40, 12), (120, 40), (33, 1000)])
def test_by_brute_force(spark, monkeypatch, length, phrase):
    monkeypatch.setattr(repeated_passages, "PHRASE", phrase)
    texts = corpus(length, length)
    ids = [None if i == 3 else i % (len(texts) - 5) for i in range(len(texts))]
    frame = docs(spark, texts, ids, extra=["digest", "body", "c", "first", "kept"])
    assert got(repeated_passages.report(frame, length)) == expected(ids, texts, length)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(registry.queries()["op12_repeated_passages"](spark, SF)) == expected(
        [r["doc_id"] for r in rows], [r["text"] for r in rows], 400)


def test_empty_table(spark):
    assert repeated_passages.report(docs(spark, [])).count() == 0


def test_kept_bytes(spark):
    shared = "".join(random.Random(1).choices("abcdefgh ", k=500))
    rows = repeated_passages.cut_texts(docs(spark, ["one " + shared + " end", "two " + shared, "three"])).collect()
    assert sorted(bytes(r["kept"]) for r in rows) == [b"one end", b"two"] or sorted(bytes(r["kept"]) for r in rows) == [b"one  end", b"two "]
    assert all(r["n_spans"] == 1 for r in rows)


def test_anchors_of_equal_strings_agree():
    rng = random.Random(2)
    shared = bytes(rng.choices(range(97, 103), k=60))
    one, two = (bytes(rng.choices(range(97, 103), k=rng.randrange(9))) + shared + bytes(rng.choices(range(97, 103), k=9)) for _ in range(2))
    found = []
    for text in (one, two):
        _, first, last, digests = repeated_passages.anchors([text], 40)
        at = text.find(shared)
        found.append([d for w in range(at, at + 21) for a, b, d in zip(first, last, digests) if a <= w <= b])
    assert found[0] == found[1] and len(found[0]) == 21


def test_runs_whose_phrases_occur_once_are_not_compared(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    # Shorter than a string, so it makes candidates and no repeated string; the longer one is repeated.
    short, long = say(390), say(900)
    texts = [say(500) + short + say(500) for _ in range(4)] + [say(200) + long + say(200) for _ in range(2)]
    candidates = repeated_passages._candidates(repeated_passages._prepared(docs(spark, texts)), 400)
    rows = repeated_passages._members(candidates, 400).where("inner is not null").collect()
    weight = Counter()
    for r in rows:
        weight[r["inner"]] += r["weight"]
    assert rows and min(weight.values()) > 1
    assert candidates.count() == 6
    assert got(repeated_passages.report(docs(spark, texts))) == expected(range(len(texts)), texts, 400)
