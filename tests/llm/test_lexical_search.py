import math
import random
import re
from collections import Counter

from quietlog.llm import lexical_search
from tests.llm.rows import docs

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(rows, items):
    """Rows (item_id, rank, doc_id, score), item by item."""
    bags = [(i, Counter(words(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    whole = sum(b.total() for _, b in bags)
    out = []
    for item_id, text in items:
        found = []
        for i, b in bags:
            m = 50 + 50 * b.total() * len(bags) // whole
            score = 0
            for t in set(words(text)):
                df = sum(t in other for _, other in bags)
                weight = math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df + 1)))
                score += weight * (10**9 * b[t] // (1000 * b[t] + 20 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        found.sort()
        out += [(item_id, rank, f[3], -f[0]) for rank, f in enumerate(found[:50], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def corpus():
    rng = random.Random(3)
    common = [f"w{i}" for i in range(30)]
    texts = [None, "", " -- ", "É é ß w1", "W1 w1-w2_w3", "x" * 5000 + " w2", " ".join(rng.choices(common, k=20_000))]
    texts += [" ".join(rng.choices(common, k=rng.choice([2, 5, 9]))) for _ in range(150)]
    texts += ["w4 w5 w4"] * 70 + ["w5 w4\tW4"] * 30  # one class of a hundred
    texts += ["w4 w5 w4 other words here"] * 5
    rng.shuffle(texts)
    items = [(1, "w4 w5"), (2, "w1 w2 W2 absent"), (3, None), (4, "nothing of it"), (4, "w9"), (5, "é"), (None, "w7 w8")]
    return texts, items


def test_ranks_by_brute_force(spark, monkeypatch):
    texts, items = corpus()
    ids = [i % 200 - 3 for i in range(len(texts))]  # repeated ids
    ids[7] = ids[9] = None
    expected = slow(list(zip(ids, texts)), items)
    frame = docs(spark, texts, ids, extra=["score", "m", "bag", "class", "item_id"])
    for terms in (200_000, 2):
        monkeypatch.setattr(lexical_search, "BLOCK_TERMS", terms)
        monkeypatch.setattr(lexical_search, "_STEP_CELLS", 40 if terms == 2 else 2 << 20)
        assert got(lexical_search.search(frame, table(spark, items).selectExpr("*", "1 as doc_id", "2 as rank"))) == expected


def test_empty_tables(spark):
    texts, items = corpus()
    assert lexical_search.search(docs(spark, []), table(spark, items)).count() == 0
    assert lexical_search.search(docs(spark, texts), table(spark, [])).count() == 0
    assert lexical_search.search(docs(spark, [None, "", "- -"]), table(spark, items)).count() == 0


def test_classes_are_scored_once(spark):
    texts = ["a b", "B a", "b, a c d"] * 40
    bags = lexical_search._bags(docs(spark, texts), {b"a": 0, b"b": 1})
    rows = lexical_search._classes(bags, 120, 320).collect()
    assert len(rows) == 2 and sorted(len(r["members"]) for r in rows) == [40, 50]
    assert [m["doc_id"] for m in max(rows, key=lambda r: len(r["members"]))["members"]] == [i for i in range(120) if i % 3 < 2][:50]
