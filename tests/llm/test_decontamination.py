import random

from quietlog.llm import decontamination as d
from tests.llm.rows import by_id, docs


def slow(text, items, window):
    words = d.words(text or "")
    hit, found = set(), set()
    for item, t in items:
        own = d.words(t or "")
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i:i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j:j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted((x for x in found if x is not None), key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 500)
    rng = random.Random(7)
    for window in (2, 3, 13):
        draw = lambda n: " ".join(rng.choice(["a", "B", "b", "é", "c-d", "zz", "9"]) for _ in range(n))
        items = [(i, draw(rng.choice([0, 1, 5, 14, 20]))) for i in range(12)] + [(None, "a b"), (3, "zz zz"), (20, None), (4, "--"), (10, "a é")]
        texts = [draw(rng.choice([0, 1, 5, 40, 200])) for _ in range(30)] + [None, "", items[2][1], "x " + (items[3][1] or "") + " y"]
        got = by_id(d.judge(docs(spark, texts, extra=["spans", "n_hit"]), benchmark(spark, items), window))
        for i, text in enumerate(texts):
            n, hits, found = slow(text, items, window)
            row = got[i][0]
            assert (row["n_words"], row["n_hit"], row["items"]) == (n, hits, found)
            assert row["n_items"] == len(found) and row["contaminated"] == (hits > 0 and 20 * hits >= n)
            assert sum(s["end"] - s["start"] for s in row["spans"]) == hits


def test_rows_stay_or_go_by_their_own_text(spark):
    item = " ".join(f"w{i}" for i in range(13))
    texts = [item, "clean " * 50, item + " clean" * 300, None, item, "clean"]
    frame = docs(spark, texts, ids=[1, 1, 2, 3, None, None])
    kept = d.without_contaminated(frame, benchmark(spark, [(1, item)]))
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect() if r["text"]) == sorted(
        [("1", texts[1]), ("2", texts[2]), ("None", "clean")])
    assert kept.count() == 4
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.without_contaminated(frame, empty).count() == 6
    assert d.judge(docs(spark, []), benchmark(spark, [(1, item)])).count() == 0
