import random

import numpy as np
import xxhash

from quietlog.llm import fingerprints
from quietlog.llm.common import components
from tests.llm.rows import by_id, docs


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_components_by_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("ab cd ef Gh ÄÖ ß\u00a0x 12".split(" ")) for _ in range(rng.choice([1, 2, 3, 40, 400]))) for _ in range(40)]
    texts = [*base, *base[:10], *(b + " tail" for b in base), None, "", " \t\n", "one", "ONE", "x" * 100_000, "word " * 70_000]
    got = by_id(fingerprints.near_duplicates(docs(spark, texts, extra=["fingerprint", "component_id", "bits"])))
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r[0]["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r[0]["component_id"] for i, r in got.items()} == slow_components(prints)


def test_links_of_sparse_and_of_crowded_cells(spark, monkeypatch):
    rng = random.Random(4)
    start = rng.getrandbits(64)
    values = {start, 0, (1 << 64) - 1}
    for _ in range(300):
        v = rng.choice(list(values))
        for _ in range(rng.choice([1, 2, 3])):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame(
        list(zip(values.view(np.int64).tolist(), fingerprints.cell_of(values).view(np.int64).tolist(), range(len(values)))),
        "bits long, cell long, node long")
    expected = slow_components(dict(enumerate(values.tolist())))
    for limit in (512, 2):  # with 2 nearly every cell is overfull
        monkeypatch.setattr(fingerprints, "CELL_PAIRS", limit)
        found = {r["node"]: r["component"] for r in components(fingerprints.links(frame)).collect()}
        assert {i: found.get(i, i) for i in expected} == expected


def test_nulls_repeats_and_empty_tables(spark):
    frame = docs(spark, ["a b c d", "a b c d", "a b c d", None, "q r s t"], ids=[5, 5, None, 7, None])
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in fingerprints.near_duplicates(frame).collect())
    assert rows == [("5", "5"), ("5", "5"), ("7", "7"), ("None", "5"), ("None", "None")]
    kept = fingerprints.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "None", "None"]
    assert fingerprints.near_duplicates(docs(spark, [])).count() == 0
    assert fingerprints.deduplicated(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4), (9, 7), (9, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}
