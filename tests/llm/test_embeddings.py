import math
import random

import numpy as np
import pytest

from quietlog.llm import embeddings as e


def slow(vectors):
    """(links, component) by comparing every pair; ``vectors`` is a list of (vec_id, list or None)."""
    good = [v is not None and len(v) and None not in v and all(math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    n, label = [0] * len(vectors), list(range(len(vectors)))
    linked = []
    for i in range(len(vectors)):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = (np.array(v, float) / max(map(abs, v)) for v in (vectors[i][1], vectors[j][1]))
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.9:
                    linked.append((i, j))
                    n[i] += 1
                    n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    ids = {}
    for k, (vec_id, _) in enumerate(vectors):
        if vec_id is not None:
            ids[label[k]] = min(ids.get(label[k], vec_id), vec_id)
    return sorted((str(v[0]), c, str(ids.get(label[k]))) for k, (v, c) in enumerate(zip(vectors, n)))


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, label int, key int").repartition(5)


def got(result):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in result.collect())


@pytest.mark.parametrize("block,window", [(2048, 512), (40, 60)])
def test_against_brute_force(spark, monkeypatch, block, window):
    monkeypatch.setattr(e, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((6, 16))
    spread = [0.02, 0.1, 0.3, 0.4, 0.5, 2.0]  # from tight balls to loose chains
    vectors = [(1000 + i * 60 + k, (centres[i] + spread[i] * rng.standard_normal(16)).tolist()) for i in range(6) for k in range(60)]
    vectors += [(5, centres[0].tolist()), (6, (centres[0] * 3).tolist()), (6, centres[0].tolist()), (7, None), (8, []), (9, [0.0] * 16), (10, [1.0, None] * 8),
                (11, [math.nan] * 16), (12, [math.inf] * 16), (None, centres[1].tolist()), (13, [1e200] * 16), (14, [1e-200] * 16), (15, [1.0] * 16), (16, [1.0] * 4)]
    random.Random(1).shuffle(vectors)
    result = e.near_duplicates(frame(spark, vectors), window=window, recall=0.99999)
    have, want = got(result), slow(vectors)
    if block == 2048:
        assert have == want
    else:  # small windows may miss pairs at the threshold, never add one
        assert len(have) == len(want) and all(h[1] <= w[1] for h, w in zip(have, want))
        assert sum(h[1] for h in have) >= 0.97 * sum(w[1] for w in want)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in result.collect())


def test_pairs_at_the_threshold_and_empty_table(spark):
    a, b = [1.0, 0.0], [0.9, math.sqrt(1 - 0.81)]
    vectors = [(1, a), (2, b), (3, [0.0, 1.0])]
    assert got(e.near_duplicates(frame(spark, vectors))) == slow(vectors)
    assert e.near_duplicates(frame(spark, []).where("false")).count() == 0


def test_passes_grow_with_the_count():
    assert e.passes_for(10) <= e.passes_for(10**5) < e.passes_for(10**8) < 400


def test_open_pairs_of_large_balls_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(e, "CHUNK", 40)
    pairs = spark.createDataFrame([(1, 2, False), (1, 3, False)], "a long, b long, sure boolean")
    members = spark.createDataFrame([(r, 1 if r < 500 else 2 if r < 1100 else 3) for r in range(1101)], "row long, ball long")
    sizes = spark.createDataFrame([(1, 500), (2, 600), (3, 1)], "ball long, size long")
    groups = {}
    for r in e._chunked(pairs, members, sizes).collect():
        groups.setdefault((r["a"], r["b"], r["left"], r["right"]), {}).setdefault(r["ball"], []).append(r["row"])
    assert max(len(rows) for sides in groups.values() for rows in sides.values()) < 3 * 40
    met = [(x, y) for (a, b, _, _), sides in groups.items() for x in sides.get(a, ()) for y in sides.get(b, ())]
    assert len(met) == len(set(met)) == 500 * 600 + 500
    # two groups of near copies whose balls are open
    rng = np.random.default_rng(3)
    first, second = np.eye(16)[0], np.eye(16)[0] * math.cos(0.5) + np.eye(16)[1] * math.sin(0.5)
    vectors = [(k, ((first if k % 2 else second) + 0.03 * rng.standard_normal(16)).tolist()) for k in range(400)]
    assert got(e.near_duplicates(frame(spark, vectors))) == slow(vectors)


def test_passes_are_for_the_widest_open_pair_of_balls(spark, monkeypatch):
    angle = math.acos(0.9)
    asked = []
    count = e.passes_for
    monkeypatch.setattr(e, "passes_for", lambda n, cosine, *rest: asked.append(cosine) or count(n, cosine, *rest))
    for radii, wide in (([0.0, 0.0, 0.0], angle), ([0.1, 0.05, 0.2], angle + 0.3)):
        balls = spark.createDataFrame([(k, np.eye(4)[k].tobytes(), r) for k, r in enumerate(radii)], "ball long, centre binary, radius double")
        e._candidates(balls, 0.9, 512, 0.99)
        assert math.isclose(asked.pop(), math.cos(wide))
    rng = np.random.default_rng(6)
    radius, n = angle / 2, 20_000  # centres of open pairs stand up to twice the angle apart
    x = e._unit(rng.standard_normal((n, 32)))
    away = rng.standard_normal((200, 32))
    away = e._unit(away - (away * x[:200]).sum(axis=1, keepdims=True) * x[:200])
    x[200:400] = x[:200] * math.cos(1.9 * angle) + away * math.sin(1.9 * angle)
    met = np.zeros(200, bool)
    for p in range(count(n, e._open_cosine(0.9, [radius, radius]), 512)):
        place = np.empty(n, np.int64)
        place[np.argsort(e._keys(x, p), kind="stable")] = np.arange(n)
        met |= np.abs(place[:200] - place[200:400]) <= 512
    assert met.mean() >= 0.97
