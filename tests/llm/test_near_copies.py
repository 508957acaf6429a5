import random

import numpy as np

from quietlog.llm import fingerprints, near_copies
from tests.llm.rows import docs, jobs


def slow_sets(texts):
    each = [(t or "").lower().split() for t in texts]
    return [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in each]


def slow_groups(texts):
    sets = slow_sets(texts)
    similar = lambda a, b: a == b or len(a & b) / len(a | b) >= 0.8
    label, changed = list(range(len(texts))), True
    near = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "ONE  two", "a b c d e", "a b c d f"]
    for n in (6, 9, 14, 30, 60, 200, 400):
        for _ in range(4):
            base = rng.choices(words, k=n)
            texts.append(" ".join(base))
            for _ in range(5):  # edits that leave the similarity on either side of 0.8, chains among them
                base = list(base)
                for _ in range(rng.choice([1, 1, max(1, n // 45), max(1, n // 25)])):
                    base[rng.choice([0, len(base) - 1, rng.randrange(len(base))])] = rng.choice(words)
                texts.append(" ".join(base + rng.choices(words, k=rng.choice([0, 1, n // 8]))))
    line = " ".join(rng.choices(words, k=40))  # a passage that many dissimilar documents have
    texts += [line + " " + " ".join(rng.choices(words, k=rng.choice([5, 12, 60]))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_groups_by_brute_force(spark, monkeypatch):
    texts = corpus()
    expected = dict(enumerate(slow_groups(texts)))
    assert 40 < len(set(expected.values())) < len(texts) - 40
    for block in (1024, 3):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts)).collect()} == expected
    kept = {r["doc_id"] for r in fingerprints.deduplicated(docs(spark, texts)).collect()}
    assert kept == set(expected.values())


def test_all_pairs_are_checked_without_leaders(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_led", lambda shared, similarity: shared.selectExpr("node as u", "node as v").where("false"))
    texts = corpus()
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts)).collect()}
    assert found == dict(enumerate(slow_groups(texts)))


def variants(size):
    """Copies of one text with a few words changed at places of their own: many pairs lie just under the similarity."""
    rng = random.Random(11)
    base = [f"v{i}" for i in range(150)]
    made = []
    for k in range(size):
        text = list(base)
        for place in rng.sample(range(150), rng.choice([1, 2, 3])):
            text[place] = f"x{k}"
        made.append(" ".join(text))
    return made


def test_fingerprints_propose_pairs_first(spark, monkeypatch):
    asked = []
    links = fingerprints.links
    monkeypatch.setattr(fingerprints, "links", lambda frame: asked.append(frame.count()) or links(frame))
    texts = corpus()
    kept = {r["doc_id"] for r in fingerprints.deduplicated(docs(spark, texts)).collect()}
    assert kept == set(slow_groups(texts))
    assert len(asked) == 1 and asked[0] > 40


def test_a_large_group_of_near_copies_takes_few_pairs_a_member(spark, monkeypatch):
    texts = variants(300) + corpus()
    expected = dict(enumerate(slow_groups(texts)))
    checked = []
    check = near_copies._checked
    monkeypatch.setattr(near_copies, "_checked", lambda pairs, *rest: checked.append(pairs.count()) or check(pairs, *rest))
    for nearest in (3, 1):
        monkeypatch.setattr(near_copies, "NEAREST", nearest)
        checked.clear()
        assert {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts)).collect()} == expected
        assert sum(checked[1:]) < 20 * len(texts)  # all pairs of the group are 44,850


def test_common_shingles_come_last_however_they_are_spread(spark, monkeypatch):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"own{rng.random()}" for _ in range(60)) + " " + passage for _ in range(64)]  # four to a task
    shared = []
    make = near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda *args: shared.append(make(*args)) or shared[-1])
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts).repartition(16)).collect()}
    assert found == dict(enumerate(slow_groups(texts)))
    assert shared[0].count() == 0


def test_later_rounds_visit_only_shingles_that_had_more(spark, monkeypatch):
    texts = variants(120) + corpus()
    visited = []
    visit = near_copies._open
    monkeypatch.setattr(near_copies, "_open", lambda shared, *rest: visited.append(shared.select("token").distinct().count()) or visit(shared, *rest))
    monkeypatch.setattr(near_copies, "NEAREST", 1)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts)).collect()}
    assert found == dict(enumerate(slow_groups(texts)))
    assert len(visited) > 1 and visited[1] < visited[0] / 2


def test_jobs_do_not_grow_with_partitions(spark):
    texts = corpus()[:120]
    expected = dict(enumerate(slow_groups(texts)))
    counts = []
    for parts in (4, 48):
        rows, n = jobs(spark, parts, lambda: near_copies.groups(docs(spark, texts)).collect())
        assert {r["doc_id"]: r["component_id"] for r in rows} == expected
        counts.append(n)
    assert 0 < counts[1] < counts[0] + 30


def test_marks_of_wanted_texts(spark):
    marks = [0, 1, 7, 8, 32767, 32768, near_copies.MARKS - 1, near_copies.MARKS + 5, -1, -2, -(1 << 63), 5]
    bits = near_copies._wanted(spark.createDataFrame([(m,) for m in marks], "mark long"))
    found = np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()
    assert len(bits) == near_copies.MARKS >> 3 and found == sorted({m % near_copies.MARKS for m in marks})
    assert not near_copies._wanted(spark.createDataFrame([], "mark long")).any()


def test_later_rounds_join_groups_by_new_links_alone(spark, monkeypatch):
    texts = variants(120) + corpus()
    walked = []
    walk = near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda links, *rest: walked.append(links.where("u <> v").count()) or walk(links, *rest))
    monkeypatch.setattr(near_copies, "NEAREST", 1)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.groups(docs(spark, texts)).collect()}
    assert found == dict(enumerate(slow_groups(texts)))
    assert len(walked) > 2 and walked[-1] < walked[0] / 2
