import hashlib
import random
import re

from quietlog.llm import pii
from tests.llm.rows import by_id, docs


def slow(text):
    spans = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
            spans.append(("card", m.start(), m.end()))
    return spans + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_by_plain_patterns():
    rng = random.Random(0)
    for _ in range(20_000):
        signs = rng.choice(["a1@.-", "12. -+(", "0123456789 -", "a@.é 1٣"])
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == slow(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "a.b@" * 50_000):
        base = pii.base_spans(text)
        pii.contexts(text, [*base, *((None, a, b) for a, b in pii.candidates(text, base))])
    for text in ("1 " * 150_000, "1" + "(" * 300_000, "a1@x.org," * 30_000, "1(" * 150_000, "1 2345678 x " * 30_000):
        base = pii.base_spans(text)
        pii.contexts(text, [*base, *((None, a, b) for a, b in pii.candidates(text, base))])


def test_contexts_find_unseen_identifiers(spark):
    known = [f"please write mail to: u{i}@x{i}.org thanks" for i in range(9)]
    unseen = ["please write mail to: zoe9[at]home thanks", "version v12345 is out"]
    texts = [*known, *unseen, None, "", known[0]]
    frame = docs(spark, texts, extra=["spans", "row", "mark", "pii_mark", "pii_doc", "pii_spans"])
    rows = by_id(pii.detect(frame))
    assert [s["kind"] for s in rows[0][0]["spans"]] == ["email"] and not rows[0][0]["found"]
    found = rows[9][0]["found"]
    assert [(s["kind"], unseen[0][s["start"]:s["end"]]) for s in found] == [("email", "zoe9[at]home")]
    assert not any(rows[i][0]["found"] for i in (10, 11, 12))
    new = by_id(pii.redacted(frame))
    assert new[9][0]["text"] == "please write mail to: [EMAIL] thanks" and new[9][0]["n_chars"] == len(new[9][0]["text"])
    assert new[10][0]["text"] == unseen[1] and new[11][0]["text"] is None and new[12][0]["text"] == ""
    assert pii.redacted(frame).columns == frame.columns


def test_candidates_have_spaces_and_keep_apart():
    text = "call (988) 555-2485 or a1@x.org, id=(ab12c) in 1999 and 4111 1111 1111 1112."
    base = pii.base_spans(text)
    assert [text[a:b] for a, b in pii.candidates(text, base)] == ["(988) 555-2485", "ab12c", "4111 1111 1111 1112"]


def test_contexts_by_words_shapes_and_neighbours():
    text = "Mail User12: a1@x.org 10.0.0.1"
    assert pii.contexts(text, pii.base_spans(text)) == [
        ["user9: _", "user9: _ a9@a.a", "mail user9: _", "user9: _ | <ip>"],
        ["<email> _", "<email> _ 9.9.9.9"]]
    long = "x" * 1000
    assert len({pii.contexts(f"{long}{c} a1@x.org", [("email", 1002, 1010)])[0][0] for c in "yzz"}) == 2


def test_shapes_mark_numbers_that_no_rule_knows(spark):
    cards = []
    for i in range(200):
        card = f"4111 1111 {i:04d} 1117"
        if pii.luhn(card.replace(" ", "")):
            cards.append(card)
    assert len(cards) >= 12
    texts = [f"w{i}x card: {c} v{i}y" for i, c in enumerate(cards)]
    texts += ["pay by card: 4111 1111 1111 1112 soon", "the lot 4111 1111 1111 1112 is", "room: 12345 is free"]
    rows = by_id(pii.detect(docs(spark, texts)))
    found = [[(s["kind"], texts[i][s["start"]:s["end"]]) for s in rows[i][0]["found"]] for i in range(len(texts))]
    assert found[-3:] == [[("card", "4111 1111 1111 1112")], [], []] and not any(found[:-3])


def slow_learnt(uses, rounds=3, seeds=5, confidence=0.8):
    edges = {}
    for kind, value, pattern in uses:
        edges[pattern, value] = max(edges.get((pattern, value)) or "", kind or "") or None
    of = {p: {v: k for (q, v), k in edges.items() if q == p} for p, _ in edges}
    counts = {p: {k: sum(x == k for x in vs.values()) for k in pii.KINDS} for p, vs in of.items()}
    of = {p: vs for p, vs in of.items() if max(counts[p].values()) >= 2}
    known = {(v, k): 1.0 for vs in of.values() for v, k in vs.items() if k}
    scores = known
    for _ in range(rounds):
        rated = {(p, k): sum(scores.get((v, k), 0) for v in vs) / (len(vs) + 1) for p, vs in of.items() for k in pii.KINDS}
        doubt = {}
        for (p, k), c in rated.items():
            for v, own in of[p].items():
                if own is None and c >= 0.5:
                    doubt[v, k] = doubt.get((v, k), 1) * (1 - min(c, 0.99))
        scores = {**known, **{x: 1 - d for x, d in doubt.items()}}
    return {(p, k): round(c, 9) for (p, k), c in rated.items() if c >= confidence and counts[p][k] >= seeds}


def test_graph_scores_by_brute_force(spark):
    rng = random.Random(4)
    kinds = {f"v{i}": rng.choice(["email", "email", "phone", "card", None]) for i in range(120)}
    uses = []
    for p in range(40):
        main = rng.choice(["email", "phone", "card"])
        near = [v for v, k in kinds.items() if k == main or k is None and rng.random() < 0.3 or rng.random() < 0.02]
        uses += [(kinds[v], v, f"p{p}") for v in rng.choices(near, k=rng.randint(1, 30))]
    frame = spark.createDataFrame(uses, "kind string, value string, pattern string")
    found = {(r["pattern"], r["kind"]): round(r["confidence"], 9) for r in pii.learnt_patterns(frame, confidence=0.7).collect()}
    assert found == slow_learnt(uses, confidence=0.7) and found


def test_copies_of_one_seed_are_no_evidence(spark):
    texts = ["please write mail to: a1@x.org thanks"] * 20 + ["please write mail to: zoe9[at]home thanks"]
    assert not any(r["found"] for r in pii.detect(docs(spark, texts)).collect())


def test_digests_and_odd_rows(spark):
    text = "é a@b.co 1.2.3.4 and 4111 1111 1111 1111 or +1 (988) 555-2485"
    frame = docs(spark, [text, text, None, text], [3, 3, 4, None])
    rows = by_id(pii.digests(pii.detect(frame)))
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in slow(text))
    assert len(rows[3]) == 2 and len(rows[None]) == 1
    assert tuple(rows[3][0])[1:] == (1, 1, 1, 1, hashlib.sha256(line.encode()).hexdigest(), line)
    assert tuple(rows[4][0])[1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert sorted(r["text"] for r in pii.redacted(frame).where("text is not null").collect()) == ["é [EMAIL] [IP] and [CARD] or [PHONE]"] * 3
    assert pii.detect(docs(spark, [])).count() == pii.redacted(docs(spark, [])).count() == 0
