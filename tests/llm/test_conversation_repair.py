import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from quietlog.llm import conversation_repair, registry

SF = "/root/testdata/sf0.001"
_BLANK = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = re.compile(r"(s?(ua)+)?")


def slow_damage(rows):
    """Rows (conv, turn, role, text) after the faults, in order within each conversation."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def slow_faults(rows):
    """Per row: None, blank, duplicate or truncated."""
    seen, out = set(), []
    for _, _, role, text in rows:
        said = _BLANK.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def slow_edits(initials, kinds):
    """(cost, edits, output) least by cost, then by the string, over all edits (cheapest first)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(initials) and _LEGAL.fullmatch(roles):
            return cost, edits, roles
        tail = (i, roles[-1:] if roles else "-")
        if (tail, edits) in done:
            continue
        done.add((tail, edits))
        if not re.fullmatch(r"(s?(ua)*u?)?", roles) or len(roles) > 2 * len(initials) + 4:
            continue
        for c in "ua":
            heapq.heappush(heap, (cost + 2, edits + "I", i, roles + c))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, roles))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + (initials[i] or "?")))
                for c in "ua":
                    heapq.heappush(heap, (cost + 2 + more, edits + "R", i + 1, roles + c))


def slow(rows, solve):
    """Report of one conversation from its rows after damage; ``solve`` gives the edits."""
    kinds = slow_faults(rows)
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    cost, edits = solve(initials, kinds)
    lines, left, output = [], iter(rows), []
    state = ""
    for e in edits:
        row = None if e == "I" else next(left)
        if e == "D":
            continue
        name = row[2] if e == "K" else "assistant" if state == "u" else "user"
        lines.append(f"{name}:{row[3] if row else ''}")
        state = name[:1]
        output.append(state)
    assert next(left, None) is None and _LEGAL.fullmatch("".join(output))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_search(initials, kinds):
    return slow_edits(initials, kinds)[:2] if initials else (0, "")


def symbol(initial, kind):
    return 0 if kind in ("blank", "duplicate") else 1 + 2 * ("sua".find(initial) if initial in tuple("sua") else 3) + (kind == "truncated")


def got(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


def test_edits_by_search():
    rng = random.Random(4)
    for n in [0, 1, 1, 2, 2, 3, 4, 5, 6, 7] * 12:
        initials = rng.choices(["s", "u", "a", "x", ""], [2, 4, 4, 1, 1], k=n)
        kinds = rng.choices([None, "blank", "truncated"], [4, 1, 2], k=n)
        expected = by_search(initials, kinds)
        assert conversation_repair.cheapest(np.array([symbol(*s) for s in zip(initials, kinds)], np.int64)) == expected


def plain(initials, kinds):
    """Cost and edits of long conversations, vector by vector without tables."""
    after = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    other = {"-": "u", "s": "u", "u": "a", "a": "u"}
    best = [None] * len(initials) + [{"-": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}]
    for i in range(len(initials) - 1, -1, -1):
        row = {}
        for q in after:
            choices = [(3 + best[i + 1][q][0], "D" + best[i + 1][q][1])]
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if initials[i] in after[q]:
                    c, e = best[i + 1][after[q][initials[i]]]
                    choices.append((more + c, "K" + e))
                c, e = best[i + 1][other[q]]
                choices.append((2 + more + c, "R" + e))
            row[q] = min(choices)
        for _ in range(3):
            row = {q: min(v, (2 + row[other[q]][0], "I" + row[other[q]][1])) for q, v in row.items()}
        best[i] = row
    return best[0]["-"]


def test_long_conversations():
    rng = random.Random(5)
    for n in (30, 31, 200, 401):
        initials = rng.choices(["s", "u", "a", "x"], [1, 4, 4, 1], k=n)
        kinds = rng.choices([None, "blank", "truncated"], [5, 1, 2], k=n)
        assert conversation_repair.cheapest(np.array([symbol(*s) for s in zip(initials, kinds)], np.int64)) == plain(initials, kinds)


def test_tables_are_small():
    vectors, rows, blocks = conversation_repair.tables()
    assert len(vectors) < 60 and all(min(v) == 0 for v in vectors) and len(blocks[0]) == 1000


ROWS = "conv_id long, turn long, role string, text string"


def strange():
    rng = random.Random(6)
    said = ["Yes.", "No", "", " \t", "Why?", None, "é! ", "a\nb.", "Yes. "]
    roles = ["user", "assistant", "system", None, "", "tool", "umpire", "User"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(said)) for c in range(40) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Yes."), (None, None, "assistant", "No."), (50, None, "user", "x" * 100_000)]
    rows += [(51, t, "assistant" if t % 3 else "user", "Same.") for t in range(300)] + [(52, 4, "user", "Same.")] * 50
    return rows


def test_report_by_brute_force(spark):
    rows = strange()
    frame = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as place", "'x' as edits", "2 as copies", "'y' as audit").repartition(5)
    expected = {c: slow(slow_damage([r for r in rows if r[0] == c]), plain) for c in {r[0] for r in rows}}
    assert got(conversation_repair.report(conversation_repair.damaged(frame), frame)) == expected
    assert any(e[6] == "" for e in expected.values())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = {c: slow(slow_damage([r for r in rows if r[0] == c]), plain) for c in {r[0] for r in rows}}
    assert got(registry.queries()["op11_conversation_repair"](spark, SF)) == expected


def test_empty_table(spark):
    frame = spark.createDataFrame([], ROWS)
    assert conversation_repair.report(conversation_repair.damaged(frame), frame).count() == 0


def test_messages_are_well_formed(spark):
    rows = conversation_repair.ordered(spark.createDataFrame(strange(), ROWS))
    found = conversation_repair.audits(conversation_repair.faults(rows))
    said = {}
    for r in conversation_repair.repaired(rows, found).collect():
        said.setdefault(r["conv_id"], []).append((r["place"], r["role"][:1]))
    assert all(_LEGAL.fullmatch("".join(i for _, i in sorted(v))) for v in said.values()) and len(said) > 30


@pytest.mark.parametrize("block", [1, 2, 4])
def test_block_lengths_agree(monkeypatch, block):
    rng = random.Random(block)
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    conversation_repair.tables.cache_clear()
    try:
        for n in (0, 1, 5, 40):
            initials, kinds = rng.choices("suax", k=n), rng.choices([None, "blank", "truncated"], k=n)
            assert conversation_repair.cheapest(np.array([symbol(*s) for s in zip(initials, kinds)], np.int64)) == plain(initials, kinds)
    finally:
        conversation_repair.tables.cache_clear()
