"""Conversation structure repair by Four-Russians block tables (operator 11).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  The cheapest edits that make it
so are found over four states (nothing said yet, after a system, a user, an assistant row).  For every state a
cost-to-go vector holds the cost of repairing what is left.  A vector less its minimum takes few
values, so a table gives for every such vector and every block of ``BLOCK`` row symbols the vector before
the block and what was added.  Conversations are worked off from their end, one lookup per block.  The
edits are then read forwards: a block is expanded backward from the vector at its right end,
and of all edits that keep to the least cost the first letter in ASCII order is taken, which gives the least
string.

Rows are put in order by turn (nulls first), then role, then text; equal rows are counted before they are
shuffled.  Of each row one symbol goes to the task of its conversation, as its edits come out as one string;
texts never meet there, they stream past the edits in order.

Cases: nulls in role and text are one space, null ids are one conversation, rows may be repeated (they are
duplicates), roles may be anything (all but the initials s, u and a have to be edited), empty tables give
empty results, other columns are not looked at.
"""

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm.common import column
from quietlog.sources.tables import materialise

BLOCK = 3
#: Costs of edits: delete, insert, give another role; and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
WHITE = " \t\n\x0b\f\r"
#: Initials s, u, a and any other; after them a row lies in states 1, 2, 3.
_KINDS = "sua"
_START, _S, _U, _A = range(4)
#: The state after the row that may be inserted in a state, and of a row that is given a fitting role.
_NEXT = (_U, _U, _A, _U)
_ROLE = {_U: "user", _A: "assistant"}
#: Symbols: 0 must be deleted; 1 + 2 * kind + truncated; the last stands for no row and fills the first block.
_NONE = 9
_SYMBOLS = 10
_MUST_DELETE, _IS_TRUNCATED = 4, 8


def _kept(state: int, kind: int) -> int | None:
    """State after a row of this kind is kept, None where it must not stand."""
    if kind == 0:
        return _S if state == _START else None
    if kind == 1:
        return _U if state != _U else None
    return _A if kind == 2 and state == _U else None


def _inserted(costs) -> tuple:
    """Costs when rows may be inserted first."""
    for _ in range(3):
        costs = tuple(min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs))
    return costs


def _before(costs: tuple, symbol: int) -> tuple:
    """Cost-to-go before a row, from that behind it."""
    if symbol == _NONE:
        return costs
    found = []
    for q, stay in enumerate(costs):
        best = DELETE + stay
        if symbol:
            kind, more = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
            best = min(best, REROLE + more + costs[_NEXT[q]])
            after = _kept(q, kind)
            if after is not None:
                best = min(best, more + costs[after])
        found.append(best)
    return _inserted(found)


#: Cost-to-go behind the last row.
_END = _inserted((0, 99, 99, 0))


@lru_cache(maxsize=1)
def tables():
    """(vectors, one-row table, block table); a table has (vector before, added) by vector and symbols."""
    vectors, number, rows = [_END], {_END: 0}, []
    while len(rows) < len(vectors):
        own = []
        for symbol in range(_SYMBOLS):
            found = _before(vectors[len(rows)], symbol)
            low = min(found)
            found = tuple(c - low for c in found)
            if found not in number:
                number[found] = len(vectors)
                vectors.append(found)
            own.append((number[found], low))
        rows.append(own)
    blocks = []
    for v in range(len(vectors)):
        own = []
        for block in product(range(_SYMBOLS), repeat=BLOCK):
            at, added = v, 0
            for symbol in reversed(block):
                at, more = rows[at][symbol]
                added += more
            own.append((at, added))
        blocks.append(own)
    return vectors, rows, blocks


def cheapest(symbols: np.ndarray) -> tuple[int, str]:
    """(cost, edits) of one conversation: K keep, R give a role, D delete, I insert."""
    vectors, rows, blocks = tables()
    filled = np.concatenate([np.full(-len(symbols) % BLOCK, _NONE), symbols]).astype(np.int64)
    keys = (filled.reshape(-1, BLOCK) @ (_SYMBOLS ** np.arange(BLOCK)[::-1])).tolist()
    behind, at, total = [], 0, 0  # the vector at the right end of each block
    for key in reversed(keys):
        behind.append(at)
        at, added = blocks[at][key]
        total += added
    behind.reverse()
    cost = total + vectors[at][_START]
    edits, state = [], _START
    for b, right in enumerate(behind):
        own = filled[b * BLOCK:(b + 1) * BLOCK].tolist()
        inner = [(right, 0)]  # vectors within the block, from its right end
        for symbol in reversed(own):
            inner.append(rows[inner[-1][0]][symbol])
        for i, symbol in enumerate(own):
            if symbol == _NONE:
                continue
            (here, added), after = inner[BLOCK - i], vectors[inner[BLOCK - i - 1][0]]
            now = vectors[here]
            kind, more = (symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED
            while True:
                left = now[state] + added
                keep = _kept(state, kind) if symbol else None
                if DELETE + after[state] == left:
                    edits.append("D")
                elif INSERT + now[_NEXT[state]] == now[state]:
                    edits.append("I")
                    state = _NEXT[state]
                    continue
                elif keep is not None and more + after[keep] == left:
                    edits.append("K")
                    state = keep
                else:
                    edits.append("R")
                    state = _NEXT[state]
                break
    while vectors[0][state]:
        edits.append("I")
        state = _NEXT[state]
    return cost, "".join(edits)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the contract of the query prescribes, by crc32 of ``conv_id:turn``."""
    def word(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    held = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       word("role").alias("role"), word("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return held.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("col")


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and their place within the turn."""
    held = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")])
    counted = held.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    within = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return materialise(counted.withColumn("place", F.row_number().over(within)), "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """One row per conversation: its symbols in order, and the counts of its faults.  ``rows`` are ``ordered``."""
    bare = F.rtrim("text", F.lit(WHITE))
    slim = rows.select(
        "conv_id", "turn", "place", "role", "copies", F.md5(F.col("text").cast("binary")).alias("digest"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    where = F.struct("turn", "place")
    first = slim.where(~F.col("blank")).groupBy(
        F.col("conv_id").alias("own"), F.col("role").alias("said_by"), F.col("digest").alias("said")).agg(F.min(where).alias("first"))
    marked = slim.join(first, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("role") == F.col("said_by")) & (F.col("digest") == F.col("said")), "left")
    again = F.coalesce(where > F.col("first"), F.lit(False))
    kind = F.coalesce(F.nullif(F.position(F.left("role", F.lit(1)), F.lit(_KINDS)), F.lit(0)) - 1, F.lit(3))
    kind = F.when(F.col("role") == "", 3).otherwise(kind)
    code = kind + F.when(F.col("blank") | again, _MUST_DELETE).otherwise(0) + F.when(~F.col("blank") & F.col("cut"), _IS_TRUNCATED).otherwise(0)
    sound = ~F.col("blank") & ~again
    turns = F.count_if((F.col("place") == 1) & F.col("turn").isNotNull())
    return marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - turns, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - sound.cast("int"))).alias("duplicate"),
        F.count_if(sound & F.col("cut")).alias("truncated"),
        F.sort_array(F.collect_list(F.struct("turn", "place", code.alias("code"), "copies"))).alias("rows"),
    )


def audits(conversations: DataFrame) -> DataFrame:
    """The conversations of ``faults`` with illegal, cost and audit (the edits)."""
    def solve(batches):
        for batch in batches:
            rows = batch.column(1)
            codes, copies = (np.asarray(rows.flatten().field(n)) for n in ("code", "copies"))
            ends = np.asarray(rows.offsets) - rows.offsets[0].as_py()
            out = []
            for a, b in zip(ends, ends[1:]):
                own, many = codes[a:b].astype(np.int64), copies[a:b]
                each = np.repeat(own, many)
                kinds = each & 3
                pairs = kinds[:-1] * 4 + kinds[1:]
                illegal = int((~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())
                symbols = 1 + 2 * kinds + (each & _IS_TRUNCATED) // _IS_TRUNCATED
                first = np.cumsum(many) - many
                again = np.ones(len(each), bool)
                again[first] = (own & _MUST_DELETE) > 0
                out.append((illegal, *cheapest(np.where(again, 0, symbols))))
            illegal, cost, edits = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(edits, pa.string()),
                 *[batch.column(i) for i in range(2, 6)]],
                ["conv_id", "illegal", "cost", "audit", "gaps", "blank", "duplicate", "truncated"])
    counts = ["gaps", "blank", "duplicate", "truncated"]
    types = ", ".join(f"{name} long" for name in counts)
    return conversations.select("conv_id", "rows", *counts).mapInArrow(solve, f"conv_id long, illegal long, cost long, audit string, {types}")


def _edited(batches):
    """Messages of the repaired conversations, from their edits followed by their rows in order."""
    conv, edits, at, state, place = None, "", 0, _START, 0

    def insertions(out):
        nonlocal at, state, place
        while at < len(edits) and edits[at] == "I":
            state = _NEXT[state]
            out.append((conv, place, _ROLE[state], ""))
            at, place = at + 1, place + 1
    for batch in batches:
        out = []
        for own, role, text, copies, audit in zip(*(column(batch, n) for n in ("conv_id", "role", "text", "copies", "edits"))):
            if audit is not None:
                insertions(out)
                conv, edits, at, state, place = own, audit, 0, _START, 0
                continue
            for _ in range(copies):
                insertions(out)
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = _NEXT[state]
                    role_now = _ROLE[state]
                else:
                    state, role_now = _kept(state, _KINDS.find(role[:1])), role
                out.append((conv, place, role_now, text))
                place += 1
        yield _messages(out)
    out = []
    insertions(out)
    yield _messages(out)


def _messages(rows):
    ids, places, roles, said = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(said, pa.string())],
        ["conv_id", "place", "role", "text"])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Messages (conv_id, place, role, text) after the edits; those of one conversation come one after the other.

    ``rows`` are ``ordered`` and ``found`` their ``audits``.
    """
    lead = found.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(0).alias("place"), F.lit("").alias("role"),
                        F.lit("").alias("text"), F.lit(0).cast("bigint").alias("copies"), F.col("audit").alias("edits"))
    both = lead.unionByName(rows.withColumn("edits", F.lit(None).cast("string")))
    # Places start at 1, so the edits with their null turn and place 0 come first.
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")
    return placed.select("conv_id", "role", "text", "copies", "edits").mapInArrow(
        _edited, "conv_id long, place long, role string, text string")


def _hashes(batches):
    """sha256 of each conversation's ``role:text`` lines; rows of one conversation follow each other."""
    conv, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
    for batch in batches:
        ready = []
        for own, place, role, text in zip(*(column(batch, n) for n in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest:
                    ready.append(done())
                conv, digest = own, hashlib.sha256()
            digest.update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    if digest:
        yield done()


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired text for every id of ``ids`` (conv_id)."""
    parts = ordered(rows)
    found = materialise(audits(faults(parts)), "conversation-audits")
    hashes = repaired(parts, found).mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    every = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    together = every.unionByName(found, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return together.groupBy("conv_id").agg(
        *[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
