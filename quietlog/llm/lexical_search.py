"""Ranked lexical search with bag deduplication (operator 13).

Every document is restricted to the vocabulary of the items: what is left is a bag, the
counts of those terms, and the length norm m.  Documents with equal bag and m have equal scores for
every item, so they form a class: bags are hashed, and the classes grouped by hash, bag and m, which
verifies them.  Each class is scored once and its members are listed by ascending doc_id.

Items are worked off in blocks of at most ``BLOCK_TERMS`` distinct terms (one item at least), so
what every task holds is bounded whatever the number of items is; each block goes over all documents.

Cases: every row is a document or an item of its own, repeated rows and null ids (first in
order) included.  A null or empty text has no terms: such a document is in no result and counts in no
figure, such an item gives no rows.  Empty tables give no rows.  Other columns are not looked at.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm.common import column, slices, texts
from quietlog.sources.tables import materialise

TOP = 50
#: Parts of the norm, in hundredths: m = 100 - B + (B * n * N) div L, and the weight of m.
B, K = 50, 20
BLOCK_TERMS = 200_000
_STEP_BYTES = 4 << 20
_STEP_CELLS = 2 << 20
#: Bytes of terms: letters, digits and all of UTF-8 beyond ASCII; A-Z become small, other bytes blanks.
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if _TERM_BYTES.match(bytes([b])) else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of items as (number, item_id, distinct terms)."""
    block, seen = [], set()
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        own = {t for t in terms(row["text"] or "") if t}
        if block and len(seen | own) > BLOCK_TERMS:
            yield block
            block, seen = [], set()
        if own:
            block.append((number, row["item_id"], sorted(own)))
            seen |= own
    if block:
        yield block


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of all documents with a term; bag: (term, count) pairs of the vocabulary in its order."""
    def restrict(batches):
        for batch in batches:
            for part in slices([batch], _STEP_BYTES):
                ids, sizes, bags = [], [], []
                for doc_id, text in zip(column(part, "doc_id"), texts(part)):
                    count = Counter(terms(text))
                    count.pop(b"", None)
                    if not count:
                        continue
                    pairs = sorted((vocabulary[t], c) for t, c in count.items() if t in vocabulary)
                    ids.append(doc_id)
                    sizes.append(count.total())
                    bags.append(np.array(pairs, "<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(restrict, "doc_id long, n long, bag binary")


def _holders(bags: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term; counted per task, then summed."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])
    found = bags.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(size, np.int64)
    for row in found.collect():  # one row per term of the block
        df[row["term"]] = row["df"]
    return df


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, row of each pair) of a column of bags."""
    both = np.frombuffer(b"".join(bags.to_pylist()), "<i8").reshape(-1, 2)
    lengths = np.asarray(pc.binary_length(bags)) // 16
    return both[:, 0], both[:, 1], np.repeat(np.arange(len(bags)), lengths)


def _classes(bags: DataFrame, documents: int, total: int) -> DataFrame:
    """One row per class of equal bag and m: class, its first ``TOP`` doc_ids in order, m, bag."""
    m = F.expr(f"cast({100 - B} + div(cast({B} * n as decimal(38, 0)) * {documents}, {total}) as bigint)")
    held = bags.where(F.length("bag") > 0).select("doc_id", "bag", m.alias("m"), F.xxhash64("bag").alias("hash"))
    # The limit is applied in every task before the shuffle too, so a class of any size stays small.
    order = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_first())
    first = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    grouped = first.groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("members"))
    return materialise(grouped.select(F.monotonically_increasing_id().alias("class"), "m", "bag", "members"), "lexical-classes")


def _scored(classes: DataFrame, block: list[tuple], vocabulary: dict[bytes, int], weights: np.ndarray) -> DataFrame:
    """The best ``TOP`` classes per item of every task."""
    pairs = np.array([(vocabulary[t], i) for i, (_, _, own) in enumerate(block) for t in own], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1))
    holders, counts, many = pairs[:, 1], np.diff(starts), len(block)

    def best(item, cls, first, missing, score):
        """Rows of the highest scores per item, equal ones by the first doc_id, nulls first."""
        order = np.lexsort((cls, first, ~missing, -score, item))
        sorted_items = item[order]
        return order[np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items) < TOP]

    def score(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        step = max(1, _STEP_CELLS // many)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cls, m = (np.asarray(part.column(i)) for i in (0, 1))
                term, tf, row = _pairs(part.column(2))
                worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + K * m[row]))
                spread = counts[term]
                before = np.cumsum(spread) - spread
                where = np.arange(int(spread.sum())) - np.repeat(before - starts[term], spread)
                cells = np.zeros(part.num_rows * many, np.int64)
                np.add.at(cells, np.repeat(row * many, spread) + holders[where], np.repeat(worth, spread))
                hit = np.flatnonzero(cells)
                first = part.column(3)
                missing = np.asarray(first.is_null())[hit // many]
                first = np.asarray(first.fill_null(0))[hit // many]
                more = [hit % many, cls[hit // many], first, missing, cells[hit]]
                kept = [np.concatenate(pair) for pair in zip(kept, more)]
                order = best(*kept)
                kept = [x[order] for x in kept]
        item, cls, first, missing, value = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(cls), pa.array(first), pa.array(missing), pa.array(value)],
            ["number", "class", "first", "missing", "score"])
    return classes.select("class", "m", "bag", F.col("members")[0]["doc_id"].alias("first")).mapInArrow(
        score, "number long, class long, first long, missing boolean, score long")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ``TOP`` documents of each item: item_id, rank, doc_id, score.

    Score: sum over the item's distinct terms of w * ((10^9 * tf) div (1000 * tf + 20 * m)).
    """
    spark = docs.sparkSession
    parts = []
    for block in _item_blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in block for t in own}))}
        bags = materialise(_bags(docs, vocabulary), "lexical-bags")
        whole = bags.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").cast("bigint").alias("total")).first()
        if not whole["documents"]:
            break
        df = _holders(bags, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * whole["documents"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        classes = _classes(bags, whole["documents"], whole["total"])
        scored = _scored(classes, block, vocabulary, weights)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("missing"), "first", "class")
        top = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
        top = materialise(top.select("number", "class", "score"), "lexical-top")
        expanded = top.join(classes.select("class", "members"), "class").select(
            "number", "class", "score", F.posexplode("members").alias("twin", "member")).select("number", "score", "class", "twin", "member.doc_id")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "class", "twin")
        ranked = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(block)], f"number long, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(ranked.join(names, "number").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
