"""Katz backoff model of word pairs, counted and evaluated in blocks.

Documents are cut into blocks of tokens.  A block asks for what it needs, once per distinct word
and per distinct word pair, and gets the counts of the whole corpus back:

1. blocks: token numbers local to the block, digests and training counts of its words;
2. words: blocks send their words by digest bucket; a bucket adds up the counts, numbers the
   words and answers every block;
3. pairs: blocks send their pairs by bucket; a bucket adds up the counts, stores them as a part of
   the model's table and answers with the counts and what each history needs for its backoff weight;
4. blocks put the answers together and evaluate every token: pair, else backoff weight times word.

A pair's bucket follows from its first word, unless that word is common: then its pairs are spread
by both words, and the parts of its figures are added up at the end.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import column, pack, slices, texts, unpack
from quietlog.llm.encoding import Places
from quietlog.session import scratch_dir
from quietlog.sources.tables import materialise

#: Tokens of a block, about; tokens per bucket of words or pairs.
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 3_000_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
_END = b"\n"  # no word has white space
_UNKNOWN = np.int64((1 << 31) - 1)


def discounts(counts_of_counts) -> np.ndarray:
    """Good-Turing discounts of the counts 1..DISCOUNTED (index 0 unused), in Katz's form.

    ``counts_of_counts[r]`` tells how many events occur r times, up to DISCOUNTED + 1.  Where a
    discount is no number between 0 and 1, as on small or copied corpora, the absolute discount
    n1 / (n1 + 2 n2) takes its place.
    """
    n = np.asarray(counts_of_counts, float)
    k = DISCOUNTED
    result = np.ones(k + 1)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    common = (k + 1) * n[k + 1] / n[1] if n[1] > 0 else 1.0
    for r in range(1, k + 1):
        value = np.nan
        if n[r] > 0 and common < 1:
            value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        result[r] = value if 0 < value < 1 else 1 - flat / r
    return result


@dataclass
class Words:
    """The model of single words: total, distinct words, discounts, probability of an unknown word."""
    total: int
    distinct: int
    discount: np.ndarray
    divisor: int
    unknown: float

    @classmethod
    def of(cls, total: int, distinct: int, n: list[int]) -> "Words":
        d = discounts(n)
        left = sum((1 - d[r]) * r * n[r] for r in range(1, DISCOUNTED + 1))
        divisor = total if left > 0 else total + 1
        return cls(total, distinct, d, divisor, left / total if left > 0 else 1 / divisor)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        small = np.minimum(counts, DISCOUNTED)
        factor = np.where(counts <= DISCOUNTED, self.discount[small], 1.0)
        return np.where(counts > 0, factor * counts / self.divisor, self.unknown)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


BLOCKS = "block long, doc_ids binary, nulls binary, lengths binary, held binary, tokens binary, digests binary, counts binary, n long"


def blocks(docs: DataFrame) -> DataFrame:
    """Written blocks of whole documents; a null text is an empty one.

    Local words are numbered in the order of their digests; the last token of a block is an end.
    """
    def row(doc_ids, lengths, parts, places):
        words = list(places)
        held = np.array([x is not None and zlib.crc32(str(x).encode()) % 7 == 2 for x in doc_ids])
        digests = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
        order = np.argsort(digests, kind="stable")
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words))
        tokens = number[np.concatenate(parts)]
        counts = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(words))
        values = [
            pack(np.array([x or 0 for x in doc_ids], np.int64)), pack(np.array([x is None for x in doc_ids], np.uint8)),
            pack(np.array(lengths, np.int64)), pack(held.astype(np.uint8)), pack(tokens),
            pack(np.diff(digests[order], prepend=np.uint64(0))), pack(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([v], pa.binary()) for v in values), pa.array([len(tokens)], pa.int64())],
            ["doc_ids", "nulls", "lengths", "held", "tokens", "digests", "counts", "n"])

    def run(batches):
        places, doc_ids, lengths, parts, size = Places([_END]), [], [], [], 0
        for batch in slices(batches, 8 << 20):
            for doc_id, text in zip(column(batch, "doc_id"), texts(batch)):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(_END)
                if size and size + len(words) > BLOCK_TOKENS:
                    yield row(doc_ids, lengths, parts, places)
                    places, doc_ids, lengths, parts, size = Places([_END]), [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(len(words))
                parts.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                size += len(words)
        if doc_ids:
            yield row(doc_ids, lengths, parts, places)

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(run, BLOCKS.removeprefix("block long, "))
    path = scratch_dir(spark, "lm-blocks")
    rows.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema(BLOCKS).parquet(path)


def _groups(batches, key: str):
    """(key, rows as dicts) of sorted rows, one group at a time."""
    held, group = [], None
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
            if held and row[key] != group:
                yield group, held
                held = []
            group = row[key]
            held.append(row)
    if held:
        yield group, held


def _table(kinds, names, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def word_answers(parts: DataFrame, buckets: int) -> DataFrame:
    """Rows (block, bucket, ids, totals) for blocks, and one row per bucket (block null) with its figures."""
    def ask(batches):
        for batch in batches:
            for block, digests, counts in zip(*(column(batch, c) for c in ("block", "digests", "counts"))):
                digests, counts = np.cumsum(unpack(digests, np.uint64), dtype=np.uint64), unpack(counts, np.int64)
                bucket = ((digests >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in the order of the digests
                for mine in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
                    yield _table((pa.int64(), pa.int64(), pa.binary(), pa.binary()), ["bucket", "block", "digests", "counts"],
                                 [(int(bucket[mine[0]]), block, pack(digests[mine]), pack(counts[mine]))])

    def answer(batches):
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        names = ["block", "bucket", "ids", "totals", "figures"]
        for bucket, rows in _groups(batches, "bucket"):
            digests = [unpack(r["digests"], np.uint64) for r in rows]
            unique, place = np.unique(np.concatenate(digests), return_inverse=True)
            counts = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
            totals = np.zeros(len(unique), np.int64)
            np.add.at(totals, place, counts)
            if len(unique) * buckets + bucket >= int(_UNKNOWN):
                raise ValueError("more distinct words than 31-bit numbers")
            ids = np.arange(len(unique)) * buckets + bucket
            known = totals > 0
            small = np.bincount(np.minimum(totals[known], DISCOUNTED + 2), minlength=DISCOUNTED + 3)
            out = [(None, bucket, None, None, [int(totals.sum()), int(known.sum()), *map(int, small[1:DISCOUNTED + 2])])]
            at = 0
            for r, d in zip(rows, digests):
                mine = place[at:at + len(d)]
                at += len(d)
                out.append((r["block"], bucket, pack(ids[mine].astype(np.int32)), pack(totals[mine]), None))
            yield _table(kinds, names, out)

    asked = parts.select("block", "digests", "counts").mapInArrow(ask, "bucket long, block long, digests binary, counts binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    return materialise(asked.mapInArrow(
        answer, "block long, bucket long, ids binary, totals binary, figures array<long>"), "lm-words")


def _numbers(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Global number and training count of each local word of a block: the answers in bucket order are in local order."""
    ids = np.concatenate([unpack(r["a"], np.int32) for r in rows]).astype(np.int64)
    totals = np.concatenate([unpack(r["b"], np.int64) for r in rows])
    return np.where(totals > 0, ids, _UNKNOWN), totals


class _Pairs:
    """The distinct word pairs of a block whose first word is known, in bucket order."""

    def __init__(self, block: dict, ids: np.ndarray, totals: np.ndarray, words: Words, buckets: int):
        tokens = unpack(block["tokens"], np.int32).astype(np.int64)
        lengths = unpack(block["lengths"], np.int64)
        first = np.cumsum(lengths) - lengths
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[first] = tokens[-1]  # a text starts behind an end
        self.tokens, self.lengths = tokens, lengths
        known = totals[before] > 0
        self.place = np.flatnonzero(known)  # tokens that have a pair
        key = (ids[before[known]] << 32) | ids[tokens[known]]
        self.keys, self.of = np.unique(key, return_inverse=True)
        train = ~np.repeat(unpack(block["held"], np.uint8).astype(bool), lengths)
        self.counts = np.bincount(self.of[train[known]], minlength=len(self.keys))
        self.histories, follows = self.keys >> 32, self.keys & 0xFFFFFFFF
        by_id = np.argsort(ids, kind="stable")
        total_of = lambda x: totals[by_id[np.searchsorted(ids, x, sorter=by_id)]]
        self.follows, self.total_of = follows, total_of
        self.hot = total_of(self.histories) * 4 * buckets > words.total
        self.bucket = (np.where(self.hot, _mixed(self.keys), _mixed(self.histories)) % np.uint64(buckets)).astype(np.int64)

    def follow_totals(self, mine: np.ndarray) -> np.ndarray:
        """Training counts of the distinct second words of some pairs, in the order of their numbers."""
        words = np.unique(self.follows[mine])
        return np.where(words == _UNKNOWN, 0, self.total_of(words))

    def parts(self):
        order = np.argsort(self.bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(self.bucket[order])) + 1
        return [(int(self.bucket[mine[0]]), mine) for mine in np.split(order, cuts) if len(mine)]


_MOVED = "block long, kind int, bucket long, a binary, b binary, doc_ids binary, nulls binary, lengths binary, held binary, tokens binary"


def _moved(parts: DataFrame, answers: list[tuple[int, DataFrame]]) -> DataFrame:
    """Blocks and the answers to them, together and sorted: the block first; about one block per task."""
    none = F.lit(None).cast("binary")
    rows = parts.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("bucket"), none.alias("a"), none.alias("b"),
                        "doc_ids", "nulls", "lengths", "held", "tokens")
    for kind, frame in answers:
        rows = rows.union(frame.select("block", F.lit(kind).alias("kind"), "bucket", "a", "b", *(
            none.alias(c) for c in ("doc_ids", "nulls", "lengths", "held", "tokens"))))
    return rows.repartition(max(1, parts.count()), "block").sortWithinPartitions("block", "kind", "bucket")


def _figures(histories: np.ndarray, counts: np.ndarray, single: np.ndarray):
    """Per distinct history, sorted: count, how many followers occur r times, probability of the followers as words."""
    seen = counts > 0
    unique, of = np.unique(histories, return_inverse=True)
    c = np.bincount(of, counts, len(unique)).astype(np.int64)
    n = np.stack([np.bincount(of[counts == r], minlength=len(unique)) for r in range(1, DISCOUNTED + 1)], axis=1)
    p = np.bincount(of[seen], single[seen], len(unique))
    return unique, c, n, p


def pair_answers(moved: DataFrame, words: Words, buckets: int) -> DataFrame:
    """Written rows of four kinds: 1 answers to blocks, 2 the model's table, 3 figures of common histories, 4 counts of counts."""
    def ask(batches):
        for _, rows in _groups(batches, "block"):
            block = rows[0]
            pairs = _Pairs(block, *_numbers(rows[1:]), words, buckets)
            for bucket, mine in pairs.parts():
                yield _table((pa.int64(), pa.int64(), *(pa.binary(),) * 4), ["bucket", "block", "keys", "counts", "totals", "hot"], [(
                    bucket, block["block"], pack(np.diff(pairs.keys[mine], prepend=0)), pack(pairs.counts[mine].astype(np.int32)),
                    pack(pairs.follow_totals(mine)), pack(pairs.hot[mine].astype(np.uint8)))])

    def answer(batches):
        kinds = (pa.int32(), pa.int64(), pa.int64(), *(pa.binary(),) * 2, pa.list_(pa.int64()), pa.float64())
        names = ["kind", "block", "bucket", "a", "b", "figures", "mass"]
        for bucket, rows in _groups(batches, "bucket"):
            keys = [np.cumsum(unpack(r["keys"], np.int64)) for r in rows]
            unique, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            counts = np.bincount(place, np.concatenate([unpack(r["counts"], np.int32) for r in rows]), len(unique)).astype(np.int64)
            totals = np.concatenate([
                unpack(r["totals"], np.int64)[np.unique(k & 0xFFFFFFFF, return_inverse=True)[1]] for r, k in zip(rows, keys)])[first]
            hot = np.concatenate([unpack(r["hot"], np.uint8) for r in rows])[first].astype(bool)
            histories, c, n, p = _figures(unique >> 32, counts, words.probability(totals))
            kept = counts > 0
            small = np.bincount(np.minimum(counts[kept], DISCOUNTED + 2), minlength=DISCOUNTED + 3)
            yield _table(kinds, names, [
                (2, None, bucket, pack(np.diff(unique[kept], prepend=0)), pack(counts[kept]), None, None),
                (4, None, bucket, None, None, [int(x) for x in small[:DISCOUNTED + 2]], None)])
            common = np.isin(histories, unique[hot] >> 32)
            if common.any():
                yield _table(kinds, names, [
                    (3, None, bucket, None, None, [int(h), int(c[i]), *map(int, n[i])], float(p[i]))
                    for i, h in zip(np.flatnonzero(common), histories[common])])
            at = 0
            for r, k in zip(rows, keys):
                mine = place[at:at + len(k)]
                at += len(k)
                own = np.searchsorted(histories, np.unique(k >> 32))
                figures = np.concatenate([c[own][:, None], n[own]], axis=1).T  # column after column, as it packs best
                yield _table(kinds, names, [(
                    1, r["block"], bucket, pack(counts[mine].astype(np.int32)),
                    len(own).to_bytes(8, "little") + pack(np.concatenate([figures.reshape(-1), p[own].view(np.int64)])), None, None)])

    asked = moved.mapInArrow(ask, "bucket long, block long, keys binary, counts binary, totals binary, hot binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    return materialise(asked.mapInArrow(
        answer, "kind int, block long, bucket long, a binary, b binary, figures array<long>, mass double"), "lm-pairs")


def backoff(c: np.ndarray, n: np.ndarray, p: np.ndarray, discount: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """(divisor, weight) of histories: what seen pairs are divided by, and the factor of the word's own probability.

    The discounted mass goes to the words that did not follow, by their probability; the probabilities behind a
    history add up to one.  A history with nothing discounted gives one count to the rest.
    """
    left = n @ ((1 - discount[1:]) * np.arange(1, DISCOUNTED + 1))
    divisor = np.where(left > 0, c, c + 1)
    left = np.where(left > 0, left, 1)
    return divisor, left / divisor / np.maximum(1 - p, unknown)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def evaluate(moved: DataFrame, words: Words, discount: np.ndarray, common: dict, buckets: int) -> DataFrame:
    """Rows of scores, one per document."""
    def run(batches):
        for _, rows in _groups(batches, "block"):
            block = rows[0]
            ids, totals = _numbers([r for r in rows if r["kind"] == 1])
            pairs = _Pairs(block, ids, totals, words, buckets)
            answers = {r["bucket"]: r for r in rows if r["kind"] == 2}
            counts = np.zeros(len(pairs.keys), np.int64)
            divisor, weight = np.zeros(len(pairs.keys)), np.zeros(len(pairs.keys))
            for bucket, mine in pairs.parts():
                r = answers[bucket]
                counts[mine] = unpack(r["a"], np.int32)
                size = int.from_bytes(r["b"][:8], "little")
                data = unpack(r["b"][8:], np.int64)
                figures = data[:size * (1 + DISCOUNTED)].reshape(1 + DISCOUNTED, size)
                c, n, p = figures[0].copy(), figures[1:].T.copy(), data[size * (1 + DISCOUNTED):].view(np.float64).copy()
                own = np.unique(pairs.histories[mine])
                for k in np.flatnonzero(np.isin(own, list(common))) if common else ():
                    c[k], n[k], p[k] = common[int(own[k])]
                d, w = backoff(c, n, p, discount, words.unknown)
                at = np.searchsorted(own, pairs.histories[mine])
                divisor[mine], weight[mine] = d[at], w[at]
            single = words.probability(totals)[pairs.tokens]
            chance = single.copy()
            seen = counts > 0
            factor = np.where(counts <= DISCOUNTED, discount[np.minimum(counts, DISCOUNTED)], 1.0)
            direct = np.where(seen, factor * counts / np.maximum(divisor, 1), 0.0)
            chance[pairs.place] = np.where(seen[pairs.of], direct[pairs.of], weight[pairs.of] * single[pairs.place])
            first = np.cumsum(pairs.lengths) - pairs.lengths
            known = totals[pairs.tokens] > 0
            base = np.log10((totals[pairs.tokens] + 1) / (words.total + words.distinct + 1))
            nulls = unpack(block["nulls"], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(unpack(block["doc_ids"], np.int64), mask=nulls), pa.array(unpack(block["held"], np.uint8).astype(bool)),
                pa.array(pairs.lengths), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                pa.array(np.full(len(first), words.total)), pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(np.log10(chance), first)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return moved.mapInArrow(run, SCORES)


def scores(docs: DataFrame) -> DataFrame:
    """Log10 probabilities of all documents under a model of those that are not held out, one row per document.

    Held out: crc32(doc_id as text) mod 7 is 2; a null doc_id is not held out.  Words that no training text has
    share the probability that discounting takes from the others.  An empty or null text is its end
    alone.  Repeated rows are documents of their own.  An empty table gives no rows.
    """
    parts = blocks(docs)
    size = parts.agg(F.sum("n")).first()[0] or 0
    buckets = int(1 + size // BUCKET_TOKENS)
    vocabulary = word_answers(parts, buckets)
    sums = [F.coalesce(F.sum(F.col("figures")[i]), F.lit(0)).alias(f"f{i}") for i in range(DISCOUNTED + 3)]
    total, distinct, *n = vocabulary.where("block is null").agg(*sums).first()
    words = Words.of(total, distinct, [0, *n]) if total else Words(0, 0, np.ones(DISCOUNTED + 1), 1, 1.0)
    numbers = vocabulary.where("block is not null").select("block", "bucket", F.col("ids").alias("a"), F.col("totals").alias("b"))
    found = pair_answers(_moved(parts, [(1, numbers)]), words, buckets)
    sums = [F.coalesce(F.sum(F.col("figures")[i]), F.lit(0)).alias(f"f{i}") for i in range(DISCOUNTED + 2)]
    discount = discounts(list(found.where("kind = 4").agg(*sums).first()))
    # at most 4 * buckets words are so common that their pairs are spread
    figures = found.where("kind = 3").groupBy(F.col("figures")[0].alias("h")).agg(
        *(F.sum(F.col("figures")[i + 1]).alias(f"f{i}") for i in range(DISCOUNTED + 1)), F.sum("mass").alias("mass")).collect()
    common = {r["h"]: (r["f0"], np.array([r[f"f{i}"] for i in range(1, DISCOUNTED + 1)]), r["mass"]) for r in figures}
    answers = found.where("kind = 1").select("block", "bucket", "a", "b")
    return evaluate(_moved(parts, [(1, numbers), (2, answers)]), words, discount, common, buckets)
