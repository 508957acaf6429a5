"""Near copies by the Jaccard similarity of word shingles, found exactly.

A document is the set of its shingles; equal sets are one node.  In any common order of all
shingles, two sets of similarity s share one among the first n - ceil(s n) + 1 of either (prefix
filter), so pairs meet at such a shingle.  Parities of the shingles that fall on each bit, of at least
twice as many bits as shingles, differ in no more bits than the sets differ in shingles: they rule out most pairs,
the others are checked on the whole sets.  The order
takes rare shingles first, by a table of counts over all documents that affects the work but not the result: a shingle
of d sets adds d to its counter, so however large the table of documents, the common ones stand out and come last.

SimHash goes first: fingerprints of the same shingles meet on the popcount grid of operator 1, and what they link
is checked, together with one leader per shingle and size.  Fingerprints of two bits alone would miss most
pairs of that similarity, so the rest is found by the prefix filter.  There each set takes its nearest few of other
groups by parities, groups grow by what is confirmed, and the next round takes more of the shingles that had more, until
none has any left: a large group of near copies costs a few pairs a member, and no pair is left out.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietlog.llm import fingerprints
from quietlog.llm.common import column, components, let_go, pack, shingles, slices, texts, unpack
from quietlog.sources.tables import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEED = 42
CHUNK_BYTES = 2 << 20
#: Counters of shingles, the ranges they are summed in, and rows of one shingle that are compared at once.
SLOTS, RANGES, BLOCK = 1 << 22, 64, 1024
#: Marks of texts that are looked at.
MARKS = 1 << 23
#: Pairs of a set that the first round takes from each shingle, and how many times as many each further round takes.
NEAREST, MORE = 3, 8
#: Pairs that are held, and bytes of parities that are compared, at once.
STEP_PAIRS, STEP_BYTES = 1 << 17, 4 << 20
#: Sets that share a shingle and are paired without looking at their parities.
FEW = 6
#: Bits of parities of a small set.
LEAST_BITS = 2048


def _least(n, similarity: float):
    """Shingles that a set of n shares at least with a similar one."""
    return np.ceil(n * similarity - 1e-9)


def _sets(each: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted sets of the shingle hashes of each text, and the names of these sets."""
    each = [np.unique(x) for x in each]
    names = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in each), np.uint64, len(each))
    return each, names.view(np.int64)


def _hashes(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return [shingles(t, words, SEED) for t in texts(batch)]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _parities(own: np.ndarray) -> bytes:
    """One bit per residue of the hashes: odd or even.  The number of bits follows the size of the set and is a power of two."""
    size = max(LEAST_BITS, 1 << max(0, 2 * len(own) - 1).bit_length())
    at = (own >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The parities of the same set in ``size`` bytes: halves of the longer ones add up."""
    words = np.frombuffer(sketch, np.uint64)
    while len(words) * 8 > size:
        words = words[:len(words) // 2] ^ words[len(words) // 2:]
    return words


def _apart(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the parities of each pair differ, in the length of the shorter ones; ``a`` and ``b`` are places in the list."""
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    shorter = np.minimum(lengths[a], lengths[b])
    result = np.empty(len(a), np.int64)
    for size in np.unique(shorter).tolist():
        pairs = np.flatnonzero(shorter == size)
        for start in range(0, len(pairs), max(1, STEP_BYTES // size)):
            own = pairs[start:start + max(1, STEP_BYTES // size)]
            used, where = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
            rows = np.stack([_folded(sketches[k], size) for k in used.tolist()])
            result[own] = np.bitwise_count(rows[where[:len(own)]] ^ rows[where[len(own):]]).sum(axis=1)
    return result


def _named(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, mark, node, n, parities, bits, cell, part, seen): set and fingerprint of each row, and what a task has counted in each range of slots."""
    names = ["doc_id", "mark", "node", "n", "parities", "bits", "cell", "part", "seen"]

    def run(batches):
        let_go()
        seen = np.zeros(SLOTS, np.uint32)
        for batch in slices(batches, CHUNK_BYTES):
            hashes = _hashes(batch, words)
            bits = fingerprints.fingerprint_bits(np.concatenate(hashes), np.fromiter(map(len, hashes), np.int64, len(hashes)))
            each, nodes = _sets(hashes)
            np.add.at(seen, _slots(np.concatenate(each)), 1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in each], pa.int64()),
                pa.array([_parities(s) for s in each], pa.binary()), pa.array(bits.view(np.int64)),
                pa.array(fingerprints.cell_of(bits).view(np.int64)), pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.binary())], names)
        none = pa.nulls(RANGES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(RANGES, pa.binary()), none, none, pa.array(range(RANGES), pa.int64()),
             pa.array([pack(x) for x in np.split(seen, RANGES)], pa.binary())], names)

    rows = docs.select("doc_id", "mark", "text").mapInArrow(
        run, "doc_id long, mark long, node long, n long, parities binary, bits long, cell long, part long, seen binary")
    return materialise(rows, "copies-sets")


def _distinct(named: DataFrame) -> DataFrame:
    """Rows (node, doc_id, mark, n, parities), one per set: smallest doc_id and mark of its rows."""
    rows = named.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("parities").alias("parities"))
    return materialise(rows, "copies-distinct")


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts in 256 steps: fine around what most slots have by chance, by powers above."""
    usual = np.median(counts)
    over = (counts - usual) / max(1.0, math.sqrt(usual))
    return np.where(over < 4, np.clip(16 * over + 64, 0, 127), np.minimum(255, 128 + 4 * np.log2(np.maximum(over, 4) / 4))).astype(np.uint8)


def _levels(named: DataFrame) -> np.ndarray:
    """How common the shingles of each slot are among all rows."""
    def add(batches):
        part, counts = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pack(_level(counts))], pa.binary())], ["part", "levels"])
        for batch in batches:
            for k, seen in zip(column(batch, "part"), column(batch, "seen")):
                if k != part:
                    if part is not None:
                        yield done()
                    part, counts = k, np.zeros(SLOTS // RANGES, np.int64)
                counts += unpack(seen, np.uint32)
        if part is not None:
            yield done()

    rows = named.where("part is not null").select("part", "seen").repartition("part").sortWithinPartitions("part")
    levels = np.zeros((RANGES, SLOTS // RANGES), np.uint8)
    for r in rows.mapInArrow(add, "part long, levels binary").collect():  # as large for any input
        levels[r["part"]] = unpack(r["levels"], np.uint8)
    return levels.reshape(-1)


def _shared(docs: DataFrame, levels: np.ndarray, similarity: float, words: int) -> DataFrame:
    """Distinct rows (token, node, n, pos) of shingles that may be the first a set shares with a similar one.

    Only shingles that another set has too are kept; all rows go through one shuffle, and the many
    shingles of one set alone are dropped where they meet.
    """
    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            parts = []
            each, nodes = _sets(_hashes(batch, words))
            for own, node in {int(k): (s, k) for s, k in zip(each, nodes)}.values():
                n = len(own)
                if n:
                    first = np.argsort(levels[_slots(own)], kind="stable")[:n - int(_least(n, similarity)) + 1]
                    parts.append((own[first].view(np.int64), np.full(len(first), node), np.full(len(first), n), np.arange(len(first))))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["token", "node", "n", "pos"])

    rows = docs.select("text").mapInArrow(run, "token long, node long, n long, pos long")
    by_token = Window.partitionBy("token")
    several = rows.withColumn("low", F.min("node").over(by_token)).withColumn("high", F.max("node").over(by_token)).where("low <> high")
    return materialise(several.groupBy("token", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "copies-shared")


def _wanted(marks: DataFrame) -> np.ndarray:
    """One bit per residue of the marks, low bits first: which texts are looked at; one too many does no harm.

    Tasks build the bits, so one job brings as many bytes for any input.
    """
    slot = marks.select(F.expr(f"mark & {MARKS - 1}").alias("slot")).withColumn("slot", F.col("slot") + 1)  # Spark counts them from 1
    rows = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    wanted = np.zeros(MARKS >> 3, np.uint8)
    for r in rows.collect():
        start = (r["part"] - 1) * len(r["bits"])
        wanted[start:start + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)[:len(wanted) - start]
    return wanted


def _checked(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity.

    Texts are compressed before they move.  The text of v goes to each of its pairs; that of u is sent once, and
    its pairs stream past its set.
    """
    for side in ("u", "v"):
        pairs = pairs.join(distinct.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("parities").alias(f"p_{side}")), side)

    def may(batches):
        for batch in slices(batches, CHUNK_BYTES, "p_u"):
            places = np.arange(batch.num_rows)
            apart = _apart(column(batch, "p_u") + column(batch, "p_v"), places, places + batch.num_rows)
            most = (np.asarray(batch.column(2)) + np.asarray(batch.column(3))) * ((1 - similarity) / (1 + similarity)) + 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(apart <= most))

    pairs = pairs.select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(may, "u long, v long")
    pairs = materialise(pairs, "copies-pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = _wanted(distinct.select("node", "mark").join(nodes, "node", "left_semi"))

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            slots = np.asarray(batch.column(0)) & (8 * len(wanted) - 1)
            for part in slices([batch.filter(pa.array((wanted[slots >> 3] >> (slots & 7) & 1).astype(bool)))], CHUNK_BYTES):
                _, names = _sets(_hashes(part, words))
                packed = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(packed, pa.binary())], ["node", "packed"])

    def run(batches):
        unpacker = zstandard.ZstdDecompressor()
        leader, own = None, None
        for batch in batches:
            out = []
            for u, v, packed in zip(*(column(batch, c) for c in ("u", "v", "packed"))):
                found = np.unique(shingles(unpacker.decompress(packed).decode("utf-8", "surrogatepass"), words, SEED))
                if v is None:
                    leader, own = u, found
                elif u == leader:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if both / (len(own) + len(found) - both) >= similarity:
                        out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

    own = docs.select("mark", "text").mapInArrow(pack, "node long, packed binary").join(nodes, "node", "left_semi")
    own = materialise(own.dropDuplicates(["node"]), "copies-own")
    leaders = own.join(pairs.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select(
        F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), "packed")
    others = pairs.join(own.withColumnRenamed("node", "v"), "v").select("u", "v", "packed")
    # The row of u itself has no v and comes first.
    sides = leaders.unionByName(others).repartition("u").sortWithinPartitions("u", "v")
    return materialise(sides.mapInArrow(run, "u long, v long"), "copies-links")


def _printed(named: DataFrame) -> DataFrame:
    """Pairs (u, v) that SimHash proposes: sets of one fingerprint with one of them, and fingerprints linked on the popcount grid."""
    rows = named.where("n > 0").select("bits", "cell", "node").distinct()
    least = materialise(rows.groupBy("bits", "cell").agg(F.min("node").alias("node")), "copies-prints")
    same = rows.join(least.select("bits", F.col("node").alias("u")), "bits").where("u <> node").select("u", F.col("node").alias("v"))
    return same.union(fingerprints.links(least)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _led(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each node with the leader among those of its size that have the same shingle."""
    rows = shared.withColumn("band", F.floor(F.log("n") / -math.log((1 + similarity) / 2)))
    leaders = rows.groupBy("token", "band").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u <> last")
    return rows.join(leaders, ["token", "band"]).where("u <> node").select("u", F.col("node").alias("v")).distinct()


def _open(shared: DataFrame, joined: DataFrame, distinct: DataFrame, similarity: float, nearest: int) -> DataFrame:
    """Pairs of nodes with a common shingle that are not joined yet, large enough for each other and near enough by their parities.

    A node takes its ``nearest`` ones among those before it of each shingle; a row without u names, as v, a shingle where one had more.
    """
    rows = shared.join(joined, "node", "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("part"))
    rows = materialise(rows, "copies-parts")
    several = rows.groupBy("token").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("met")).where("low <> high").select("token", "met")
    rows = rows.join(materialise(several, "copies-open"), "token")
    names = ["token", "node", "n", "pos", "part", "parities"]
    few = rows.where(F.col("met") <= FEW).withColumn("parities", F.lit(None).cast("binary")).select(names)
    rows = few.union(rows.where(F.col("met") > FEW).join(distinct.select("node", "parities"), "node").select(names))

    def run(batches):
        token, held, sketches, new = None, np.empty((0, 4), np.int64), [], []
        cut, more_at = False, []

        def flush(held, sketches, new, last=True):
            """Pairs of the new rows with those before them, and what later rows can still meet."""
            nonlocal cut
            if last and not len(held) and len(new) <= FEW:  # most shingles are those of a few documents
                found = [(x[0], y[0]) for k, y in enumerate(new) for x in new[:k] if x[3] != y[3] and x[1] >= _least(y[1], similarity)]
                return [np.array(found, np.int64)] if found else [], held, sketches
            every = np.concatenate([held, np.array([r[:4] for r in new], np.int64).reshape(-1, 4)])
            marks = sketches + [r[4] for r in new]
            node, n, pos, part = every.T
            found = []
            step = max(1, STEP_PAIRS // max(1, len(every)))
            for start in range(len(held), len(every), step):
                i = np.arange(start, min(start + step, len(every)))[:, None]
                j = np.arange(i[-1, 0] + 1)[None, :]
                least = np.ceil((n[i] + n[j]) * (similarity / (1 + similarity)) - 1e-9)
                most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
                a, b = np.nonzero((j < i) & (part[i] != part[j]) & (n[j] >= _least(n[i], similarity)) & (most >= least))
                a += start
                apart = _apart(marks, a, b)
                near = np.flatnonzero(apart <= (n[a] + n[b]) * ((1 - similarity) / (1 + similarity)) + 1e-6)
                near = near[np.lexsort((apart[near], a[near]))]
                a, b = a[near], b[near]
                first = np.searchsorted(a, a)  # where the pairs of the same row begin
                few = np.arange(len(a)) - first < nearest
                cut |= not few.all()
                found.append(np.stack([node[b[few]], node[a[few]]], axis=1))
            stay = np.flatnonzero(n >= _least(n[-1], similarity)) if len(every) else []
            return found, every[stay], [marks[k] for k in stay]

        def out(found):
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        found, size = [], 0
        for batch in batches:
            for t, *row in zip(*(column(batch, c) for c in ("token", "node", "n", "pos", "part", "parities"))):
                more = []
                if t != token:
                    more = flush(held, sketches, new)[0]
                    if cut:
                        more_at.append(token)
                    token, held, sketches, new, cut = t, held[:0], [], [], False
                elif len(new) >= max(BLOCK, FEW + 1):
                    more, held, sketches = flush(held, sketches, new, False)
                    new = []
                new.append(row)
                found += more
                size += sum(map(len, more))
                if size > STEP_PAIRS or len(found) > STEP_PAIRS:
                    yield out(found)
                    found, size = [], 0
        found += flush(held, sketches, new)[0]
        if found:
            yield out(found)
        if cut:
            more_at.append(token)
        if more_at:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more_at), pa.int64()), pa.array(more_at, pa.int64())], ["u", "v"])

    rows = rows.repartition("token").sortWithinPartitions("token", "n")
    return materialise(rows.mapInArrow(run, "u long, v long").distinct(), "copies-near")


def _grown(before: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) of more ``links`` than those of ``before``: only what they join is walked again."""
    for side in ("u", "v"):
        parts = before.select(F.col("node").alias(side), F.col("component").alias("part"))
        links = links.join(parts, side, "left").withColumn(side, F.coalesce("part", side)).drop("part")
    found = materialise(components(links), "copies-joined")
    tops = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = before.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return materialise(moved.union(found.join(before, "node", "left_anti")), "copies-groups")


def groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (doc_id, component_id), one per row of ``docs``: the smallest doc_id reachable over similar documents.

    Two documents are similar if the Jaccard similarity of their sets of ``words`` words in a row, without regard to
    A-Z or a-z, is at least ``similarity``; fewer words are one shingle, documents without words are all equal.
    Rows whose doc_id is null link others like any row, with a null component_id where all are null.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    named = _named(docs, words)
    distinct = _distinct(named)
    shared = _shared(docs, _levels(named), similarity, words)
    tried = materialise(_printed(named).union(_led(shared, similarity)).distinct(), "copies-tried")
    joined = materialise(components(_checked(tried, docs, distinct, similarity, words)), "copies-groups")
    nearest = NEAREST
    while True:
        near = _open(shared, joined, distinct, similarity, nearest)
        cut = materialise(near.where("u is null").select(F.col("v").alias("token")), "copies-cut")
        near = near.where("u is not null")
        joined = _grown(joined, _checked(near.join(tried, ["u", "v"], "left_anti"), docs, distinct, similarity, words))
        if cut.isEmpty():
            break
        tried = tried.union(near)
        # All pairs of the other shingles have been tried.
        shared = materialise(shared.join(cut, "token", "left_semi"), "copies-rest")
        nearest *= MORE
    rows = named.where("node is not null").select("doc_id", "node")
    least = distinct.select("node", "doc_id").join(joined, "node", "left")
    least = materialise(least.select("node", "doc_id", F.coalesce("component", "node").alias("part")), "copies-nodes")
    names = least.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least.select("node", "part").join(names, "part"), "node").select("doc_id", "component_id")
