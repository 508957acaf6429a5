"""SimHash near-duplicates by popcount vectors on a grid.

A 64-bit fingerprint is cut into 16 segments of four bits; the bit count of each segment
gives a point of a 16-dimensional grid.  The Manhattan distance of two points never exceeds
the number of differing bits, so pairs within two bits lie within distance two, and two such
points share a grid cell at distance one or less from both.  Each fingerprint is therefore
put into its own cell and the cells one step away (33 at most), equal cells are brought
together, and every pair found is checked on its bits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm import near_copies
from quietlog.llm.common import components, shingles, slices, texts
from quietlog.session import scratch_dir
from quietlog.sources.tables import materialise

SEED = 42
SHINGLE_WORDS = 3
#: Fingerprints of one cell that are compared with each other directly; a fuller cell goes by single bit flips.
CELL_PAIRS = 512
#: Bytes of text whose shingles are held at once.
CHUNK_BYTES = 4 << 20
_LANES = np.uint64(0x0101010101010101)


def fingerprint_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per document from all shingle hashes, document after document."""
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    n = counts[full]
    first = np.cumsum(n) - n
    chunks = -(-n // 255)  # a byte lane counts up to 255
    head = np.cumsum(chunks) - chunks
    edges = np.repeat(first - head * 255, chunks) + np.arange(chunks.sum()) * 255
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, edges)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        for byte in range(8):  # little-endian: byte b of lane k is bit 8 b + k
            result[full] |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return result


def cell_of(fingerprints: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 segments, four bits each."""
    x = fingerprints - ((fingerprints >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, bits, cell): one per row of ``docs``; a null text has no words and fingerprint zero."""
    def run(batches):
        for batch in slices(batches, CHUNK_BYTES):
            each = [shingles(t, SHINGLE_WORDS, SEED) for t in texts(batch)]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            bits = fingerprint_bits(np.concatenate(each), counts)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array(bits.view(np.int64)), pa.array(cell_of(bits).view(np.int64)),
            ], ["doc_id", "bits", "cell"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, bits long, cell long")


def _near_in_cells(batches):
    """Links between the fingerprints of each cell; rows come sorted by cell.

    Groups up to CELL_PAIRS are compared at once.  Rows of a fuller cell are passed on
    with a null link, so memory is bounded whatever a cell holds.
    """
    cell, held, full = None, [], False

    def flush():
        if full or len(held) < 2:
            return []
        bits = np.array([h[0] for h in held], np.int64).view(np.uint64)
        nodes = np.array([h[1] for h in held], np.int64)
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
        label = np.arange(len(held))
        while True:  # the smallest position reachable inside the cell
            least = np.where(near, label[None, :], len(held)).min(axis=1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        return [(int(nodes[label[i]]), int(nodes[i]), None) for i in range(len(held)) if label[i] != i]

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["u", "v", "bits"])

    rows = []
    for batch in batches:
        for c, b, node in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if c != cell:
                rows += flush()
                cell, held, full = c, [], False
            if full:
                rows.append((node, node, b))
                continue
            held.append((b, node))
            if len(held) > CELL_PAIRS:
                rows += [(n, n, x) for x, n in held]
                held, full = [], True
        if len(rows) > 20_000:
            yield out(rows)
            rows = []
    rows += flush()
    if rows:
        yield out(rows)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints at two or fewer differing bits.

    ``distinct`` has one row (bits, cell, node) per fingerprint.  The links are a
    spanning set: fingerprints of one cell are joined to one of them, not all pairs.
    Fingerprints of overfull cells go by exact single flips: within two bits means a
    common value one flip or less from both, and all that share such a value are linked.
    """
    step = F.expr("""
        flatten(transform(sequence(0, 15), i -> filter(array(
            cell + shiftleft(1L, 4 * i),
            if((shiftrightunsigned(cell, 4 * i) & 15L) > 0, cell - shiftleft(1L, 4 * i), null)), c -> c is not null)))
    """)
    cells = distinct.where("node is not null").select(
        F.explode(F.concat(F.array("cell"), step)).alias("cell"), "bits", "node")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    found = materialise(cells.mapInArrow(_near_in_cells, "u long, v long, bits long"), "simhash-links")
    crowded = found.where("bits is not null").select("bits", F.col("u").alias("node")).distinct()
    flips = crowded.select(
        F.explode(F.expr("concat(array(bits), transform(sequence(0, 63), i -> bits ^ shiftleft(1L, i)))")).alias("value"), "node")
    least = flips.groupBy("value").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("value", "u")
    stars = flips.join(least, "value").select("u", F.col("node").alias("v"))
    return found.where("bits is null").select("u", "v").union(stars.where("u <> v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of two or fewer bits.
    Nulls: a null text is an empty one (fingerprint zero, linked like any other); rows
    whose doc_id is null get the component of their fingerprint if another row has it,
    else null.  Repeated rows come out as often as they come in.  An empty table gives
    an empty result.  Other columns of ``docs`` are not looked at.
    """
    prints = fingerprints(docs)
    path = scratch_dir(docs.sparkSession, "simhash")
    prints.write.parquet(path)
    prints = docs.sparkSession.read.schema(prints.schema).parquet(path)
    distinct = materialise(prints.groupBy("bits", "cell").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    found = components(links(distinct))
    groups = distinct.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return prints.join(groups, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of smallest doc_id.

    Near copies have 5-word shingles of a Jaccard similarity of 0.8 or more (``near_copies``).
    Of rows with equal doc_id one stays.  Rows whose doc_id is null stay as they are:
    nothing can name them.
    """
    kept = near_copies.groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).union(docs.where("doc_id is null"))
