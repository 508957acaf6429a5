"""Best-fit packing of token pieces by exact complements.

The plan works on the histogram of piece lengths, which has as many entries as a sequence has
tokens, however many documents there are.  Only the lengths decide which pieces share a sequence,
so pieces are numbered within their length and read their place from the plan.
"""

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietlog.llm.common import column, slices, texts
from quietlog.llm.encoding import KEPT_PIECES, encoder, with_end
from quietlog.session import scratch_dir

SEQUENCE = 1024
CHUNK_BYTES = 1 << 20
#: Pieces numbered in one task, about.
NUMBERED = 200_000


def pieces(docs: DataFrame, file: str, end: int, sequence: int = SEQUENCE, kept: int = KEPT_PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids) of all documents, written once.

    Documents of more than ``sequence`` ids are cut into pieces of that length; the first one is shorter
    if the length is no multiple.  A null text is an empty one: the end id alone.  ``ids``
    are little-endian unsigned 32-bit integers.
    """
    def run(batches):
        code = encoder(file, kept)
        for batch in slices(batches, CHUNK_BYTES):
            ids, counts = with_end(*code.encode(texts(batch)), end)
            data = memoryview(ids.astype("<u4").tobytes())
            n = -(-counts // sequence)  # pieces of each document
            owner = np.repeat(np.arange(len(counts)), n)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = counts - (n - 1) * sequence
            begin = np.where(number == 0, 0, first[owner] + (number - 1) * sequence)
            length = np.where(number == 0, first[owner], sequence)
            base = (np.cumsum(counts) - counts)[owner] + begin
            doc_ids = column(batch, "doc_id")
            yield pa.RecordBatch.from_arrays([
                pa.array([doc_ids[i] for i in owner], pa.int64()), pa.array(number.astype(np.int32)), pa.array(begin), pa.array(length),
                pa.array([bytes(data[4 * a:4 * (a + b)]) for a, b in zip(base, length)], pa.binary()),
            ], ["doc_id", "piece", "start", "length", "ids"])

    spark = docs.sparkSession
    path = scratch_dir(spark, "pieces")
    schema = "doc_id long, piece int, start long, length long, ids binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    rows.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema + ", row long").parquet(path)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how often) that use up the histogram.

    Combinations of up to three, two or one lengths are tried, and the plan with the fewest
    sequences is taken: where short pieces are scarce, exact fits can spend them too early.
    """
    plans = [plan_with(histogram, sequence, most) for most in (3, 2, 1, 0)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def plan_with(histogram: dict[int, int], sequence: int, most: int) -> list[tuple[list[int], int]]:
    """One plan with exact fills of up to ``most`` lengths.

    From the longest length on, a sequence's gap is filled exactly by one, two or three shorter lengths
    that are still available: combinations are taken as often as all their lengths last, those of
    similar lengths first, so that the shortest ones are kept for later gaps.
    What no combination fits exactly goes best fit, longest first, into open sequences.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    result: list[tuple[list[int], int]] = []

    def take(lengths: list[int]) -> bool:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(left.get(x, 0) // n for x, n in need.items())
        if times:
            result.append((lengths, times))
            for x, n in need.items():
                left[x] -= n * times
                if not left[x]:
                    del left[x]
        return times > 0

    for longest in sorted(left, reverse=True) if most else ():
        gap = sequence - longest
        if gap == 0:
            if longest in left:
                take([longest])
            continue
        while longest in left:  # each pass takes a combination until one of its lengths is used up
            if longest >= gap and gap in left and take([longest, gap]):
                continue
            if most == 1:
                break
            sizes = sorted(x for x in left if x <= min(gap - 1, longest))
            held = set(sizes)
            if not any(gap - a in held and take([longest, a, gap - a]) for a in sizes if 2 * a >= gap):
                if most == 2:
                    break
                # pair sums of what is left, indexed by the sum
                pairs = {}
                for i, a in enumerate(sizes):
                    for b in sizes[i:]:
                        if a + b >= gap:
                            break
                        pairs[a + b] = (b, a)  # the last one is the most even
                if not any(gap - a in pairs and take([longest, a, *pairs[gap - a]]) for a in sizes if 3 * a >= gap):
                    break
    open_gaps: list[int] = []  # sorted gaps of open groups of equal sequences
    groups: dict[int, list[tuple[list[int], int]]] = defaultdict(list)

    def put(lengths: list[int], times: int) -> None:
        gap = sequence - sum(lengths)
        if gap == 0:
            result.append((lengths, times))
            return
        if not groups[gap]:
            bisect.insort(open_gaps, gap)
        groups[gap].append((lengths, times))

    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = sequence // length  # new sequences hold as many as fit
                full, rest = divmod(count, each)
                if full:
                    put([length] * each, full)
                if rest:
                    put([length] * rest, 1)
                break
            gap = open_gaps[at]
            lengths, times = groups[gap].pop()
            if not groups[gap]:
                open_gaps.pop(at)
            each = gap // length
            used = min(times, count // each)
            if used:
                put(lengths + [length] * each, used)
                count -= used * each
                if times > used:
                    put(lengths, times - used)
            else:
                put(lengths + [length] * count, 1)
                if times > 1:
                    put(lengths, times - 1)
                count = 0
    for gap in open_gaps:
        result += groups[gap]
    return result


def slots(planned: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from, to, sequence, offset): piece number k of a length with
    from <= k < to lies at ``offset`` of sequence ``sequence + k - from``."""
    rows = []
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in planned:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return rows


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, length) with the number k of each within its length, from 0.

    A common length is spread over buckets; the buckets' counts, summed per length, say
    where each starts, so no length needs one task of its own.
    """
    n = rows.count()
    buckets = 1 + n // NUMBERED
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(16, 16 * buckets))))
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    return spread.withColumn("within", within).join(counts, ["length", "bucket"]).select(
        "row", "length", (F.col("within") + F.col("first")).alias("k"))


def packed(docs: DataFrame, file: str, end: int, sequence: int = SEQUENCE, kept: int = KEPT_PIECES) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset), one per piece.

    Sequences hold at most ``sequence`` ids without gaps.  Rows with a null or a repeated
    doc_id are packed like others, each on its own.  An empty table gives no rows.
    A worker keeps the ids of about ``kept`` pieces of text, which costs memory and saves time.
    """
    spark: SparkSession = docs.sparkSession
    cut = pieces(docs, file, end, sequence, kept)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    places = slots(plan(histogram, sequence))
    lookup = defaultdict(lambda: ([], [], []))
    for length, first, _, number, offset in places:
        for part, value in zip(lookup[length], (first, number, offset)):
            part.append(value)
    lookup = {k: tuple(np.array(p, np.int64) for p in v) for k, v in lookup.items()}

    def place(batches):
        for batch in batches:
            row, length, k = (np.asarray(batch.column(i)) for i in range(3))
            number, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for x in np.unique(length):
                mine = length == x
                first, numbers, offsets = lookup[int(x)]
                at = np.searchsorted(first, k[mine], "right") - 1
                number[mine] = numbers[at] + k[mine] - first[at]
                offset[mine] = offsets[at]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(number), pa.array(offset)], ["row", "sequence_id", "offset"])

    placed = numbered(cut.select("row", "length")).mapInArrow(place, "row long, sequence_id long, offset long")
    return cut.withColumn("ids_crc32", F.crc32("ids")).join(placed, "row").drop("row")
