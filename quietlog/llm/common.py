"""Shared helpers: packed arrays, whole-batch iteration, connected components."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.sources.tables import materialise

#: Latin capitals to small letters, all other bytes as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_held: dict = {}


def held(name, make):
    """What this worker keeps from one task to the next; asking for another thing lets go of the one before."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Free what earlier tasks of this worker kept; for tasks that need the memory themselves."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def pack(values: np.ndarray) -> bytes:
    """A numeric array as compressed bytes, all first bytes of its numbers, then all second ones and so on."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; a null is an empty text."""
    return [x or "" for x in column(batch, name)]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most_bytes`` of text, one row at least."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(name))
        lengths = np.asarray(pc.fill_null(pc.binary_length(array), 0))
        start, size = 0, 0
        for i, length in enumerate(lengths):
            if size + length > most_bytes and i > start:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(length)
        if batch.num_rows > start:
            yield batch.slice(start)


def shingles(text: str, size: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six white space bytes
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    starts = [0]
    at = 0
    for word in words:
        at += len(word) + 1
        starts.append(at)
    count = len(words) - size + 1
    return np.fromiter((digest(line[a:b - 1], seed) for a, b in zip(starts, starts[size:])), np.uint64, count)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, component), the smallest node.

    Rounds of large star and small star (Kiveris et al., 2014) on written tables, so
    that lineage stays short and a lost executor costs one round.  A round groups by
    node only to find a minimum, which merges in the map tasks; a node with very many
    neighbours is never gathered.  Nodes without an edge to another node do not occur in the
    result.  Null nodes and loops are ignored.
    """
    links = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = materialise(links, purpose)

    def mark(frame):
        row = frame.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def star(frame, both):
        """Each node's neighbours move to the smallest node among it and its neighbours."""
        reverse = frame.select(F.col("v").alias("u"), F.col("u").alias("v"))
        sides = frame.union(reverse) if both else reverse
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = sides.join(least, "u")
        if both:
            return joined.where("v > u").select(F.col("m").alias("u"), "v").where("u <> v")
        moved = joined.where("v <> m").select(F.col("m").alias("u"), "v")
        return moved.union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))

    before = None
    while (now := mark(links)) != before and now[0]:
        before = now
        # frame rows are (smaller, larger): the large star looks at both sides, the small star at smaller neighbours
        links = materialise(star(star(links, True).distinct(), False).distinct(), purpose)
    return links.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
