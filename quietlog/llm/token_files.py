"""Token ids in bit-packed files.

File format, all numbers little-endian: ``BITPACK1``; eight int64 (bits, ids per block, documents,
ids, blocks, three zeros); int64 doc_id per document; bytes telling which doc_ids are null; int64 end (in ids) per
document; int64 byte offset per block; the blocks. A block holds BLOCK ids, the last one
fewer. Each id takes the fewest bits that hold the vocabulary, packed from the lowest bit of
64-bit words, so 64 ids always fill ``bits`` words and unpack column by column.
"""


import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietlog.llm.common import column, slices, texts
from quietlog.llm.encoding import encoder, with_end
from quietlog.llm.url_rules import open_store
from quietlog.session import scratch_dir

MAGIC = b"BITPACK1"
BLOCK = 1 << 16
#: Bytes of text per file, about.
SHARD_BYTES = 24 << 20
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 4 << 20


def pack_bits(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as 64-bit words, ``bits`` bits each, padded with zeros to a multiple of 64 ids."""
    rows = -(-len(ids) // 64)
    full = np.zeros(rows * 64, np.uint64)
    full[:len(ids)] = ids
    full = full.reshape(rows, 64)
    words = np.zeros((rows, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= full[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= full[:, k] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    rows = words.reshape(-1, bits)
    ids = np.empty((len(rows), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | rows[:, word + 1] << np.uint64(64 - shift)
        ids[:, k] = value & mask
    return ids.reshape(-1)[:count]


def write_file(store: fs.FileSystem, path: str, doc_ids: list, ends: np.ndarray, parts: list[bytes], offsets: list[int], bits: int) -> None:
    with store.open_output_stream(path) as out:
        out.write(MAGIC)
        out.write(np.array([bits, BLOCK, len(doc_ids), ends[-1] if len(ends) else 0, len(offsets), 0, 0, 0], "<i8").tobytes())
        out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        out.write(np.array([x is None for x in doc_ids], "u1").tobytes())
        out.write(ends.astype("<i8").tobytes())
        out.write(np.array(offsets, "<i8").tobytes())
        for part in parts:
            out.write(part)


class TokenFile:
    """Random access to one file: reads the head, then only the blocks that are asked for."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        head = self.file.read_at(72, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block, self.documents, self.tokens, self.blocks = (int(x) for x in np.frombuffer(head[8:48], "<i8"))
        at = 72
        self.doc_ids = np.frombuffer(self.file.read_at(8 * self.documents, at), "<i8")
        self.nulls = np.frombuffer(self.file.read_at(self.documents, at + 8 * self.documents), "u1").astype(bool)
        at += 9 * self.documents
        self.ends = np.frombuffer(self.file.read_at(8 * self.documents, at), "<i8")
        self.offsets = np.frombuffer(self.file.read_at(8 * self.blocks, at + 8 * self.documents), "<i8")
        self.base = at + 8 * self.documents + 8 * self.blocks

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to before ``end``."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            count = min(self.block, self.tokens - k * self.block)
            size = -(-count // 64) * self.bits * 8
            words = np.frombuffer(self.file.read_at(size, self.base + int(self.offsets[k])), "<u8")
            parts.append(unpack_bits(words, self.bits, count))
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write(docs: DataFrame, file: str, end: int) -> tuple[str, DataFrame]:
    """Encode and write ``docs`` in ascending doc_id order; (folder, manifest).

    Rows are dealt to shards by ranges of doc_id: shard bounds are approximate quantiles,
    weighted by nothing but the row count, and a shard is sorted in its task. Rows of equal
    doc_id lie together, in as many shards as they need; null doc_ids come first. A null text is an empty one and
    gets the end id only. The manifest has a row (shard, file, documents, tokens) per shard. A
    file is written under a name of its own, and only files in the manifest count, so repeated
    tasks do no harm.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = 1 + size // SHARD_BYTES
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # splits a doc_id that many rows share
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    spread = rows.repartitionByRange(int(shards), *order).sortWithinPartitions(*order)

    def run(batches):
        import uuid
        code = encoder(file)
        bits = max(1, (max(code.vocabulary, end + 1) - 1).bit_length())
        doc_ids, ends, parts, offsets, first_row = [], [], [], [], None
        rest, total, written = np.zeros(0, np.int32), 0, 0

        def add(ids):
            nonlocal written
            data = pack_bits(ids, bits).astype("<u8").tobytes()
            offsets.append(written)
            parts.append(data)
            written += len(data)

        for batch in slices(batches, CHUNK_BYTES):
            ids, counts = with_end(*code.encode(texts(batch)), end)
            doc_ids += column(batch, "doc_id")
            first_row = batch.column(2)[0].as_py() if first_row is None else first_row
            ends.append(total + np.cumsum(counts))
            total += len(ids)
            rest = np.concatenate([rest, ids])
            while len(rest) >= BLOCK:
                add(rest[:BLOCK])
                rest = rest[BLOCK:]
        if not doc_ids:
            return
        if len(rest):
            add(rest)
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        write_file(store, f"{base}/{name}", doc_ids, np.concatenate(ends), parts, offsets, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([doc_ids[0]], pa.int64()), pa.array([first_row], pa.int64()), pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())],
            ["first_id", "first_row", "file", "documents", "tokens"])

    manifest = f"{folder}/manifest"
    schema = "first_id long, first_row long, file string, documents long, tokens long"
    spread.mapInArrow(run, schema).write.parquet(manifest)
    return folder, spark.read.schema(schema).parquet(manifest)


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all files, ids as little-endian unsigned 32-bit integers.

    Starts follow from the manifest: one row per file, summed in one small window.
    """
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_row").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    files = files.repartition(max(1, manifest.count()), "file")  # a number of its own keeps small rows from being put together

    def run(batches):
        store, base = open_store(folder)
        for batch in batches:
            for name, start in zip(column(batch, "file"), column(batch, "base")):
                source = TokenFile(store, f"{base}/{name}")
                k = 0
                while k < source.documents:  # some whole documents at a time
                    begin = int(source.ends[k - 1]) if k else 0
                    last = max(k + 1, int(np.searchsorted(source.ends, begin + 16 * source.block, "right")))
                    ids = source.ids(begin, int(source.ends[last - 1])).astype("<u4")
                    starts = np.concatenate([[begin], source.ends[k:last - 1]])
                    ends = source.ends[k:last]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(source.doc_ids[k:last], mask=source.nulls[k:last]), pa.array(starts + start), pa.array(ends - starts),
                        pa.array([ids[a - begin:b - begin].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])
                    k = last

    return files.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def summary(docs: DataFrame, file: str, end: int) -> DataFrame:
    """Per document what its file says: doc_id, start, n_tokens, ids_crc32."""
    folder, manifest = write(docs, file, end)
    return read(docs.sparkSession, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


