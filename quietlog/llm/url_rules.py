"""URL filters by a sorted array of 64-bit digests.

Rules are written once as shards of the sorted digests of their strings, with the strings
beside them.  Every task memory-maps the shards, probes all candidate strings of a
batch by one binary search, and confirms a hit by its stored string.
"""

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.llm.common import LOWER, column
from quietlog.session import scratch_dir

RULES_PER_SHARD = 4_000_000
#: Probes of one binary search at most.
PROBES = 500_000


@dataclass(frozen=True)
class Index:
    """Where the shards lie, with the lengths that candidates can have."""
    path: str
    labels: tuple[int, ...]  # numbers of host labels among the rules
    prefixes: tuple[int, ...]  # numbers of path characters among the rules


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"), slash + path


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def build(rules: DataFrame, shards: int | None = None) -> Index:
    """Write rules (host, path, verdict) as digest shards; of equal rules block wins.

    Rows that no url can fit (a null or empty host, one with a slash, a path that is null or
    has no leading slash) and those with another verdict than allow or block are left out.  Spark sorts the rules by digest; each shard is one file below the shared folder,
    written to a name of its own and renamed, so a repeated task does no harm.
    """
    spark = rules.sparkSession
    path = scratch_dir(spark, "url-rules")
    rules = rules.where(
        "host <> '' and host not like '%/%' and (path = '' or path like '/%') and verdict in ('allow', 'block')").select(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = rules.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", "\\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("prefixes")).first()
    shards = shards or 1 + lengths["n"] // RULES_PER_SHARD
    rows = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("cut"), "verdict")
    rows = rows.withColumn("digest", F.xxhash64("rule")).repartitionByRange(shards, "digest")

    def write(batches):
        found = [r for batch in batches for r in zip(*(column(batch, c) for c in ("rule", "cut", "verdict")))]
        if not found:
            return
        found = sorted((xxhash.xxh64_intdigest(rule, 42), rule, cut, verdict == "block") for rule, cut, verdict in found)
        text = [rule.encode() for _, rule, _, _ in found]
        ends = np.cumsum([0, *map(len, text)])
        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        head = np.array([len(found), ends[-1]], "<i8")
        with store.open_output_stream(f"{name}.part") as out:
            for part in (head, np.array([f[0] for f in found], "<u8"), ends.astype("<i8"), np.array([f[2] for f in found], "<i4"),
                         np.array([f[3] for f in found], "u1"), np.frombuffer(b"".join(text), "u1")):
                out.write(part.tobytes())
        first = f"{base}/rules-{found[0][0]:016x}"  # the same rows give the same name
        store.move(f"{name}.part", first)
        yield pa.RecordBatch.from_arrays([pa.array([first])], ["file"])

    rows.select("rule", "cut", "verdict").mapInArrow(write, "file string").collect()  # one name per shard
    return Index(path, tuple(sorted(lengths["labels"])), tuple(sorted(lengths["prefixes"])))


class Shard:
    """One memory-mapped file of sorted digests."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, size = (int(x) for x in data[:16].view("<i8"))
        at = np.cumsum([16, 8 * n, 8 * (n + 1), 4 * n, n])
        self.digests = data[at[0]:at[1]].view("<u8")
        self.ends = data[at[1]:at[2]].view("<i8")
        self.cuts = data[at[2]:at[3]].view("<i4")
        self.blocks = data[at[3]:at[4]]
        self.text = data[at[4]:at[4] + size]

    def probe(self, digests: np.ndarray, rules: list[bytes]) -> list[tuple[int, bool]]:
        """(position of the candidate, whether it blocks) of every confirmed hit."""
        at = np.searchsorted(self.digests, digests)
        maybe = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests))
        hits = []
        for k in maybe:
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == digests[k]:  # equal digests of different rules
                if self.text[self.ends[i]:self.ends[i + 1]].tobytes() == rules[k]:
                    hits.append((int(k), bool(self.blocks[i])))
                    break
                i += 1
        return hits


_open: dict[str, list[Shard]] = {}


def _shards(path: str) -> list[Shard]:
    """The shards of an index, opened once per worker; from a remote store by way of the task's own temporary folder."""
    if path not in _open:
        store, base = open_store(path)
        names = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if "/rules-" in f.path]
        if not isinstance(store, fs.LocalFileSystem):
            folder = tempfile.mkdtemp(prefix="url-rules-")
            local = []
            for name in names:
                local.append(os.path.join(folder, os.path.basename(name)))
                fs.copy_files(name, local[-1], source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            names = local
        _open.clear()
        _open[path] = [Shard(name) for name in names]
    return _open[path]


def judge(pages: DataFrame, index: Index, default: str = "allow") -> DataFrame:
    """Rows (page_id, url, host, path, rule, verdict), one per page.

    A rule fits its host and all subdomains if the path starts with the rule's; of several the
    longest string wins, and a longer host among equally long ones.  Where none fits, the
    rule is null and the verdict is ``default``: the array holds no digest of it.  A null url
    or one without ``://`` has an empty host and path and gets the default.
    """
    def run(batches):
        shards = _shards(index.path)
        labels, prefixes = set(index.labels), index.prefixes
        for whole in batches:
            for first in range(0, whole.num_rows, 5_000):
                batch = whole.slice(first, 5_000)
                urls = column(batch, "url")
                parts = [split_url(u) for u in urls]
                best: dict[int, tuple[int, int, str, bool]] = {}
                owner, rules, cuts = [], [], []

                def probe():
                    digests = np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in rules), np.uint64, len(rules))
                    for shard in shards:
                        for k, blocks in shard.probe(digests, rules):
                            text = rules[k].decode("utf-8", "surrogatepass")
                            best[owner[k]] = max(best.get(owner[k], (-1, -1, "", False)), (len(text), cuts[k], text, blocks))
                    owner.clear(), rules.clear(), cuts.clear()

                for i, (host, path) in enumerate(parts):
                    pieces = host.rsplit(".", max(labels, default=0)) if host else []
                    for k in range(1, len(pieces) + 1):
                        if k not in labels or (k == len(pieces) and "." in pieces[0]):
                            continue
                        suffix = ".".join(pieces[-k:])
                        for n in prefixes:
                            if n > len(path):
                                break
                            owner.append(i)
                            rules.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
                            cuts.append(len(suffix))
                    if len(rules) >= PROBES:
                        probe()
                probe()
                yield pa.RecordBatch.from_arrays([
                    batch.column(batch.schema.get_field_index("page_id")), pa.array(urls, pa.string()),
                    pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                    pa.array([best[i][2] if i in best else None for i in range(len(parts))], pa.string()),
                    pa.array([("block" if best[i][3] else "allow") if i in best else default for i in range(len(parts))]),
                ], ["page_id", "url", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(
        run, "page_id long, url string, host string, path string, rule string, verdict string")


def rule_frame(spark: SparkSession, rules) -> DataFrame:
    """A small rule list (host, path, verdict) as a frame."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
