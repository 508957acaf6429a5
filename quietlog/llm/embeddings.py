"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors by the concatenated signs of random projections and compares
every vector with the neighbours in a window of that order.  Verified pairs of all passes are united.
Vectors so close that every two of them must be linked are first joined to a ball, with its
centre and radius; the passes run over balls, so a large group of copies costs its number of
balls, and only balls whose distance leaves it open are compared member by member.
"""

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog.llm.common import column, components
from quietlog.session import scratch_dir
from quietlog.sources.tables import materialise

COSINE = 0.9
#: Vectors from which balls are made at once, and neighbours on either side that a pass compares.
BLOCK, WINDOW = 2048, 512
#: Members of a ball, about, that are compared at once with those of another.
CHUNK = 1024
#: Times that balls are joined to larger ones: a group of n copies becomes n / BLOCK ** LEVELS balls, about.
LEVELS = 2
#: Share of the pairs at exactly the threshold that the passes are to find; closer pairs are found more surely.
RECALL = 0.99
SEED = 8


def passes_for(count: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with the given chance among ``count`` vectors.

    The threshold is that of the centres where balls are paired.  A pair is found in a pass if its first log2(count / window) signs agree; the number of
    passes grows with the logarithm of the count.
    """
    agree = 1 - math.acos(cosine) / math.pi
    once = agree ** max(1, math.ceil(math.log2(max(2, count / window))))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _open_cosine(cosine: float, radii: list[float]) -> float:
    """Least cosine between the centres of two balls of these radii whose members may be linked."""
    return math.cos(min(0.99 * math.pi, math.acos(cosine) + sum(radii)))


def _keys(vectors: np.ndarray, number: int) -> np.ndarray:
    """Signs of 63 projections, the first one highest."""
    planes = np.random.default_rng((SEED, number, vectors.shape[1])).standard_normal((vectors.shape[1], 63))
    return ((vectors @ planes > 0).astype(np.int64) << np.arange(62, -1, -1)).sum(axis=1)


def _by_size(raw: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _exact(sims: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which similarities reach the threshold; those within rounding of it are computed anew, pair by pair."""
    result = sims >= cosine
    for k in np.flatnonzero(np.abs(sims - cosine) < 1e-9):
        x, y = a[k] / np.abs(a[k]).max(), b[k] / np.abs(b[k]).max()
        result[k] = float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))) >= cosine
    return result


def _numbered(embeddings: DataFrame) -> DataFrame:
    """Rows (row, vec_id, vector): vector is null where nothing can be linked."""
    def run(batches):
        for batch in batches:
            raw = []
            for x in column(batch, "embedding"):
                try:
                    v = np.array(x, np.float64) if x else None
                except (TypeError, ValueError):  # a null among the components
                    v = None
                good = v is not None and np.isfinite(v).all() and v.any()
                raw.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), pa.array(raw, pa.binary())], ["vec_id", "vector"])

    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, vector binary")
    path = scratch_dir(spark, "vectors")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.schema("vec_id long, vector binary, row long").parquet(path)


def _with_key(rows: DataFrame, name: str, passes: Iterable[int]) -> DataFrame:
    """``rows`` once per pass, with the pass and the key of their vector ``name``."""
    schema = rows.schema.simpleString()[len("struct<"):-1] + ",pass:int,key:bigint"

    def run(batches):
        for batch in batches:
            raw = column(batch, name)
            for size, mine in _by_size(raw).items():
                part = batch.take(pa.array(mine))
                vectors = _unit(_matrix([raw[i] for i in mine]))
                for p in passes:
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(mine), p, np.int32)), pa.array(_keys(vectors, p))],
                        [*batch.schema.names, "pass", "key"])

    return rows.mapInArrow(run, schema)


def _balls(items: DataFrame, cosine: float, number: int) -> DataFrame:
    """Join items (item, centre, radius, size) that lie in one ball: rows (item, ball, centre, radius, size).

    A ball's radius covers all its vectors and is at most half the angle of the threshold, so every two of
    them are linked.  The last three columns are set on the row of the item that names the ball.
    """
    most = math.acos(cosine) / 2 - 1e-7

    def run(batches):
        def out(held):
            raw = [h[1] for h in held]
            found = []
            for _, mine in _by_size(raw).items():
                original = _matrix([raw[i] for i in mine])
                unit = _unit(original)
                radius = np.array([held[i][2] for i in mine])
                size = np.array([held[i][3] for i in mine])
                close = np.arccos(np.clip(unit @ unit.T, -1, 1)) + radius[None, :] <= most
                np.fill_diagonal(close, True)
                free = np.ones(len(mine), bool)
                alone = close.sum(axis=1) == 1
                for i in range(len(mine)):
                    if not free[i]:
                        continue
                    members = np.array([i]) if alone[i] else np.flatnonzero(close[i] & free)
                    ball = (original[i].tobytes(), float(radius[i]), int(size[i]))
                    if len(members) > 1:
                        middle = _unit((unit[members] * size[members, None]).sum(axis=0)[None])[0]
                        far = np.arccos(np.clip(unit[members] @ middle, -1, 1)) + radius[members] + 1e-8
                        fits = far <= most
                        if fits.sum() > 1 and fits[members == i][0]:
                            members = members[fits]
                            ball = (middle.tobytes(), float(far[fits].max()), int(size[members].sum()))
                        else:
                            members = np.array([i])  # the centre moved away: this item stays alone
                    free[members] = False
                    found += [(held[mine[m]][0], held[mine[i]][0], *(ball if m == i else (None, None, None))) for m in members]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)],
                                              ["item", "ball", "centre", "radius", "size"])

        held = []
        for batch in batches:
            held += zip(*(column(batch, c) for c in ("item", "centre", "radius", "size")))
            while len(held) >= BLOCK:
                yield out(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield out(held)

    keyed = _with_key(items, "centre", [number])
    keyed = keyed.repartitionByRange("key", "item").sortWithinPartitions("key", "item").select("item", "centre", "radius", "size")
    return materialise(keyed.mapInArrow(run, "item long, ball long, centre binary, radius double, size long"), "balls")


_PAIR = "a long, b long, sure boolean, part long, side int, pass int, key long, ball long, centre binary, radius double"
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64())
_NAMES = ["a", "b", "sure", "part", "side", "pass", "key", "ball", "centre", "radius"]


def _window(cosine: float, window: int, edges: bool):
    """Compare rows (part, side, pass, key, ball, centre, radius), sorted, with those up to ``window`` before them.

    Pairs come out as (a, b, sure).  With ``edges`` the first and last rows of the partition come out too,
    to be compared across its borders; without it rows are grouped by ``part`` and only pairs of
    different sides count.
    """
    angle = math.acos(cosine)

    def pairs(held, begin):
        """Of rows from ``begin`` on with all held before them."""
        raw = [h[5] for h in held]
        for _, mine in _by_size(raw).items():
            new = mine[mine >= begin]
            if not len(new):
                continue
            original = _matrix([raw[i] for i in mine])
            unit = _unit(original)
            radius = np.array([held[i][6] for i in mine])
            start = len(mine) - len(new)
            sims = unit[start:] @ unit.T
            i, j = np.nonzero(sims >= math.cos(min(math.pi, angle + 2 * radius.max())) - 1e-9)
            i += start
            keep = j < i
            i, j = i[keep], j[keep]
            sim, reach = sims[i - start, j], radius[i] + radius[j]
            both = reach == 0
            sure = np.zeros(len(i), bool)
            sure[both] = _exact(sim[both], original[i[both]], original[j[both]], cosine)
            apart = np.arccos(np.clip(sim, -1, 1))
            sure |= ~both & (apart + reach <= angle - 1e-7)
            open_ones = ~both & ~sure & (apart - reach <= angle + 1e-7)
            for k in np.flatnonzero(sure | open_ones):
                x, y = held[mine[i[k]]], held[mine[j[k]]]
                if x[4] != y[4] and (edges or x[1] != y[1]):
                    yield min(x[4], y[4]), max(x[4], y[4]), bool(sure[k]), *(None,) * 7

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)

    def run(batches):
        number = TaskContext.get().partitionId()
        held, begin, group, seen, head = [], 0, None, 0, []
        tail: list = []
        for batch in batches:
            rows = []
            for row in zip(*(column(batch, c) for c in _NAMES[3:])):
                if (row[0], row[2]) != group:
                    rows += pairs(held, begin)
                    held, begin, group = [], 0, (row[0], row[2])
                held.append(row)
                if len(held) - begin >= BLOCK:
                    rows += pairs(held, begin)
                    held = held[-window:]
                    begin = len(held)
                if edges:
                    if seen < window:
                        head.append(row)
                    tail.append(row)
                    if len(tail) >= 2 * window:
                        tail = tail[-window:]
                    seen += 1
            if rows:
                yield out(rows)
        rows = list(pairs(held, begin))
        if edges:  # the head meets the partition before, the tail the one behind
            rows += [(None, None, None, number, 1, *r[2:]) for r in head]
            rows += [(None, None, None, number + 1, 0, *r[2:]) for r in tail[-window:]]
        if rows:
            yield out(rows)

    return run


def _candidates(balls: DataFrame, cosine: float, window: int, recall: float) -> DataFrame:
    """Distinct pairs (a, b, sure) of balls that are linked for sure or may be."""
    largest = [r["radius"] for r in balls.orderBy(F.desc("radius")).select("radius").head(2)]
    passes = passes_for(balls.count(), _open_cosine(cosine, largest), window, recall)
    keyed = _with_key(balls.select("ball", "centre", "radius"), "centre", range(passes))
    keyed = keyed.select(F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "pass", "key", "ball", "centre", "radius")
    spread = keyed.repartitionByRange("pass", "key", "ball").sortWithinPartitions("pass", "key", "ball")
    found = materialise(spread.mapInArrow(_window(cosine, window, True), _PAIR), "embedding-pairs")
    borders = found.where("a is null").select(*_NAMES[3:])
    across = borders.repartition("part").sortWithinPartitions("part", "pass", "side", "key", "ball")
    across = across.mapInArrow(_window(cosine, window, False), _PAIR)
    pairs = found.where("a is not null").union(across).select("a", "b", "sure")
    return materialise(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure")), "embedding-links")


def _chunked(pairs: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (a, b, ball, row, left, right): members of both balls, once per chunk of the other side.

    ``sizes`` has rows (ball, size).  Each pair of members meets in one group of (a, b, left, right), whose
    size does not depend on the balls.
    """
    chunks = sizes.select("ball", F.ceil(F.col("size") / CHUNK).alias("chunks"))
    for side in ("a", "b"):
        pairs = pairs.join(chunks.select(F.col("ball").alias(side), F.col("chunks").alias(f"{side}_chunks")), side)
    sides = pairs.select(F.explode(F.array("a", "b")).alias("ball"), "a", "b", "a_chunks", "b_chunks")
    rows = sides.join(members, "ball")
    first = F.col("ball") == F.col("a")
    own = F.pmod(F.xxhash64("row"), F.when(first, F.col("a_chunks")).otherwise(F.col("b_chunks")))
    rows = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(first, F.col("b_chunks")).otherwise(F.col("a_chunks")) - 1)))
    return rows.select("a", "b", "ball", "row", F.when(first, F.col("own")).otherwise(F.col("other")).alias("left"),
                       F.when(first, F.col("other")).otherwise(F.col("own")).alias("right"))


def _members(pairs: DataFrame, members: DataFrame, sizes: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Links between the members of ball pairs that are open: rows (row, a, b, n), n links of the row's vector to one chunk."""
    rows = _chunked(pairs, members, sizes).join(vectors.select("row", "vector"), "row")

    def run(table: pa.Table) -> pa.Table:
        a, b, ball = table["a"][0].as_py(), table["b"][0].as_py(), np.asarray(table["ball"])
        row, raw = np.asarray(table["row"]), table["vector"].to_pylist()
        left, right = np.flatnonzero(ball == a), np.flatnonzero(ball == b)
        if len(left) and len(right):
            x, y = _matrix([raw[i] for i in left]), _matrix([raw[i] for i in right])
            sims = _unit(x) @ _unit(y).T
            linked = sims >= cosine
            i, j = np.nonzero(np.abs(sims - cosine) < 1e-9)
            for k in range(0, len(i), CHUNK):
                p, q = i[k:k + CHUNK], j[k:k + CHUNK]
                linked[p, q] = _exact(sims[p, q], x[p], y[q], cosine)
            n = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
        else:
            n = np.zeros(len(left) + len(right), np.int64)
        rows = np.concatenate([row[left], row[right]])
        keep = n > 0
        size = int(keep.sum())
        return pa.table({"row": rows[keep], "a": np.full(size, a), "b": np.full(size, b), "n": n[keep].astype(np.int64)})

    grouped = rows.groupBy("a", "b", "left", "right")
    return materialise(grouped.applyInArrow(run, "row long, a long, b long, n long"), "embedding-members")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``embeddings``.

    Vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing;
    vectors of different length neither.  Rows that share a vec_id are vectors of their own; the component
    is the smallest vec_id in it (null where all are null), and ``kept`` tells whether it is the row's own.
    """
    vectors = _numbered(embeddings)
    good = vectors.where("vector is not null")
    balls = good.select(F.col("row").alias("item"), F.col("vector").alias("centre"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("size"))
    members = None
    for level in range(LEVELS):  # each level joins up to BLOCK balls of the one before
        found = _balls(balls, cosine, level)
        upper = found.select(F.col("item"), F.col("ball"))
        members = upper.withColumnRenamed("item", "row") if members is None else members.withColumnRenamed("ball", "item").join(upper, "item").select("row", "ball")
        balls = found.where("ball = item").select("item", "centre", "radius", "size")
    members = materialise(members, "ball-members")
    balls = balls.withColumnRenamed("item", "ball")
    pairs = _candidates(balls, cosine, window, recall)
    checked = _members(pairs.where("not sure"), members, balls.select("ball", "size"), vectors, cosine)
    sure = pairs.where("sure")
    edges = sure.select(F.col("a").alias("u"), F.col("b").alias("v")).union(checked.select(F.col("a"), F.col("b")))
    groups = components(edges, "embedding-components")
    sizes = balls.select("ball", "size")
    both = sure.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(sure.select("b", "a"))
    partners = both.join(sizes.select(F.col("ball").alias("other"), F.col("size").alias("n")), "other").groupBy("ball").agg(F.sum("n").alias("partners"))
    known = sizes.join(partners, "ball", "left").join(groups.select(F.col("node").alias("ball"), "component"), "ball", "left").select(
        "ball", (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("n"), F.coalesce("component", "ball").alias("component"))
    rows = members.join(known, "ball").join(good.select("row", "vec_id"), "row")
    more = checked.groupBy("row").agg(F.sum("n").alias("more"))
    rows = materialise(rows.join(more, "row", "left").select(
        "vec_id", "component", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links")), "embedding-rows")
    names = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = rows.join(names, "component").select("vec_id", "n_links", "component_id")
    rest = vectors.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
