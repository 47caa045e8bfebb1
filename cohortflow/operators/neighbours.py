"""Exact k-nearest-neighbour join over numeric columns (Euclidean), by pivots.

No pairs leave a task and nothing is left out. Base vectors go to the cell of their nearest pivot; a large cell is cut into
rings by the distance from its pivot, and a large ring into blocks by a hash, so that a block is bounded whatever the data.
Every query first meets one block of its own cell, which gives a radius that its neighbours can't exceed. Then it goes to
those rings only that the triangle inequality cannot rule out within that radius. A task holds one block of base
vectors in leaves with bounds, streams the queries that visit it, looks into those leaves only that a query's radius reaches, and
sends the rows within that radius, k at most.

Equal vectors are asked for once, and of equal base vectors only those with the smallest keys can matter, so a vector that a third of
all rows share is no heavier than another. Pivots come from a bounded sample; they decide the work, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import runs, ship
from ..session import cut_lineage

#: Rings are described on the driver and sent to the tasks: never more than this many beyond one a cell.
MAX_RINGS = 4096
_CELLS = 1 << 21  # distances from pivots and rings computed at a time in a task
_PART = 1 << 15  # distances within a block computed at a time, so that they stay in the processor's cache
_LEAF = 64  # rows of a leaf


def vector(cols: Sequence[str]) -> Column:
    """The columns as an array of doubles; a NULL, NaN or infinite entry fails the query (impute first)."""
    def real(c):
        x = F.col(c).cast("double")
        return F.when(x.isNotNull() & (F.abs(x) < float("inf")), x + F.lit(0.0)).otherwise(
            F.raise_error(F.lit(f"{c} is NULL, NaN or infinite: impute it first")).cast("double"))
    return F.array(*[real(c) for c in cols])


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, added up column by column."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        d = x[:, None] - y[None, :]
        out += d * d
    return out


def _placed(pivots: np.ndarray):
    """Adds the nearest pivot and the distance from it."""
    step = max(1, _CELLS // len(pivots))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for lo in range(0, len(x), step):
                d = squared(x[lo:lo + step], pivots)
                cell[lo:lo + step] = d.argmin(axis=1)
                far[lo:lo + step] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])
    return run


class Rings:
    """Where base vectors lie: for each cell its rings, and for each ring its bounds, rows and blocks."""

    def __init__(self, pivots: np.ndarray, rows, block: int):
        self.pivots = pivots
        rows = sorted(rows, key=lambda r: (r["cell"], r["ring"]))
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.ring = np.array([r["ring"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], float) for c in ("low", "high"))
        self.rows = np.array([r["n"] for r in rows], np.int64)
        self.blocks = -(-self.rows // block)
        self.first = np.cumsum(self.blocks) - self.blocks  # number of a ring's first block

    def table(self, spark) -> DataFrame:
        """One row a ring (bounded, see :data:`MAX_RINGS`)."""
        cols = (self.cell, self.ring, self.first, self.blocks)
        return spark.createDataFrame(list(zip(*(c.tolist() for c in cols), strict=True)), "cell long, ring long, first long, blocks long")

    def radius(self, to: np.ndarray, need: int) -> np.ndarray:
        """For queries with distances ``to`` from all pivots: a distance within which ``need`` base rows lie for certain."""
        out = np.full(len(to), np.inf)
        for c in np.unique(self.cell):
            mine = np.flatnonzero(self.cell == c)
            enough = np.flatnonzero(np.cumsum(self.rows[mine]) >= need)
            if len(enough):
                out = np.minimum(out, to[:, c] + self.high[mine[enough[0]]])
        return out

    def reached(self, to: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Queries x rings: whether a vector of the ring can lie within the radius of the query."""
        between = np.sqrt(squared(self.pivots, self.pivots))
        own = to.argmin(axis=1)
        slack = radius * (1 + 1e-9) + 1e-300
        gap = between[own][:, self.cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (to[:, self.cell] ** 2 - to[np.arange(len(to)), own][:, None] ** 2) / (2 * gap), 0)
        rounding = 1e-9 * (1 + to[:, self.cell])
        off = np.maximum(np.maximum(to[:, self.cell] - self.high, self.low - to[:, self.cell]), plane) - rounding
        return off <= slack[:, None]


def _visits(rings: Rings, need: int):
    """The blocks that a query has to see besides the one it has seen."""
    step = max(1, _CELLS // (4 * max(len(rings.cell), len(rings.pivots))))

    def run(batches):
        for batch in batches:
            x, seen = _matrix(batch.column(1)), batch.column(2).to_numpy()
            radius = np.array(batch.column(3).to_numpy(zero_copy_only=False), float)
            for lo in range(0, len(x), step):
                to = np.sqrt(squared(x[lo:lo + step], rings.pivots))
                hit = rings.reached(to, np.minimum(radius[lo:lo + step], rings.radius(to, need)))
                who, ring = np.nonzero(hit)
                n = rings.blocks[ring]
                who, base = np.repeat(who, n), np.repeat(rings.first[ring], n)
                block = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
                other = block != seen[lo + who]
                part = batch.slice(lo, step)
                at = pa.array(who[other])
                yield pa.RecordBatch.from_arrays([pa.array(block[other]), *(part.column(c).take(at) for c in (0, 1, 3))], names=["block", "vid", "v", "radius"])
    return run


def leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in leaves of at most ``size`` near ones, halved along the widest column: (order of the rows, bounds of the leaves)."""
    order, ends, todo = np.arange(len(x)), [0], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            ends.append(hi)
            continue
        part = x[order[lo:hi]]
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)]
        todo += [(lo + half, hi), (lo, lo + half)]
    return order, np.array(ends)


class Block:
    """The base rows of one block in leaves, each with its bounds: a query skips the leaves that are farther than what it has."""

    def __init__(self, keys: pa.Array, x: np.ndarray, need: int):
        size = max(_LEAF, 2 * need)  # at least ``need`` rows in a leaf, unless it is the only one
        order, ends = leaves(x, size)
        self.keys, self.width = keys, x.shape[1]
        self.low, self.high = (f.reduceat(x[order], ends[:-1]) for f in (np.minimum, np.maximum))
        at = ends[:-1, None] + np.arange(np.diff(ends).max())
        self.place = np.where(at < ends[1:, None], order[np.minimum(at, len(x) - 1)], -1)  # leaves x rows, -1 where a leaf has ended
        self.x = [np.where(self.place < 0, np.nan, x[self.place, j]) for j in range(self.width)]
        self.rank = np.unique(np.array(keys.to_pylist()), return_inverse=True)[1]

    def distances(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Squared distances of each query from the rows of its leaf, added up as in :func:`squared`; NaN where it has ended."""
        out = np.zeros((len(x), self.place.shape[1]))
        for j in range(self.width):
            d = x[:, j, None] - self.x[j][leaf]
            out += d * d
        return out

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from the leaves' bounds: rounded alike, so never above those of the rows within."""
        out = np.zeros((len(x), len(self.low)))
        for j in range(self.width):
            c = x[:, j, None]
            d = np.maximum(np.maximum(self.low[:, j] - c, c - self.high[:, j]), 0)
            out += d * d
        return out

    def nearest(self, x: np.ndarray, limit: np.ndarray, need: int):
        """(query, row, squared distance), the ``need`` nearest of each query within its squared ``limit``, ties to the smaller key."""
        found = []
        step, pairs = max(1, _PART // len(self.low)), max(1, _PART // self.place.shape[1])
        for lo in range(0, len(x), step):
            some, far = x[lo:lo + step], limit[lo:lo + step].copy()
            gap = self.gaps(some)
            if len(self.rank) >= need:  # its own leaf says how far the others can matter
                own = gap.argmin(axis=1)
                for k in range(0, len(some), pairs):
                    d = np.partition(self.distances(some[k:k + pairs], own[k:k + pairs]), need - 1, axis=1)[:, need - 1]
                    far[k:k + pairs] = np.fmin(far[k:k + pairs], d)
            who, leaf = np.nonzero(gap <= far[:, None])
            for k in range(0, len(who), pairs):
                q, at = who[k:k + pairs], leaf[k:k + pairs]
                d = self.distances(some[q], at)
                if len(self.rank) >= need:  # the leaves reached say it better
                    np.fmin.at(far, q, np.partition(d, need - 1, axis=1)[:, need - 1])
                row, col = np.nonzero(d <= far[q, None])  # all ties too
                found.append((lo + q[row], self.place[at[row], col], d[row, col]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        who, at, dist = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((self.rank[at], dist, who))
        who, at, dist = who[by], at[by], dist[by]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < need
        return who[keep], at[keep], dist[keep]


def _meet(need: int, brief: bool):
    """Blocks of base rows, each followed by the queries that visit it, to the ``need`` nearest of each query. ``brief``: only
    queries that find some, and nothing besides."""
    def best(ask: pa.RecordBatch, block: Block):
        def col(c):
            return ask.column(ask.schema.get_field_index(c))
        radius = np.array(col("radius").to_numpy(zero_copy_only=False), float)
        who, at, dist = block.nearest(_matrix(col("v")), radius * radius * (1 + 1e-12) + 1e-300, need)
        n = np.bincount(who, minlength=len(ask))
        ends = np.r_[0, np.cumsum(n)].astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(np.sqrt(dist)), block.keys.take(pa.array(at))], names=["distance", "neighbour"])
        if brief:
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([col("vid").take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.r_[ends[some], ends[-1]]), near)],
                                              names=["vid", "near"])
        last = np.sqrt(dist[np.maximum(ends[1:] - 1, 0)]) if len(dist) else 0.0
        return pa.RecordBatch.from_arrays([*(col(c) for c in ("vid", "v", "block")), pa.array(np.where(n == need, last, np.inf)),
                                           pa.ListArray.from_arrays(pa.array(ends), near)], names=["vid", "v", "block", "radius", "near"])

    def run(batches):
        now, held, ready = None, [], None
        for batch in batches:
            for lo, hi in runs(batch, ("block", "share", "kind")):
                part = batch.slice(lo, hi - lo)
                at = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if at != now:
                    now, held, ready = at, [], None
                if part.column(2)[0].as_py() == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        base = pa.Table.from_batches(held).combine_chunks()
                        ready, held = Block(base.column("key").combine_chunks(), _matrix(base.column("v").combine_chunks()), need), [None]
                    yield best(part, ready)
    return run


def _search(base: DataFrame, asks: DataFrame, need: int, share_rows: int, out: str, brief: bool) -> DataFrame:
    """Base rows (block, key, v) and questions (block, vid, v, radius): a block that many ask is held by several tasks."""
    shares = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / share_rows).alias("shares"))
    key, vid = base.schema["key"].dataType, asks.schema["vid"].dataType
    held = base.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                                             F.lit(0).alias("kind"), "key", F.lit(None).cast(vid).alias("vid"), "v", F.lit(None).cast("double").alias("radius"))
    put = asks.join(shares, "block").select("block", F.pmod(F.xxhash64("vid"), F.col("shares")).cast("long").alias("share"),
                                            F.lit(1).alias("kind"), F.lit(None).cast(key).alias("key"), "vid", "v", "radius")
    met = held.unionByName(put).repartition("block", "share").sortWithinPartitions("block", "share", "kind")
    return ship(met).mapInArrow(_meet(need, brief), out)


def knn_join(queries: DataFrame, base: DataFrame, key: str, cols: Sequence[str], k: int = 5, pivots: int = 128,
             block: int = 20_000, seed: int = 42) -> DataFrame:
    """The ``k`` rows of ``base`` nearest to each row of ``queries`` in ``cols``, nearest first, ties to the smaller key:
    ``(key, rank, neighbour, distance)``.

    Exact. A row is not its own neighbour: keys are compared, and have to be unique and not null on each side. Fewer than ``k``
    other base rows give fewer neighbours, an empty side none. A NULL, NaN or infinite entry fails the query."""
    spark, need = base.sparkSession, k + 1  # the row itself may be among them
    checked = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is NULL")).cast(base.schema[key].dataType))
    asked = queries.select(checked.alias("key"), vector(cols).alias("v"))
    copies = Window.partitionBy("v").orderBy("key")
    rows = base.select(checked.alias("key"), vector(cols).alias("v")).withColumn("r", F.row_number().over(copies)).filter(F.col("r") <= need).drop("r")
    kind = rows.schema["key"].dataType.simpleString()
    result = f"key {kind}, rank int, neighbour {kind}, distance double"
    rows = cut_lineage(rows, "knn-base")
    # a bounded sample by hash, the same on every run
    found = rows.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(4 * pivots).collect()
    centre = np.unique(np.array([r.v for r in found], float).reshape(len(found), len(cols)), axis=0)
    if not len(centre):
        return spark.createDataFrame([], result)
    centre = centre[np.random.default_rng(seed).permutation(len(centre))[:pivots]]
    placed = cut_lineage(ship(rows).mapInArrow(_placed(centre), f"key {kind}, v array<double>, cell long, far double"), "knn-cells")
    ids = cut_lineage(asked.groupBy("v").agg(F.min("key").alias("vid")).select("vid", "v"), "knn-asked")

    # rings: cuts of large cells from a sketch (they steer the work only), then exact bounds and counts
    total = placed.count()
    part = max(block, -(-total // MAX_RINGS))
    sketch = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [i / 64 for i in range(1, 64)], 1000).alias("q"))
    cuts = []
    for r in sketch.collect():  # one row a pivot
        n = min(64, -(-r.n // part))
        cuts.append((r.cell, sorted({r.q[min(62, i * 64 // n - 1)] for i in range(1, n)})))
    cuts = spark.createDataFrame(cuts, "cell long, cuts array<double>")

    def ringed(df):  # one row a pivot: bounded
        return df.join(F.broadcast(cuts), "cell", "left").withColumn("ring", F.size(F.filter(
            F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c < F.col("far"))).cast("long")).drop("cuts")

    rings = Rings(centre, ringed(placed).groupBy("cell", "ring").agg(
        F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect(), block)
    where = F.broadcast(rings.table(spark))
    held = ringed(placed).join(where, ["cell", "ring"]).select(
        (F.col("first") + F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("block"), "key", "v")
    # one block of the query's own cell; a cell or ring without base rows gives none, and no radius
    own = ringed(ship(ids).mapInArrow(_placed(centre), f"vid {kind}, v array<double>, cell long, far double")).join(where, ["cell", "ring"], "left").select(
        F.coalesce(F.col("first") + F.pmod(F.xxhash64("vid"), F.col("blocks")), F.lit(-1)).alias("block"), "vid", "v", F.lit(float("inf")).alias("radius"))
    out = f"vid {kind}, v array<double>, block long, radius double, near array<struct<distance:double,neighbour:{kind}>>"
    inside = cut_lineage(_search(held, own.filter("block >= 0"), need, 4 * block, out, brief=False), "knn-own")
    lost = own.filter("block < 0").select("vid", "v", "block", "radius")
    visits = ship(inside.select("vid", "v", "block", "radius").unionByName(lost)).mapInArrow(_visits(rings, need), f"block long, vid {kind}, v array<double>, radius double")
    beyond = _search(held, cut_lineage(visits, "knn-visits"), need, 4 * block, f"vid {kind}, near array<struct<distance:double,neighbour:{kind}>>", brief=True)
    nearest = Window.partitionBy("vid").orderBy("distance", "neighbour")
    best = inside.select("vid", F.explode("near").alias("x")).unionByName(beyond.select("vid", F.explode("near").alias("x"))).select(
        "vid", "x.distance", "x.neighbour").withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= need)
    lists = best.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))).alias("near"))  # k + 1 entries
    each = asked.join(ids.join(lists, "vid"), "v")
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), 1, k)
    return each.select("key", F.posexplode(others).alias("at", "x")).select(
        "key", (F.col("at") + 1).alias("rank"), "x.neighbour", "x.distance")
