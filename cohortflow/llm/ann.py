"""Approximate nearest neighbours by multi-index hashing on learned, rotated binary codes.

Vectors are scaled into the unit ball by the largest norm and given one more component that makes them unit vectors, so
that the largest inner product is the smallest angle. The codes are the signs after a projection on principal axes and
a rotation that is learned to bring the vectors close to their signs (iterative quantisation). A code of 64 bits is eight
substrings of one byte, each with an index of its own: buckets of row numbers by value. Codes within Hamming radius r
differ in at most r // 8 bits in one substring at least, so probing all values that near in each index finds every one.
What is found is filtered by its whole distance and reranked by the inner products of the original vectors.

The radius is learned on a bounded sample, so that it holds the sample's own neighbours; those of the whole table are
nearer. Vectors are dealt into blocks that are indexed each on its own, and queries to every block; a block widens the radius
for a query until it has found enough, so that no query comes up short. The best of all blocks are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, grouped, ship

BITS, PARTS = 64, 8
_BYTE = np.arange(256, dtype=np.uint8)
_NEAR = [np.flatnonzero(np.bitwise_count(_BYTE) <= k).astype(np.uint8) for k in range(9)]


@dataclass
class Codes:
    """``most``: the largest norm; codes are signs of ([x / most, rest] - mean) @ matrix."""

    most: float
    mean: np.ndarray
    matrix: np.ndarray
    radius: int = 0

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        x = x / self.most
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One row of PARTS bytes for each vector."""
        return np.packbits((self.lift(x, query) - self.mean) @ self.matrix > 0, axis=1)


def learn(sample: np.ndarray, most: float, k: int, recall: float, seed: int = 11, rounds: int = 40) -> Codes:
    """Principal axes, rotation and radius from a sample of vectors."""
    rng = np.random.default_rng(seed)
    codes = Codes(most, np.zeros(0), np.zeros((0, 0)))
    x = codes.lift(sample)
    codes.mean = x.mean(axis=0)
    x = x - codes.mean
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    axes = np.concatenate([axes, np.zeros((len(axes), BITS - axes.shape[1]))], axis=1)
    low, r = x @ axes, np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(low.T @ np.where(low @ r > 0, 1.0, -1.0))
        r = u @ vt
    codes.matrix = axes @ r
    at = rng.permutation(len(sample))[:300]
    if len(sample) > k:
        score = sample[at] @ sample.T
        score[np.arange(len(at)), at] = -np.inf
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        base, probe = codes(sample), codes(sample[at], query=True)
        far = np.bitwise_count(probe[:, None, :] ^ base[top]).sum(axis=2)
        codes.radius = int(np.quantile(far, recall))
    return codes


class Index:
    """The substring indexes of one block."""

    def __init__(self, codes: np.ndarray):
        self.whole = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.order = [np.argsort(codes[:, p], kind="stable").astype(np.int32) for p in range(PARTS)]
        self.start = [np.searchsorted(codes[o, p], np.arange(257)) for p, o in enumerate(self.order)]

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius`` of ``code``."""
        seen = np.zeros(len(self.whole), bool)
        for p in range(PARTS):
            values = code[p] ^ _NEAR[min(radius // PARTS, 8)]
            lo, n = self.start[p][values], self.start[p][values.astype(np.int64) + 1] - self.start[p][values]
            ends = np.cumsum(n)
            if ends[-1]:
                seen[self.order[p][np.repeat(lo - ends + n, n) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= radius]


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def _search(codes: Codes, k: int):
    """Groups of (grp, is_query, vec_id, vector): one block of vectors and one of queries."""
    def run(batches):
        for g in grouped(batches, "grp"):
            is_query, ids, x = g.column(1).to_numpy(zero_copy_only=False), g.column(2).to_numpy(), _matrix(g.column(3))
            base, ask = np.flatnonzero(~is_query), np.flatnonzero(is_query)
            if not len(base) or not len(ask):
                continue
            vectors, own = x[base], ids[base]
            index, probes = Index(codes(vectors)), codes(x[ask], query=True)
            out = []
            for q, code in zip(ask, probes, strict=True):
                radius = codes.radius
                while True:
                    rows = index.probe(code, radius)
                    rows = rows[own[rows] != ids[q]]
                    if len(rows) >= k or radius >= BITS:
                        break
                    radius = min(BITS, radius + PARTS)
                score = (vectors[rows] * x[q]).sum(axis=1)
                best = np.lexsort((own[rows], -score))[:k]
                out.append((np.full(len(best), ids[q]), own[rows[best]], score[best]))
            q, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 5000, recall: float = 0.98,
            block: int = 8192, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` to each of ``queries`` by inner product, found approximately, scored exactly.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision): nearest first, ties to the smaller
    vec_id; all others of the table if there are fewer than ``k``. A row is never its own neighbour. Vectors that are null,
    all zero, or hold null or non-finite components take no part on either side, nor do null ids and vectors whose length
    isn't the most common one. Rows that repeat an id and vector count once. Of vectors that are exactly equal only
    the ``k`` + 1 smallest ids are indexed: by the rule for ties no other can be among the nearest. Other columns are not read.
    """
    def usable(df):
        v = F.col(vector_col).cast("array<double>")
        ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
            v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))

    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    every = usable(ship(vectors))
    sizes = every.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda s, c: s + c * c))).alias("most")).orderBy(F.desc("rows"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    every = every.filter(F.size("vector") == sizes.n)
    same = Window.partitionBy("vector").orderBy("vec_id")
    base = cut_lineage(every.dropDuplicates(["vec_id", "vector"]).withColumn("copy", F.row_number().over(same))
                       .filter(F.col("copy") <= k + 1).drop("copy"), "vectors")
    ask = usable(queries).filter(F.size("vector") == sizes.n).dropDuplicates(["vec_id", "vector"])
    unit = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    n = base.count()
    taken = base.filter(unit < min(1.0, sample_rows / n)).select("vector").toPandas()["vector"]
    if not len(taken):
        taken = base.limit(1).select("vector").toPandas()["vector"]
    codes = learn(np.array(taken.tolist()), sizes.most, k, recall)
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-ask.count() // query_block))

    def dealt(df, mine, others, is_query):
        own = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(mine))
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        grp = F.col("each") * blocks + F.col("own") if not is_query else F.col("own") * blocks + F.col("each")
        return df.withColumn("own", own).withColumn("each", each).select(
            grp.cast("long").alias("grp"), F.lit(is_query).alias("is_query"), "vec_id", "vector")

    both = dealt(base, blocks, query_blocks, False).unionByName(dealt(ask, query_blocks, blocks, True))
    found = both.repartition(blocks * query_blocks, "grp").sortWithinPartitions("grp").mapInArrow(
        _search(codes, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
