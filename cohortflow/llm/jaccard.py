"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its word shingles. Documents with equal sets form one copy class; only one of them goes on.
Each class has ``HASHES`` MinHash values of 16 bits. Classes that agree on a band of four values are candidates; at
similarity 0.8 a pair agrees on none of the 32 bands with probability 5e-8. Candidate pairs are compared value by value,
sixteen at a time: with a uniform prior, after k agreements in n values the similarity is Beta(k + 1, n - k + 1), and a
pair goes as soon as the probability that it reaches the threshold is below ``tolerance``. What is left is verified
exactly on the shingle sets.

Members of a band's bucket are compared inside tasks and never leave as pairs: a bucket over ``block`` members (or with long
texts) is cut into blocks, and each pair of blocks is a task group of its own. A pair is looked at only in the first band on which it
agrees. A group first tells which members have a surviving pair, one row each; the texts of these then meet in the same group, which
finds its pairs again from the signatures and verifies them. So a group of near copies costs rows in
proportion to its members and blocks, while each of its links is still verified and counted.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, component_labels, cut_lineage, grouped, mix64, ship, slice_words, slices

HASHES, BAND, STEP = 128, 4, 16
BANDS = HASHES // BAND
_FACTORS = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, from the words' hashes; a shorter text is one shingle, an empty one has none."""
    if not len(h):
        return h
    return np.unique(combine(h, size)) if len(h) >= size else combine(h, len(h)) ^ np.uint64(len(h))


def signature(s: np.ndarray) -> bytes:
    """MinHash values, cut to 16 bits: a chance agreement adds a candidate at worst."""
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 2048):
        least = np.minimum(least, (s[lo:lo + 2048, None] * _FACTORS).min(axis=0))
    return (mix64(least) >> np.uint64(48)).astype("<u2").tobytes()


@cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ... values: the fewest agreements k at which P(J >= threshold | k of n) >= tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(Beta(k + 1, n - k + 1) >= t) = P(Binomial(n + 1, t) <= k)
        p, k = 0.0, -1
        while p < tolerance:
            k += 1
            p += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out.append(k)
    return tuple(out)


def _sets(size: int):
    def run(batches):
        for part in slices(batches, "text"):
            rows, (h, at) = [], slice_words(part.column(1))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                s = shingles(h[lo:hi], size)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, len(s), signature(s) if len(s) else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["doc_id", "tag", "key", "n_shingles", "signature"])
    return run


def _pairs(left: np.ndarray, right: np.ndarray, same: bool, band: int, least: tuple[int, ...]):
    """Pairs (row of left, row of right) that no comparison dropped and that agree on ``band`` first."""
    found_a, found_b = [], []
    for a0 in range(0, len(left), 256):
        a = left[a0:a0 + 256]
        ia, ib = np.nonzero(np.ones((len(a), len(right)), bool) if not same else
                            np.arange(len(right)) > np.arange(a0, a0 + len(a))[:, None])
        agree = np.zeros(len(ia), np.int32)
        for k, need in enumerate(least):
            cut = slice(k * STEP, (k + 1) * STEP)
            agree += np.count_nonzero(a[ia, cut] == right[ib, cut], axis=1).astype(np.int32)
            keep = agree >= need
            ia, ib, agree = ia[keep], ib[keep], agree[keep]
            if not len(ia):
                break
        if len(ia):
            bands = (a.view("<u8")[ia] == right.view("<u8")[ib])
            first = bands.argmax(axis=1) == band
            found_a.append(ia[first] + a0)
            found_b.append(ib[first])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _signatures(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(-1, HASHES)


def _survivors(side: np.ndarray, sig: np.ndarray, band: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a group that survive: within one block (side 0), or across two (sides 1 and 2)."""
    if not len(side):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if side.max() == 0:
        return _pairs(sig, sig, True, band, least)
    a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    ia, ib = _pairs(sig[a], sig[b], False, band, least) if len(a) and len(b) else (a[:0], b[:0])
    return a[ia], b[ib]


def _prune(least: tuple[int, ...]):
    """Groups of (grp, band, side, node, signature) -> the members that have a surviving pair: (grp, band, side, node)."""
    def run(batches):
        for g in grouped(batches, "grp"):
            if g.num_rows < 2:
                continue
            used = np.union1d(*_survivors(g.column(2).to_numpy(), _signatures(g.column(4)), g.column(1)[0].as_py(), least))
            if len(used):
                yield g.take(pa.array(used, pa.int64())).select(["grp", "band", "side", "node"])
    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _verify(size: int, threshold: float, least: tuple[int, ...]):
    """Groups of (grp, band, side, node, copies, signature, text) -> (node, classes, documents, root): exact links of the group."""
    def run(batches):
        for g in grouped(batches, "grp"):
            # rows that repeat an id and its text bring a member more than once
            g = g.take(pa.array(np.unique(g.column(3).to_numpy(), return_index=True)[1]))
            sets = []
            for part in slices([g.select(["text"])], "text"):
                h, at = slice_words(part.column(0))
                sets.extend(shingles(h[lo:hi], size) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            node, copies = g.column(3).to_numpy(), g.column(4).to_numpy()
            ia, ib = _survivors(g.column(2).to_numpy(), _signatures(g.column(5)), g.column(1)[0].as_py(), least)
            classes, documents, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for i, j in zip(ia.tolist(), ib.tolist(), strict=True):
                both = _common(sets[i], sets[j])
                if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    classes[[i, j]] += 1
                    documents[i] += copies[j]
                    documents[j] += copies[i]
                    x, y = find(i), find(j)
                    if x != y:
                        low, high = (x, y) if node[x] < node[y] else (y, x)
                        root[high] = low
            linked = np.flatnonzero(classes)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                    node[linked], classes[linked], documents[linked], node[[find(k) for k in linked]])],
                    names=["node", "classes", "documents", "root"])
    return run


def jaccard_join(docs: DataFrame, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join all documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Returns one row for each row of ``docs``: doc_id; class_id, the smallest id among all documents that links connect
    to it; copy_id, the smallest id among those with an equal shingle set; n_links, the number of other documents at
    or above the threshold; n_class_links, the same counted in copy classes. Words are runs of anything but ASCII white
    space, unchanged. A text of fewer than ``size`` words is one shingle. A null or empty text has no links and is its
    own class. Rows that repeat an id and its text count as copies of each other. A null id is ignored where ids are compared.
    Other columns are not read.
    """
    return _classes(docs, size, threshold, tolerance, block, id_col, text_col).drop("tag", "node")


#: Shingles of one block of a bucket, on average: what bounds the sets that a task holds.
BLOCK_SHINGLES = 2_000_000


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows of one id, or without one, apart by their text."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def _classes(docs: DataFrame, size: int, threshold: float, tolerance: float, block: int, id_col: str, text_col: str) -> DataFrame:
    """:func:`jaccard_join` with the tag of each row and the node of its class (null without words)."""
    narrow = _tagged(ship(docs), id_col, text_col)
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = least_agreements(threshold, tolerance)
    schema = "doc_id long, tag long, key binary, n_shingles long, signature binary"
    every = cut_lineage(narrow.select("doc_id", "text", "tag").mapInArrow(_sets(size), schema).withColumn("node", F.xxhash64("key")), "sets")
    some = every.filter("n_shingles > 0")
    # the row that stands for a class: of the smallest id, null ids last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag", "n_shingles")).alias("f")
    classes = some.groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"))
    reps = cut_lineage(some.select("node", "doc_id", "tag", "signature").join(classes.select(
        F.col("node").alias("__node"), F.col("f.doc_id").alias("rep"), F.col("f.tag").alias("rep_tag"), "copies", "f.n_shingles"),
        (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag")))
        .dropDuplicates(["__node"]).select("node", "rep", "rep_tag", "copies", "n_shingles", "signature"), "classes")

    # candidates: classes that share a band, in blocks
    bands = reps.select("node", "n_shingles", F.expr(
        f"explode(transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, "
        f"xxhash64(b, substring(signature, b * {2 * BAND} + 1, {2 * BAND})) AS bucket)))").alias("x")).select("node", "n_shingles", "x.*")
    counts = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("sum")).filter("m > 1")
    cut = F.ceil(F.greatest(F.col("m") / block, F.least(F.col("m"), F.col("sum") / BLOCK_SHINGLES))).cast("int")
    blocks = (bands.drop("n_shingles").join(counts, "bucket").withColumn("n", cut)
              .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
              .join(reps.select("node", "signature"), "node")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "band",
                      F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1)
                      .otherwise(2).alias("side"), "node", "signature"))
    survivors = cut_lineage(blocks.repartition(n_parts, "grp").sortWithinPartitions("grp").mapInArrow(
        _prune(least), "grp long, band int, side int, node long"), "candidates")

    # exact verification where the texts of a group's members meet
    wanted = survivors.select("node").distinct().join(reps.select("node", "rep", "rep_tag", "copies", "signature"), "node")
    texts = wanted.join(narrow, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("rep_tag") == F.col("tag"))).select("node", "copies", "signature", "text")
    checked = cut_lineage(survivors.join(texts, "node").select("grp", "band", "side", "node", "copies", "signature", "text")
                          .repartition(n_parts, "grp").sortWithinPartitions("grp")
                          .mapInArrow(_verify(size, threshold, least), "node long, classes long, documents long, root long"), "links")
    links = checked.groupBy("node").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    edges = checked.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    labels = component_labels(edges)
    of_class = reps.select("node", "rep", "copies").join(links, "node", "left").join(labels, "node", "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "node"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("class_id"))
    of_class = cut_lineage(of_class.join(least, "root").select(
        "node", "root", "rep", "class_id", (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"),
        F.coalesce("classes", F.lit(0)).alias("n_class_links")), "joined")
    return every.select("doc_id", "tag", "node", "n_shingles").join(of_class, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links"), "n_shingles",
        "tag", F.col("root").alias("node"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class that links connect (see :func:`jaccard_join`): that of the smallest id, null ids last,
    and of the rows of that id one by a hash of the text. Rows are judged each by its own text, so that a row whose text is in no
    other stays, whatever else has its id. A null or empty text is a class of its own, so it stays; a row that comes again with
    its id and text goes."""
    joined = _classes(docs, size, threshold, tolerance, block, id_col, text_col)
    own = F.when(F.col("node").isNull(), F.xxhash64("doc_id", "tag")).otherwise(F.col("node"))
    first = joined.groupBy(F.col("node").isNull().alias("alone"), own.alias("class")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("__id"), F.col("f.tag").alias("__own"))
    rows = docs.withColumn("__key", F.col(id_col).cast("long")).withColumn("__tag", F.xxhash64(F.col(text_col).cast("binary")))
    left = rows.join(first, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__own")), "left_semi")
    return left.dropDuplicates(["__key", "__tag"]).drop("__key", "__tag")
