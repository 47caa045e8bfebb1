"""Shared helpers of the corpus operators: words, hashes, Arrow slicing, staging, sampling."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["SLICE_BYTES", "WORD", "Cache", "combine", "component_labels", "cut_lineage", "grouped", "held_out",
           "labelled_sample", "letter_runs", "mix64", "ship", "slices", "table"]

#: A word, everywhere in this subpackage: a run of anything but ASCII white space.
#: ``bytes.split()`` cuts UTF-8 at exactly the same places.
WORD = r"[^\x20\x09-\x0D]+"

_WORDLIKE = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters, which are what ``str.isalpha`` says: the class of the pattern also holds numerals that are no digits, such as
    fractions, at which its runs are cut where one holds any."""
    found = _WORDLIKE.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in "".join(c if c.isalpha() else " " for c in w).split()]


#: Text that is turned into Python objects at a time inside a task.
SLICE_BYTES = 4 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """Send this package to the executors once for each application, so that their Python can import it."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="cohortflow-code-"), f"{root.name}.zip")
        with zipfile.ZipFile(name, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(name))
        _SHIPPED.add(sc.applicationId)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str):
    """True for documents set aside for testing: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Cache(dict):
    """Bounded memo ``word -> make(word)``; it is emptied when full (results never depend on it)."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``data[start:start + size]``, eight bytes of all spans at a time; ``data`` ends with eight bytes more."""
    eights = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    h = mix64(size.astype(np.uint64))
    at, left, live = start, size, None
    while True:
        x = mix64((h if live is None else h[live]) ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        if live is None:
            h = x
        else:
            h[live] = x
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live, at, left = more if live is None else live[more], at[more] + 8, left[more] - 8
        if left.max() > 1 << 12:  # a few very long words are hashed one by one
            far = left > 1 << 12
            for i, lo, n in zip(live[far].tolist(), at[far].tolist(), left[far].tolist(), strict=True):
                h[i] = np.uint64(xxhash.xxh3_64_intdigest(data[lo:lo + n].tobytes(), seed=int(h[i])))
            live, at, left = live[~far], at[~far], left[~far]
            if not len(live):
                return h


def slice_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts, end to end, and where each text's begin (one more than there are
    texts). A null text has no words. Words are found and hashed in the bytes themselves; none becomes a Python object."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(texts) else np.empty(0, np.uint8)
    ends = ends - ends[0]
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word ends at a text's end too
    edge[ends] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    return hash_spans(data, start, size), np.searchsorted(start, ends)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries of ``h`` (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m, out = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _M1 + h[k:k + m]
    return mix64(out)


def slices(batches, text: str, limit: int = SLICE_BYTES):
    """Cut Arrow batches into runs of rows holding about ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no buffers


def grouped(batches, key: str):
    """Whole groups of rows with equal ``key``, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != k[0]:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        lo = 0
        for hi in cuts:
            held.append(batch.slice(lo, hi - lo))
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, lo = [], hi
        held.append(batch.slice(lo))
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def labelled_sample(docs: DataFrame, id_col: str, rows: int, *by: str) -> DataFrame:
    """At most about ``rows`` rows for each value of ``by``, the same on every run: rows whose id hash falls below
    a threshold taken from the exact counts, so that no global order is needed. ``docs`` should be narrow."""
    counts = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("__n"))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(counts, list(by)).filter(unit < share).drop("__n")


def component_labels(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long; u != v): one row (node, root) for each node on an edge,
    root being the smallest node of its component. Alternating large and small stars: every round is an aggregation
    and a join over the edges, each written to the shared folder, until the edges no longer change."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    def order(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = cut_lineage(order(edges).distinct(), "edges")
    before = state(cur)
    while before[0]:
        cur = cut_lineage(star(order(star(cur, True)), False), "stars")
        after = state(cur)
        if after == before:
            break
        before = after
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
