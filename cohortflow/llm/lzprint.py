"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the longest one already in the text's own dictionary plus one code
point (LZ78). The set of phrases is hashed, and its smallest hash under each of ``HASHES`` functions, cut to 16 bits,
is the fingerprint, in hexadecimal. The share of equal values estimates how far two dictionaries agree, which is what a
compressor would gain from one text when it reads the other.

The neighbour comparison lays the documents out by id in ranges, one shuffle of the texts, and reads each range once in
falling order. A range gets the first document of the next one along, so no order over all documents is ever
formed in one task. The edited text shares its beginning with the original, so its parse starts from there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship, slices

HASHES = 64
_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_NONE = np.full(HASHES, np.uint64(2**64 - 1))


def parse(text: str, known: set[str], phrases: list[str], start: int, stop: int) -> int:
    """Parse ``text[start:stop]`` on from ``known``; new phrases go to both. Returns where the unfinished phrase begins."""
    lo = start
    end = lo + 1
    while end <= stop:
        p = text[lo:end]
        if p in known:
            end += 1
        else:
            known.add(p)
            phrases.append(p)
            lo = end
            end = lo + 1
    return lo


def least_hashes(phrases: list[str], so_far: np.ndarray = _NONE) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, phrases), np.uint64, len(phrases))
    for lo in range(0, len(h), 4096):
        so_far = np.minimum(so_far, (h[lo:lo + 4096, None] * _FACTORS).min(axis=0))
    return so_far


def short(least: np.ndarray) -> np.ndarray:
    """16 bits of each value; of an empty text all are 0."""
    return (mix64(least) >> np.uint64(48)).astype(np.uint16) if least[0] != _NONE[0] else np.zeros(HASHES, np.uint16)


def written(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values; two empty texts are alike, an empty and another one are not."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float(np.mean(a == b))


def fingerprints(text: str, cut: int | None = None, tail: str = "") -> tuple[np.ndarray, np.ndarray | None]:
    """Values of ``text``, and of ``text[:cut] + tail`` if ``cut`` is given; the part they share is parsed once."""
    known: set[str] = set()
    shared: list[str] = []
    at = parse(text, known, shared, 0, len(text) if cut is None else cut)  # the phrase open at the cut goes on behind it
    base = least_hashes(shared)
    if cut is None:
        return short(base), None
    out = []
    for rest in (text[at:], text[at:cut] + tail):
        new: list[str] = []
        parse(rest, known, new, 0, len(rest))  # an unfinished phrase at the end is in the dictionary already
        out.append(short(least_hashes(new, base)))
        known.difference_update(new)
    return out[0], out[1]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; equal texts have equal fingerprints, a null text is an empty one."""

    def run(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(
                [written(fingerprints(t or "")[0]) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches):
    """Rows sorted by range, falling id; the row after a range's last (flag ``guest``) is only looked at."""
    held = None  # (range, id, text, values to come)
    rows = []

    def flush():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                          names=[c.split()[0] for c in SCHEMA.split(", ")])

    def settle(doc, text, after):
        n = len(text)
        k = n // 3
        tail = after[:k]
        own, edited = fingerprints(text, n - k, tail)
        return doc, n, text[:n - k] + tail, own, edited

    waiting = None  # a settled document whose next one has no fingerprint yet
    for part in slices(batches, "text"):
        for rng, doc, text, guest in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if held is not None and held[0] == rng:
                doc0, n, edited_text, own, edited = settle(held[1], held[2], text)
                if waiting is not None:
                    rows.append((*waiting[:-1], likeness(waiting[-1], own)))
                waiting = (doc0, n, hashlib.sha256(edited_text.encode()).hexdigest(), written(own), written(edited), likeness(own, edited), own)
            if guest and waiting is None:  # a repeated guest
                held = None
            elif guest:
                rows.append((*waiting[:-1], likeness(waiting[-1], fingerprints(text)[0])))
                held = waiting = None
            else:
                held = (rng, doc, text)
        if rows:
            yield flush()
    if rows:
        yield flush()


def _places(cuts: list[int], null_ranges: int) -> tuple[Column, int]:
    """The range of a row (``rng``) in falling order of (doc_id, tie), nulls last, and how many ranges there are.

    A row's range is the number of cuts not below its id, found by bisection. An id that fills several ranges is a cut as
    many times; its rows, and those without an id, are dealt to these ranges by their tie, which is spread evenly."""
    falling = F.split(F.lit(",".join(map(str, sorted(cuts, reverse=True)))), ",").cast("array<bigint>")  # folds to one literal
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]) if cuts else None

    def found(holds) -> Column:  # how many cuts, from the largest on, the row's id leaves above it
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(holds(F.get(falling, at + step - 1)), at + step).otherwise(at))

    def band(n: Column) -> Column:  # 0 to n - 1 by falling tie
        return F.floor((F.lit((1 << 31) - 1) - F.shiftright("tie", 32)) * n / float(1 << 32)).cast("int")

    if cuts:
        above, upto = found(lambda c: c > F.col("doc_id")), found(lambda c: c >= F.col("doc_id"))
        known = F.when(upto - above > 1, above + 1 + band(upto - above)).otherwise(upto)
    else:
        known = F.lit(0)
    return F.when(F.col("doc_id").isNull(), len(cuts) + band(F.lit(null_ranges))).otherwise(known).alias("rng"), len(cuts) + null_ranges


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 4000) -> DataFrame:
    """Fingerprint every document and an edited text of it, and compare it with that and with the next document.

    The next document is that of the next smaller id; after the smallest comes the largest. The edited text has its last
    third (rounded down, in code points) replaced by as many code points from the start of the next document, or all of
    them if it has fewer. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. A null text is empty. Rows that share an id follow each other by falling hash of their text. Null ids
    come last, below the smallest. A single document is its own next one. Other columns are not read.
    """
    key = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    narrow = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = narrow.select("doc_id", "tie")
    n, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    parts = max(1, -(-known // range_rows))
    # bounds of the ranges, one for each, as a range partitioner holds them
    cuts = [int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    place, ranges = _places(cuts, (n - known) // range_rows + 1)
    firsts = sorted(((r.rng, r.top.doc_id, r.top.tie) for r in ids.select("*", place).groupBy("rng").agg(
        F.max(F.struct("doc_id", "tie")).alias("top")).collect()))
    guests = docs.sparkSession.createDataFrame(
        [(d, t, firsts[i - 1][0]) for i, (_, d, t) in enumerate(firsts)], "g_id long, g_tie long, host int")
    # as many rows as there are ranges, so it can be sent to every executor
    seen = narrow.select("*", place).join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")), "left")
    both = seen.select("doc_id", "tie", "text", F.explode(F.when(F.col("host").isNull(), F.array(_seat("rng", False))).otherwise(
        F.array(_seat("rng", False), _seat("host", True)))).alias("seat"))
    dealt = both.select("seat.rng", "doc_id", "text", "seat.guest", "tie").repartitionById(ranges, F.col("rng"))
    return dealt.sortWithinPartitions("rng", "guest", *key).select("rng", "doc_id", "text", "guest").mapInArrow(_compare, SCHEMA)


def _seat(rng: str, guest: bool):
    return F.struct(F.col(rng).alias("rng"), F.lit(guest).alias("guest"))
