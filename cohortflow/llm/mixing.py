"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The totals of the sources (one row each) give every source a target. All blocks of the mix are then apportioned to the
sources by highest quotients target / (2 k + 1), and each source's blocks to its shards in the same way by their size.
A shard is a bounded share of a source's documents, chosen by hash; it lays its documents end to end in a seeded order,
cuts the words into blocks, and takes its quota: every block as often as the quota covers all of them, and the rest by
a seeded draw. So only (document, source, size) is ever shuffled, and a hot source is spread over its shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, ship, slices


def targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; a share stops at ``most`` times its size, and the excess is shared again by weight
    among the others, until none is above."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = float(total)
    while open_:
        by_weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / by_weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / by_weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), none above ``most``; ties go to the earlier party. The standard
    divisor gives nearly all seats at once; the last few are added or withdrawn one by one."""
    total, seats = sum(votes), min(seats, sum(most))
    if total <= 0:
        return [0] * len(votes)
    out = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most, strict=True)]
    have = sum(out)
    if have > seats:
        heap = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(votes, out, strict=True)) if k]
        heapq.heapify(heap)
        while have > seats:
            i = -heapq.heappop(heap)[1]
            out[i] -= 1
            have -= 1
            if out[i]:
                heapq.heappush(heap, (votes[i] / (2 * out[i] - 1), -i))
    else:
        heap = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, out, most, strict=True)) if k < m]
        heapq.heapify(heap)
        while have < seats and heap:
            i = heapq.heappop(heap)[1]
            out[i] += 1
            have += 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _select(block: int, seed: int):
    """One shard: (doc_id, size, ..., quota) -> how often each run of a document's words is taken."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "doc_id", "size", "tag"], kind="stable")  # what still ties is equal
        size, quota = pdf["size"].to_numpy(np.int64), int(pdf["quota"].iloc[0])
        end = np.cumsum(size)
        n = -(-int(end[-1]) // block)
        times = np.full(n, quota // n, np.int64)
        draw = np.random.default_rng([seed, int(pdf["draw"].iloc[0])])
        times[draw.permutation(n)[:quota % n]] += 1
        runs = []
        for lo, hi in zip((end - size).tolist(), end.tolist(), strict=True):
            a, b = lo // block, -(-hi // block)
            t = times[a:b]
            cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            starts = np.maximum((a + cut) * block, lo) - lo
            ends = np.r_[starts[1:], hi - lo]
            runs.append([{"start": int(s), "length": int(e - s), "times": int(x)} for s, e, x in zip(starts, ends, t[cut], strict=True) if x])
        return pd.DataFrame({"row": pdf["row"], "runs": runs, "taken": [sum(r["length"] * r["times"] for r in x) for x in runs]})
    return run


RUNS = "array<struct<start:long,length:long,times:long>>"


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, block: int = 64,
        shard_words: int = 500_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """Take words from all documents so that each source comes near its target.

    Returns one row for each row of ``docs``: doc_id, source, size (words), source_size, target (of its source), taken
    (words, repeats counted) and runs (which words how often: start, length, times). Sources, by code point and null
    last, weigh ``weights`` in turn; they share ``total`` times all words, at most ``most`` times their own. No
    document is taken more than ``most`` times, rounded up. A null or empty text has size 0 and takes nothing. Rows that
    repeat an id are documents of their own; a null id is an id like any other. The same rows, in any order, give the same mix:
    a hash of the text tells apart what has no id or a common one, and rows that are equal in both can change places.
    The totals of the sources, one row each, are held by the driver; ``shard_words`` bounds what one task holds. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = ship(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               *([F.col(key_col).alias("key")] if key_col else []), F.xxhash64(text).alias("tag"),
                               F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))).cast("long").alias("size"))
    sizes = cut_lineage(narrow.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sums = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None] * (None in sums)
    have = [sums[s] for s in names]
    want = targets(have, [weights[i % len(weights)] for i in range(len(names))], total * sum(have), most)
    spark = docs.sparkSession
    # one row for each source; null is a source like any other
    per_source = spark.createDataFrame([(s, n, t, max(1, -(-n // shard_words))) for s, n, t in zip(names, have, want, strict=True)],
                                       "s string, source_size long, target double, shards long")
    known = sizes.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = known.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "tag", F.lit(seed)), F.col("shards")))
    held = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))

    quota_of = dict(zip(names, sainte_lague(want, round(sum(want) / block), [int(most) * -(-n // block) for n in have]), strict=True))

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        source = pdf["source"].iloc[0]
        n = (-(-pdf["words"] // block) * int(most)).tolist()
        return pdf.assign(quota=sainte_lague(pdf["words"].tolist(), quota_of[None if pd.isna(source) else source], n))

    quotas = held.groupBy("source").applyInPandas(by_shard, "source string, shard long, words long, quota long")
    quotas = quotas.select(F.col("source").alias("s"), F.col("shard").alias("k"), "quota",
                           F.pmod(F.xxhash64("source", "shard"), F.lit(1 << 62)).alias("draw"))
    taken = dealt.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k"))).withColumn(
        "place", F.xxhash64(F.lit(seed), "doc_id", "size", "tag")).groupBy("source", "shard").applyInPandas(
        _select(block, seed), f"row long, runs {RUNS}, taken long")
    return known.join(taken, "row", "left").select(
        *(["key"] if key_col else []), "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))


def _copies(text_at: int):
    """Rows with, last, the runs taken of their words: as many rows as the most frequent run is taken."""
    import pyarrow as pa

    def run(batches):
        for part in slices(_sized(batches, text_at), "__text"):
            rows, texts = [], []
            for i, (t, runs) in enumerate(zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 2).to_pylist(), strict=True)):
                words = (t or "").encode().split()
                for c in range(max((r["times"] for r in runs or ()), default=0)):
                    took = [r for r in runs if r["times"] > c]
                    whole = sum(r["length"] for r in took) == len(words)
                    rows.append(i)
                    texts.append(t if whole else b" ".join([w for r in took for w in words[r["start"]:r["start"] + r["length"]]]).decode())
            out = part.take(pa.array(rows, pa.int64()))
            cols = [pa.array(texts, pa.string()) if k == text_at else out.column(k) for k in range(out.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-2])

    def _sized(batches, at):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, b.column(at).cast(pa.binary())], names=[*b.schema.names, "__text"])
    return run


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document whose words are taken n times comes as up to n rows, each
    with the words that its pass takes (the unchanged text where that is all of them); a document of which nothing
    is taken goes. Rows that repeat an id and a text are documents of their own, each taken as :func:`mix` says. The rows are
    written once with a number, by which the runs find them again."""
    keyed = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "to-mix")
    runs = mix(keyed, id_col=id_col, text_col=text_col, key_col="__row", **how).filter("taken > 0").select(
        F.col("key").alias("__k"), F.col("runs").alias("__runs"))
    both = keyed.join(runs, F.col("__row") == F.col("__k")).drop("__k", "__row")
    return both.mapInArrow(_copies(docs.columns.index(text_col)), docs.schema)
