"""Ordered per-entity scans (previous / next event, strictly-prior history)
that stay parallel when one entity owns a large share of all events.

A plain ``Window.partitionBy(entity)`` puts every event of an entity into one
task, so an entity holding a third of the table would be sorted and scanned by
a single core. Instead the scan is done in two levels:

1. every row gets a cell: an ordinary entity is one cell, a heavy one (more
   than a fixed share of all rows) is cut at quantiles of its own ``(time, tie)``
   order, so that a single time that holds most of its rows is cut as well. One
   explicit exchange on ``(entity, cell)`` deals the rows out for the windows;
2. each cell of a heavy entity is summarised (map-side combined) by its first and
   last row and its totals; a prefix over the cells of each entity carries
   what happened before a cell, and is joined back on ``(entity, cell)``.
   An ordinary entity has nothing to carry.

At most ``CELLS`` entities can be heavy, and they have about twice as many cells
at most, so cuts and carry are broadcast whatever the size of the table. All of
it is part of one lazy plan: nothing runs while it is built.

Rows of one time may lie in several cells. "Strictly before" (a RANGE frame
ending one microsecond before the current time) is then right within a cell, and
only the rows at the cell's first time need a second carry that leaves their own
time out. Events are totally ordered by ``(time, tie)``; a NULL time comes last, a
NULL tie first among its time. Only rows that agree in time and tie can't be cut
apart. A row with a NULL entity belongs to nobody: it has no neighbours and no
history, and such rows are spread by their tie.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import MICROS_PER_DAY, epoch_micros

TM, BK, SPLIT = "_sq_tm", "_sq_bucket", "_sq_split"
#: an entity is heavy when it has more than 1 / CELLS of all rows
CELLS = 1024
#: ... and more than this many rows
DEFAULT_ROWS_PER_BUCKET = 50_000
#: rows of a heavy entity that are looked at for each of its cells to find where to cut it; decides evenness, never results
CUT_SAMPLE = 128
_GRID = 32  # cuts are looked up in two steps of this many comparisons
_LAST = 1 << 62


def _at(tie: str) -> Column:
    """A row's place in the order of its entity."""
    return F.struct(F.col(TM).alias("t"), F.col(tie).alias("r"))


def _cuts(d: DataFrame, entity: str, tie: str, rows_per_bucket: int) -> DataFrame:
    """One row for each heavy entity: ``_sq_cuts``, places ``(time, tie)`` that cut it
    into cells of about the allowed number of rows. They are quantiles of the
    rows with the least hashes, some ``CUT_SAMPLE`` for each cell, so an array
    is bounded by ``CELLS * CUT_SAMPLE`` places whatever the size of the table."""
    known = d.filter(F.col(entity).isNotNull())
    counts = known.groupBy(entity).agg(F.count(F.lit(1)).alias("_sq_n"))
    total = counts.agg(F.sum("_sq_n").alias("_sq_total"))  # one row
    allowed = F.greatest(F.lit(float(rows_per_bucket)), F.col("_sq_total") / CELLS)
    heavy = (counts.crossJoin(F.broadcast(total)).filter(F.col("_sq_n") > allowed)
             .select(F.col(entity).alias("_sq_e"),
                     F.least(F.ceil(F.col("_sq_n") / allowed), F.lit(CELLS)).cast("int").alias("_sq_k"), "_sq_n"))
    share = F.col("_sq_k") * float(CUT_SAMPLE) / F.col("_sq_n")
    drawn = F.shiftrightunsigned(F.xxhash64(TM, tie), 16) < share * float(1 << 48)
    places = (known.select(F.col(entity).alias("_sq_e"), TM, tie).join(F.broadcast(heavy), "_sq_e")
              .filter(drawn).groupBy("_sq_e", "_sq_k").agg(F.sort_array(F.collect_list(_at(tie))).alias("_sq_all")))
    every = F.expr("transform(sequence(1, _sq_k - 1), i -> _sq_all[cast(greatest(i * size(_sq_all) div _sq_k, 1) as int) - 1])")
    return places.filter("_sq_k > 1").select("_sq_e", every.alias("_sq_cuts"))


def _with_bucket(df: DataFrame, time: str, bucket_days: float | None, entity: str,
                 tie: str, rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Add the ordering micros, the cell, and whether the entity is cut
    (``SPLIT``). ``bucket_days`` cuts every entity at fixed widths instead of
    cutting the heavy ones at their quantiles."""
    d = df.withColumn(TM, F.coalesce(epoch_micros(time), F.lit(_LAST)))
    if bucket_days is not None:
        cell, split = F.floor(F.col(TM) / F.lit(float(bucket_days) * MICROS_PER_DAY)).cast("bigint"), F.lit(True)
    else:
        cuts = _cuts(d.select(entity, TM, tie), entity, tie, rows_per_bucket or DEFAULT_ROWS_PER_BUCKET)
        d = d.join(F.broadcast(cuts), F.col(entity) == F.col("_sq_e"), "left")
        split = F.col("_sq_cuts").isNotNull()
        d = d.withColumn("_sq_at", F.when(split, _at(tie)))
        # how many cuts lie below the place: first among every 32nd, then among those behind the last of these
        block = F.expr(f"""size(filter(transform(sequence(0, cast((size(_sq_cuts) - 1) / {_GRID} as int)),
                           i -> _sq_cuts[i * {_GRID}]), c -> c < _sq_at))""")
        d = d.withColumn("_sq_block", F.when(split, block).otherwise(0))
        fine = F.expr(f"size(filter(slice(_sq_cuts, (_sq_block - 1) * {_GRID} + 2, {_GRID - 1}), c -> c < _sq_at))")
        cell = F.when(F.col("_sq_block") > 0, (F.col("_sq_block") - 1) * _GRID + 1 + fine).otherwise(0).cast("bigint")
    d = d.withColumn(BK, F.when(F.col(entity).isNull(), F.xxhash64(tie)).otherwise(cell))
    return d.withColumn(SPLIT, split & F.col(entity).isNotNull()).drop("_sq_e", "_sq_cuts", "_sq_at", "_sq_block")


def _carried(carry: DataFrame, bucket_days: float | None) -> DataFrame:
    """The carry, broadcast where the number of its rows is bounded."""
    return carry if bucket_days is not None else F.broadcast(carry)


def drop_scan_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_sq_")])


def neighbours(df: DataFrame, entity: str, time: str, tie: str,
               prev: Mapping[str, str] | None = None,
               nxt: Mapping[str, str] | None = None,
               has_prev: str | None = None, has_next: str | None = None,
               bucket_days: float | None = None,
               rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Add ``lag`` / ``lead`` columns over the entity's events ordered by
    ``(time, tie)``.

    ``prev`` maps output name -> source column of the previous event, ``nxt``
    the same for the next event; ``has_prev`` / ``has_next`` name optional
    boolean columns (``has_next = False`` marks the entity's last event).
    """
    prev, nxt = dict(prev or {}), dict(nxt or {})
    d = _with_bucket(df, time, bucket_days, entity, tie, rows_per_bucket)
    mine = F.col(entity).isNotNull()
    w = Window.partitionBy(entity, BK).orderBy(TM, tie)
    order_key = F.struct(F.col(TM), F.col(tie))
    last_row = F.struct(F.lit(True).alias("_x"), *[F.col(c).alias(o) for o, c in prev.items()])
    first_row = F.struct(F.lit(True).alias("_x"), *[F.col(c).alias(o) for o, c in nxt.items()])
    summary = (d.filter(SPLIT).groupBy(entity, BK)
               .agg(F.max_by(last_row, order_key).alias("_sq_last"),
                    F.min_by(first_row, order_key).alias("_sq_first")))
    v = Window.partitionBy(entity).orderBy(BK)
    carry = summary.select(F.col(entity).alias("_sq_e"), F.col(BK).alias("_sq_b"),
                           F.lag("_sq_last").over(v).alias("_sq_cl"),
                           F.lead("_sq_first").over(v).alias("_sq_cf"))
    d = d.repartition(entity, BK)
    d = (d.withColumn("_sq_hp", mine & F.lag(F.lit(True)).over(w).isNotNull())
          .withColumn("_sq_hn", mine & F.lead(F.lit(True)).over(w).isNotNull()))
    for out, src in prev.items():
        d = d.withColumn("_sq_p_" + out, F.lag(F.col(src)).over(w))
    for out, src in nxt.items():
        d = d.withColumn("_sq_n_" + out, F.lead(F.col(src)).over(w))
    j = d.join(_carried(carry, bucket_days), (F.col(entity) == F.col("_sq_e")) & (F.col(BK) == F.col("_sq_b")), "left")
    for out in prev:
        j = j.withColumn(out, F.when(F.col("_sq_hp"), F.col("_sq_p_" + out))
                         .otherwise(F.col("_sq_cl")[out]))
    for out in nxt:
        j = j.withColumn(out, F.when(F.col("_sq_hn"), F.col("_sq_n_" + out))
                         .otherwise(F.col("_sq_cf")[out]))
    if has_prev:
        j = j.withColumn(has_prev, F.col("_sq_hp") | F.col("_sq_cl").isNotNull())
    if has_next:
        j = j.withColumn(has_next, F.col("_sq_hn") | F.col("_sq_cf").isNotNull())
    return drop_scan_columns(j)
