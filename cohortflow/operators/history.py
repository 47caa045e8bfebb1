"""History features from each entity's strictly earlier events.

Two-level scan (see :mod:`cohortflow.operators.sequence`): windows over
``(entity, cell)`` compute the neighbours and strictly-earlier aggregates
within a cell; the cells of heavy entities are summarised, a small window over
them carries the history of earlier cells, and one broadcast join brings it
back. Give it a narrow frame (the columns named in the call) and join wide
columns to the result by ``event_id``. The only cross-row dependency that crosses cells - the gap
between a cell's first event and the previous event - is evaluated on the carry
table, where both ends are known. Where one time runs over several cells, the
rows at a cell's first time take a carry without their own time: the totals
before that time in the cell where it begins, and of the cells before that one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import indicator
from ..functions.time import DAYS_PER_YEAR, elapsed_days
from .sequence import BK, DEFAULT_ROWS_PER_BUCKET, SPLIT, TM, _carried, _with_bucket, drop_scan_columns


def history_features(events: DataFrame, entity: str, event_id: str, start: str, end: str,
                     prior_sums: Mapping[str, str] | None = None,
                     readmit_days: int = 30, frequent_min: int = 3,
                     min_history_years: float = 0.1, no_history_days: float | None = None,
                     label_horizon: int | None = None, keep_last: bool = True,
                     bucket_days: float | None = None,
                     rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Add history columns computed from the entity's events whose ``start`` is
    strictly before the current ``start`` (ties are not history):

    * ``prior_count``; ``frequent_flag`` = prior_count >= ``frequent_min``
    * ``days_since_last``: floored days from the latest prior event's end to
      this start (NULL, or ``no_history_days`` if given, without history)
    * ``avg_prior_los``: mean floored stay length of prior events (NULL without)
    * ``had_prior_readmission``: some consecutive pair of prior events has a
      gap <= ``readmit_days`` (no lower bound, unlike the label)
    * ``rate_per_year``: prior_count / max(years since first prior event,
      ``min_history_years``), 0 without history
    * one column per ``prior_sums`` entry ``{output: per-event column}``: sum
      over prior events, 0 without history.

    With ``label_horizon`` the follow-up label is computed in the same pass
    (``next_start``, ``gap_days``, ``label``, as
    :func:`cohortflow.operators.label.readmission_label`) and, unless
    ``keep_last``, each entity's last event is dropped after the history is
    computed (it is still the *next* event of the one before it).
    """
    sums = dict(prior_sums or {})
    d = _with_bucket(events, start, bucket_days, entity, event_id, rows_per_bucket).repartition(entity, BK)
    mine = F.col(entity).isNotNull()
    los = elapsed_days(F.col(start), F.col(end))
    d = d.withColumn("_h_los", los)

    # ---- level 1: rows, within their (entity, bucket)
    w = Window.partitionBy(entity, BK).orderBy(TM, event_id)
    before = Window.partitionBy(entity, BK).orderBy(TM).rangeBetween(Window.unboundedPreceding, -1)
    order_key = F.struct(F.col(TM), F.col(event_id))
    d = (d.withColumn("_h_pe", F.lag(end).over(w))
          .withColumn("_h_hp", mine & F.lag(F.lit(True)).over(w).isNotNull())
          .withColumn("_h_ns", F.lead(start).over(w))
          .withColumn("_h_hn", mine & F.lead(F.lit(True)).over(w).isNotNull()))
    # close gap to the previous event; known here for all but the bucket's first row
    d = d.withColumn("_h_close", F.when(F.col("_h_hp"), indicator(
        elapsed_days(F.col("_h_pe"), F.col(start)) <= readmit_days)))
    d = (d.withColumn("_h_wn", F.count(F.lit(1)).over(before))
          .withColumn("_h_wlos", F.sum("_h_los").over(before))
          .withColumn("_h_wclose", F.max("_h_close").over(before))
          .withColumn("_h_wlast", F.max_by(F.col(end), order_key).over(before))
          .withColumn("_h_wfirst", F.min(start).over(before)))
    for out, col in sums.items():
        d = d.withColumn("_h_ws_" + out, F.sum(col).over(before))

    # ---- level 2: one row per (entity, bucket), from the sorted frame. What lies before
    # a cell's last time within the cell is what its last row sees
    seen = F.struct(F.col(TM).alias("tm"), *[F.col(f"_h_w{c}").alias(c) for c in ("n", "los", "close", "first", "last")],
                    *[F.col("_h_ws_" + out).alias("s_" + out) for out in sums])
    summary = d.filter(SPLIT).groupBy(entity, BK).agg(
        F.count(F.lit(1)).alias("_h_bn"), F.sum("_h_los").alias("_h_blos"),
        F.max("_h_close").alias("_h_bclose_rest"),
        F.max_by(F.col(end), order_key).alias("_h_blast"),
        F.max_by(seen, order_key).alias("_h_seen"),
        F.min_by(F.struct(F.col(start).alias("s"), F.col(TM).alias("tm")), order_key).alias("_h_bfirst"),
        *[F.sum(col).alias("_h_bs_" + out) for out, col in sums.items()])
    ob = Window.partitionBy(entity).orderBy(BK)
    upto = ob.rowsBetween(Window.unboundedPreceding, -1)
    summary = (summary
               .withColumn("_h_cprev_end", F.lag("_h_blast").over(ob))
               .withColumn("_h_cnext_start", F.lead(F.col("_h_bfirst.s")).over(ob))
               .withColumn("_h_fclose", F.when(F.col("_h_cprev_end").isNotNull(), indicator(
                   elapsed_days(F.col("_h_cprev_end"), F.col("_h_bfirst.s")) <= readmit_days))))
    summary = summary.withColumn("_h_bclose", F.greatest("_h_bclose_rest", "_h_fclose"))
    summary = summary.withColumn("_h_full", F.struct(
        F.coalesce(F.sum("_h_bn").over(upto), F.lit(0)).alias("n"),
        F.sum("_h_blos").over(upto).alias("los"),
        F.max("_h_bclose").over(upto).alias("close"),
        F.first(F.col("_h_bfirst.s")).over(upto).alias("first"),
        F.col("_h_cprev_end").alias("last"),
        *[F.sum("_h_bs_" + out).over(upto).alias("s_" + out) for out in sums]))
    # the history of a cell's last time, as the first cell that this time ends knows it
    summary = summary.withColumn("_h_to", F.struct(*_joined(
        "_h_full", "_h_seen", F.when(F.col("_h_bfirst.tm") < F.col("_h_seen.tm"), F.col("_h_fclose")), sums)))
    one_time = Window.partitionBy(entity, "_h_seen.tm").orderBy(BK)
    summary = summary.withColumn("_h_to", F.first("_h_to").over(one_time))
    straddles = F.lag("_h_seen.tm").over(ob) == F.col("_h_bfirst.tm")
    carry = summary.select(
        F.col(entity).alias("_h_e"), F.col(BK).alias("_h_b"), "_h_cnext_start", "_h_fclose", "_h_full",
        F.col("_h_bfirst.tm").alias("_h_ftm"),
        F.when(straddles, F.lag("_h_to").over(ob)).otherwise(F.col("_h_full")).alias("_h_strict"))

    # ---- combine
    j = d.join(_carried(carry, bucket_days), (F.col(entity) == F.col("_h_e")) & (F.col(BK) == F.col("_h_b")), "left")
    j = j.withColumn("_h_c", F.when(F.col("_h_ftm") == F.col(TM), F.col("_h_strict")).otherwise(F.col("_h_full")))
    own = F.struct(F.when(mine, F.col("_h_wn")).otherwise(0).alias("n"),
                   *[F.col(f"_h_w{c}").alias(c) for c in ("los", "close", "first", "last")],
                   *[F.col("_h_ws_" + out).alias("s_" + out) for out in sums])
    j = j.withColumn("_h_w", own)
    first_row_prior = F.col("_h_ftm") < F.col(TM)  # the bucket's first event is history
    j = j.withColumn("_h_all", F.struct(*_joined("_h_c", "_h_w", F.when(first_row_prior, F.col("_h_fclose")), sums)))
    n = F.col("_h_all.n").cast("bigint")
    since = elapsed_days(F.col("_h_all.last"), F.col(start))
    if no_history_days is not None:
        since = F.coalesce(since.cast("double"), F.lit(float(no_history_days)))
    years = elapsed_days(F.col("_h_all.first"), F.col(start)) / F.lit(DAYS_PER_YEAR)
    j = (j.withColumn("prior_count", n)
          .withColumn("days_since_last", since)
          .withColumn("avg_prior_los", F.col("_h_all.los") / n)
          .withColumn("had_prior_readmission", F.coalesce(F.col("_h_all.close"), F.lit(0)).cast("int"))
          .withColumn("frequent_flag", indicator(n >= frequent_min))
          .withColumn("rate_per_year", F.when(n > 0, n / F.greatest(years, F.lit(float(min_history_years))))
                      .otherwise(F.lit(0.0))))
    for out in sums:
        j = j.withColumn(out, F.coalesce(F.col("_h_all.s_" + out), F.lit(0)))
    if label_horizon is not None:
        nxt = F.when(F.col("_h_hn"), F.col("_h_ns")).otherwise(F.col("_h_cnext_start"))
        j = (j.withColumn("next_start", nxt)
              .withColumn("gap_days", elapsed_days(F.col(end), F.col("next_start")))
              .withColumn("label", indicator((F.col("gap_days") > 0)
                                             & (F.col("gap_days") <= label_horizon))))
        if not keep_last:
            j = j.filter(F.col("_h_hn") | F.col("_h_cnext_start").isNotNull())
    return drop_scan_columns(j.drop(*[c for c in j.columns if c.startswith("_h_")]))


def _joined(earlier: str, later: str, seam: Column, sums: Mapping[str, str]) -> list[Column]:
    """The history of two stretches of an entity's events, one behind the other; ``seam`` is the close gap between them."""
    a, b = (lambda c: F.col(f"{earlier}.{c}")), (lambda c: F.col(f"{later}.{c}"))

    def added(c):
        return F.coalesce(a(c) + b(c), a(c), b(c))

    return [(F.coalesce(a("n"), F.lit(0)) + b("n")).alias("n"), added("los").alias("los"),
            F.greatest(a("close"), b("close"), seam).alias("close"),
            F.when(a("n") > 0, a("first")).otherwise(b("first")).alias("first"),
            F.when(b("n") > 0, b("last")).otherwise(a("last")).alias("last"),
            *[added("s_" + out).alias("s_" + out) for out in sums]]
