"""Follow-up labels: does the entity have another event within a horizon
after this event ends?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import indicator
from ..functions.time import elapsed_days
from .sequence import DEFAULT_ROWS_PER_BUCKET, neighbours


def readmission_label(events: DataFrame, entity: str, event_id: str, start: str, end: str,
                      horizon_days: int = 30, drop_last: bool = True,
                      gap_col: str = "gap_days", label_col: str = "label",
                      next_col: str = "next_start", is_last_col: str | None = None,
                      bucket_days: float | None = None,
                      rows_per_bucket: int | None = DEFAULT_ROWS_PER_BUCKET) -> DataFrame:
    """Label each event by the floored day gap from its end to the start of the
    entity's next event (order: ``start``, then ``event_id`` for ties).

    ``label = 1`` iff ``0 < gap <= horizon_days``; same-day or overlapping
    follow-ups (gap <= 0) and events with no follow-up are 0. With
    ``drop_last`` the entity's last event (which cannot have a follow-up) is
    removed, so single-event entities vanish from the cohort.
    """
    d = neighbours(events, entity, start, event_id, nxt={next_col: start},
                   has_next="_lb_has_next", bucket_days=bucket_days, rows_per_bucket=rows_per_bucket)
    gap = elapsed_days(F.col(end), F.col(next_col))
    d = (d.withColumn(gap_col, gap)
          .withColumn(label_col, indicator((F.col(gap_col) > 0) & (F.col(gap_col) <= horizon_days))))
    if is_last_col:
        d = d.withColumn(is_last_col, ~F.col("_lb_has_next"))
    if drop_last:
        d = d.filter(F.col("_lb_has_next"))
    return d.drop("_lb_has_next")


def gap_to_previous(events: DataFrame, entity: str, event_id: str, start: str, end: str,
                    gap_col: str = "gap_from_prev", bucket_days: float | None = None
                    ) -> DataFrame:
    """Floored days from the previous event's end to this event's start
    (``lag`` form; NULL for an entity's first event)."""
    d = neighbours(events, entity, start, event_id, prev={"_lb_prev_end": end},
                   bucket_days=bucket_days)
    return d.withColumn(gap_col, elapsed_days(F.col("_lb_prev_end"), F.col(start))).drop("_lb_prev_end")


def horizon_rates(gapped: DataFrame, gap_col: str, horizons: Sequence[int] = (30, 60, 90),
                  denominator: str = "all") -> DataFrame:
    """Count and percentage of events followed within each horizon, in one
    pass: ``(horizon_days, n_followed, n_events, pct)``. ``denominator='all'``
    divides by every event; ``'with_gap'`` by events that have a gap value."""
    aggs = [F.count(F.lit(1)).alias("_n_all"), F.count(F.col(gap_col)).alias("_n_gap")]
    for h in horizons:
        aggs.append(F.count_if((F.col(gap_col) > 0) & (F.col(gap_col) <= h)).alias(f"_h{h}"))
    one = gapped.agg(*aggs)
    den = "_n_all" if denominator == "all" else "_n_gap"
    stacked = F.expr("stack({n}, {pairs}) as (horizon_days, n_followed)".format(
        n=len(horizons), pairs=", ".join(f"{int(h)}, _h{h}" for h in horizons)))
    return (one.select(stacked, F.col(den).alias("n_events"))
               .withColumn("horizon_days", F.col("horizon_days").cast("int"))
               .withColumn("n_followed", F.col("n_followed").cast("bigint"))
               .withColumn("pct", F.round(F.col("n_followed") * 100.0 / F.col("n_events"), 4)))


def gap_bands(gapped: DataFrame, gap_col: str,
              bands: Sequence[tuple[str, int, int]] = (("0-7", 0, 7), ("8-14", 8, 14),
                                                       ("15-21", 15, 21), ("22-30", 22, 30)),
              positive_only: bool = True) -> DataFrame:
    """Events per follow-up day band ``[lo, hi]`` (readmissions by day band):
    ``(band, n_events)``. With ``positive_only`` a gap must also be > 0, as
    for the label."""
    g = F.col(gap_col)
    band = None
    for name, lo, hi in bands:
        cond = (g >= lo) & (g <= hi)
        if positive_only:
            cond = cond & (g > 0)
        band = F.when(cond, F.lit(name)) if band is None else band.when(cond, F.lit(name))
    return (gapped.select(band.alias("band")).filter(F.col("band").isNotNull())
                  .groupBy("band").agg(F.count(F.lit(1)).alias("n_events")))
