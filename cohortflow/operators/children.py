"""Per-event features from child tables (codes, stays, measurements, drugs).

The reference loops over every event and filters the child table for it
(one scan per key). Here each child table is aggregated once with
``groupBy(key)``: all features of one table are conditional aggregates in a
single pass (map-side partial aggregation, so a key with a huge number of
child rows is combined before the shuffle; where first and last values are
asked for, rows are sorted within their key instead), then left-joined to the
events and zero-filled.

A feature *spec* is a list of aggregate expressions plus post-aggregation
columns; :func:`aggregate_children` runs any number of specs over one child
table in one ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import indicator


@dataclass
class ChildSpec:
    aggs: list[Column] = field(default_factory=list)
    post: list[tuple[str, Column]] = field(default_factory=list)
    fill: dict[str, object] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    # exact distinct counts ``(name, column)``, computed in a separate narrow
    # aggregate so the wide one keeps a plain partial/final plan
    distinct: list[tuple[str, Column]] = field(default_factory=list)
    # ``(name, group, order)``: the columns ``name_first`` and ``name_last`` say whether a child row is the first, the last
    # of its key and group in this order. Spark's min_by over a struct keeps its buffers out of the hash aggregate
    ends: list[tuple[str, Column, list[Column]]] = field(default_factory=list)

    def __add__(self, other: "ChildSpec") -> "ChildSpec":
        return ChildSpec(self.aggs + other.aggs, self.post + other.post,
                         {**self.fill, **other.fill}, self.drop + other.drop,
                         self.distinct + other.distinct, self.ends + other.ends)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def aggregate_children(children: DataFrame, key: str, specs: Sequence[ChildSpec]) -> DataFrame:
    """One ``groupBy(key)`` evaluating every spec's aggregates, then the
    post-aggregation columns."""
    spec = specs[0]
    for s in specs[1:]:
        spec = spec + s
    if spec.ends:
        # narrow rows are shuffled and sorted once (on disk, where a key has many); all aggregates then stay in their partition
        children = children.repartition(key)
        for name, group, order in spec.ends:
            w = Window.partitionBy(key, f"{name}_group").orderBy(*order)
            children = children.withColumn(f"{name}_group", group).withColumns({
                f"{name}_first": F.lag(F.lit(1)).over(w).isNull(), f"{name}_last": F.lead(F.lit(1)).over(w).isNull()})
    # distinct values are counted in the same pass: Spark groups by (key, value) first, then by key
    out = children.groupBy(key).agg(*spec.aggs, *[F.count_distinct(col).alias(name) for name, col in spec.distinct])
    for name, col in spec.post:
        out = out.withColumn(name, col)
    return out.drop(*spec.drop) if spec.drop else out


def attach(events: DataFrame, features: DataFrame, event_key: str, feature_key: str | None = None,
           fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left-join a per-key feature table to the events and fill keys without
    child rows (the reference inner-joins tables it built for exactly these
    keys, so no event is lost)."""
    fk = feature_key or event_key
    if fk != event_key:
        features = features.withColumnRenamed(fk, event_key)
    out = events.join(features, event_key, "left")
    if fill:
        out = out.fillna(dict(fill))
    return out


# --------------------------------------------------------------------------
# coded children (diagnosis-like): counts, group flags, subtype flags


def coded_spec(code, primary_codes: Sequence, groups: Mapping[str, Sequence],
               subtypes: Mapping[str, Sequence] | None = None,
               total: str = "total_codes", primary: str = "primary_count",
               group_count: str = "group_count", complexity: str = "complexity_score",
               products: Mapping[str, tuple[str, str]] | None = None) -> ChildSpec:
    """Diagnosis-style features of one event:

    * ``total`` rows, ``primary`` = rows whose code is in ``primary_codes``
    * ``has_<group>`` = any row in the group (one flag per group / subtype)
    * ``group_count`` = number of groups present
    * ``complexity`` = total + primary + group_count
    * ``products``: ``{name: (flag_a, flag_b)}`` interaction flags; a flag
      name ``'primary'`` means ``primary > 0``.
    """
    c = _c(code)
    subtypes = dict(subtypes or {})
    aggs = [F.count(F.lit(1)).alias(total),
            F.count_if(c.isin(list(primary_codes))).alias(primary)]
    flags = {}
    for name, codes in {**groups, **subtypes}.items():
        flags[name] = f"has_{name}"
        aggs.append(F.coalesce(F.max(c.isin(list(codes)).cast("int")), F.lit(0)).alias(f"has_{name}"))
    gsum = F.lit(0)
    for name in groups:
        gsum = gsum + F.col(f"has_{name}")
    post = [(group_count, gsum.cast("int")),
            (complexity, (F.col(total) + F.col(primary) + F.col(group_count)).cast("bigint"))]
    for name, (a, b) in (products or {}).items():
        fa = indicator(F.col(primary) > 0) if a == "primary" else F.col(f"has_{a}")
        fb = indicator(F.col(primary) > 0) if b == "primary" else F.col(f"has_{b}")
        post.append((name, (fa * fb).cast("int")))
    fill = {total: 0, primary: 0, group_count: 0, complexity: 0,
            **{f"has_{n}": 0 for n in flags}, **{n: 0 for n in (products or {})}}
    return ChildSpec(aggs, post, fill)


# --------------------------------------------------------------------------
# subset children (stay-like): sum / count / max / has


def subset_spec(value, condition: Column | None = None, prefix: str = "sub",
                log1p_sum: bool = True) -> ChildSpec:
    """``has_<p>``, ``<p>_count``, ``<p>_sum``, ``<p>_max`` (and
    ``<p>_sum_log``) over the child rows satisfying ``condition``; 0 when the
    event has none."""
    v = _c(value)
    cond = condition if condition is not None else F.lit(True)
    aggs = [F.count_if(cond).alias(f"{prefix}_count"),
            F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0)).alias(f"{prefix}_sum"),
            F.coalesce(F.max(F.when(cond, v)), F.lit(0.0)).alias(f"{prefix}_max")]
    post = [(f"has_{prefix}", indicator(F.col(f"{prefix}_count") > 0))]
    if log1p_sum:
        post.append((f"{prefix}_sum_log", F.log1p(F.col(f"{prefix}_sum"))))
    fill = {f"{prefix}_count": 0, f"{prefix}_sum": 0.0, f"{prefix}_max": 0.0, f"has_{prefix}": 0}
    if log1p_sum:
        fill[f"{prefix}_sum_log"] = 0.0
    return ChildSpec(aggs, post, fill)


# --------------------------------------------------------------------------
# measured children (lab-like): per-item pivoted statistics


@dataclass(frozen=True)
class ItemRule:
    """Severity rule for one measured item: ``direction='high'`` flags
    ``last > mild`` / ``last > severe``; ``'low'`` flags ``last < mild`` /
    ``last < severe``."""
    name: str
    item: object
    direction: str
    mild: float
    severe: float


def measured_spec(item, value, order: Sequence, rules: Sequence[ItemRule],
                  total: str = "total_measurements",
                  ratio: tuple[str, str, str, float] | None = None) -> ChildSpec:
    """Per-item statistics of one event, one pass, explicit item list (no
    ``pivot`` discovery job): ``<n>_first``, ``_last`` (by ``order``, file
    order in the reference), ``_mean``, ``_max``, ``_min``, ``_std`` (sample;
    0 for a single value), ``_trend`` = last - first, ``has_<n>``, and the
    rule's flags ``<n>_elevated``/``<n>_severe`` (high) or ``<n>_low``/
    ``<n>_very_low`` (low), 0 when the item is missing.

    ``ratio = (name, numerator_item_name, denominator_item_name, floor)``
    adds ``last_num / max(last_den, floor)``, NULL unless both exist.
    """
    it, v = _c(item), _c(value)
    at = "_at_" + total
    which = F.coalesce(*[F.when(it == F.lit(r.item), i) for i, r in enumerate(rules)], F.lit(-1))
    aggs = [F.count(F.lit(1)).alias(total)]
    post: list[tuple[str, Column]] = []
    drop = []
    fill: dict[str, object] = {total: 0}
    for r in rules:
        m = it == F.lit(r.item)
        n = r.name
        aggs += [
            F.max(F.when(m & F.col(f"{at}_first"), v)).alias(f"{n}_first"),
            F.max(F.when(m & F.col(f"{at}_last"), v)).alias(f"{n}_last"),
            F.avg(F.when(m, v)).alias(f"{n}_mean"),
            F.max(F.when(m, v)).alias(f"{n}_max"),
            F.min(F.when(m, v)).alias(f"{n}_min"),
            F.stddev_samp(F.when(m, v)).alias(f"_{n}_sd"),
            F.count_if(m).alias(f"_{n}_n"),
        ]
        last = F.col(f"{n}_last")
        if r.direction == "high":
            f1, f2 = (f"{n}_elevated", last > r.mild), (f"{n}_severe", last > r.severe)
        else:
            f1, f2 = (f"{n}_low", last < r.mild), (f"{n}_very_low", last < r.severe)
        post += [
            (f"{n}_std", F.when(F.col(f"_{n}_n") == 1, F.lit(0.0)).otherwise(F.col(f"_{n}_sd"))),
            (f"{n}_trend", F.col(f"{n}_last") - F.col(f"{n}_first")),
            (f"has_{n}", indicator(F.col(f"_{n}_n") > 0)),
            (f1[0], indicator(f1[1])),
            (f2[0], indicator(f2[1])),
        ]
        drop += [f"_{n}_sd", f"_{n}_n"]
        fill.update({f"has_{n}": 0, f1[0]: 0, f2[0]: 0})
    if ratio:
        name, num, den, floor = ratio
        post.append((name, F.when((F.col(f"has_{num}") == 1) & (F.col(f"has_{den}") == 1),
                                  F.col(f"{num}_last") / F.greatest(F.col(f"{den}_last"),
                                                                    F.lit(float(floor))))))
    return ChildSpec(aggs, post, fill, drop, ends=[(at, which, [_c(o) for o in order])])


# --------------------------------------------------------------------------
# drug-like children: totals, distinct, class flags, guideline score


def drug_spec(drug, classes: Mapping[str, Sequence[str]],
              guideline: tuple[Sequence[str], str, str] | None = None,
              total: str = "total_drugs", unique: str = "unique_drugs",
              class_count: str = "class_count", polypharmacy_min: int = 10,
              approx_unique: bool = False) -> ChildSpec:
    """Medication-style features: ``total`` rows, ``unique`` distinct drugs,
    ``has_<class>`` per class (exact string match), ``class_count``, and with
    ``guideline = ([either_a, either_b], second, third)`` a guideline score
    ``max(either) + second + third`` with ``optimal`` (>= 3), ``suboptimal``
    (< 2); ``polypharmacy`` = total >= ``polypharmacy_min``."""
    d = _c(drug)
    aggs = [F.count(F.lit(1)).alias(total)]
    distinct = []
    if approx_unique:
        aggs.append(F.approx_count_distinct(d).alias(unique))
    else:
        distinct.append((unique, d))
    for name, members in classes.items():
        aggs.append(F.coalesce(F.max(d.isin(list(members)).cast("int")), F.lit(0)).alias(f"has_{name}"))
    csum = F.lit(0)
    for name in classes:
        csum = csum + F.col(f"has_{name}")
    post = [(class_count, csum.cast("int")),
            ("polypharmacy", indicator(F.col(total) >= polypharmacy_min))]
    fill = {total: 0, unique: 0, class_count: 0, "polypharmacy": 0,
            **{f"has_{n}": 0 for n in classes}}
    if guideline:
        either, second, third = guideline
        score = (F.greatest(*[F.col(f"has_{e}") for e in either]) if len(either) > 1
                 else F.col(f"has_{either[0]}"))
        score = (score + F.col(f"has_{second}") + F.col(f"has_{third}")).cast("int")
        post += [("guideline_score", score),
                 ("optimal_therapy", indicator(F.col("guideline_score") >= 3)),
                 ("suboptimal_therapy", indicator(F.col("guideline_score") < 2))]
        fill.update({"guideline_score": 0, "optimal_therapy": 0, "suboptimal_therapy": 1})
    return ChildSpec(aggs, post, fill, distinct=distinct)


def exists_flag(events: DataFrame, children: DataFrame, event_key: str, child_key: str,
                flag: str) -> DataFrame:
    """0/1 flag: the event has at least one child row (EXISTS). Implemented as
    a left join to the distinct child keys, which Spark plans as a
    partially-aggregated shuffle (no per-event lookup)."""
    keys = children.select(F.col(child_key).alias("_ex_k")).distinct().withColumn("_ex_1", F.lit(1))
    out = events.join(keys, events[event_key] == keys["_ex_k"], "left")
    return out.withColumn(flag, F.coalesce(F.col("_ex_1"), F.lit(0))).drop("_ex_k", "_ex_1")
