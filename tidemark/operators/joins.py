"""Joins with pinned tie, null and tolerance rules. As-of joins are one union and one window: no row is multiplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    events: DataFrame, snapshots: DataFrame, by: Sequence[str], on: str, snap_on: str, values: Sequence[str], *,
    direction: str = "backward", strict: bool = False, tie: Sequence[str] = (),
) -> DataFrame:
    """Each event with the last snapshot at or before it (backward) or the first at or after it (forward).

    strict excludes equal times. Among snapshots of equal time the last by `tie` wins (forward: the first). Events keep
    their count; without a match, values are null. Rows with a null key or time match nothing. A hot key stays one
    window partition: salt it by time range beforehand if a single key outgrows a task.
    """
    back = direction == "backward"
    marker = F.struct(*[F.col(v) for v in values], F.col(snap_on).alias("__at"))
    left = events.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(on).alias("__t"), F.struct(*events.columns).alias("__e"))
    right = snapshots.where(F.col(snap_on).isNotNull()).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(snap_on).alias("__t"), marker.alias("__s"), F.struct(*(tie or [snap_on])).alias("__tie"))
    # at equal times snapshots stand before events, or behind them where equality does not count
    left, right = left.withColumn("__o", F.lit(1)), right.withColumn("__o", F.lit(2 if strict else 0) if back else F.lit(0 if strict else 2))
    both = left.unionByName(right, allowMissingColumns=True)
    keys = [f"__k{i}" for i in range(len(by))]
    w = Window.partitionBy(*keys).orderBy("__t", "__o", "__tie")
    if back:
        found = F.last("__s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("__s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    known = F.col("__t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = both.withColumn("__s", F.when(known, found)).where(F.col("__e").isNotNull())
    return out.select("__e.*", *[F.col("__s")[v].alias(v) for v in values], F.col("__s")["__at"].alias(f"matched_{snap_on}"))


def asof_nearest(events: DataFrame, snapshots: DataFrame, by: Sequence[str], on: str, snap_on: str, values: Sequence[str], days: int, tie: Sequence[str] = ()) -> DataFrame:
    """The nearest snapshot in either direction, null beyond `days`. At equal distance the earlier one wins."""
    cols = [*values]
    back = asof(events, snapshots, by, on, snap_on, cols, tie=tie).withColumnsRenamed({**{v: f"__b_{v}" for v in cols}, f"matched_{snap_on}": "__b"})
    both = asof(back, snapshots, by, on, snap_on, cols, direction="forward", tie=tie).withColumnRenamed(f"matched_{snap_on}", "__f")
    gap_b, gap_f = F.datediff(F.col(on), F.col("__b")), F.datediff(F.col("__f"), F.col(on))
    near_b = gap_b.isNotNull() & (gap_f.isNull() | (gap_b <= gap_f))
    gap = F.when(near_b, gap_b).otherwise(gap_f)
    pick = lambda b, f: F.when(gap <= days, F.when(near_b, F.col(b)).otherwise(F.col(f)))
    return both.select(*events.columns, *[pick(f"__b_{v}", v).alias(v) for v in cols], pick("__b", "__f").alias(f"matched_{snap_on}"), F.when(gap <= days, gap).alias("gap_days"))


def left_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that raises where a key of the right side has several rows."""
    twice = right.groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the right side has several rows for {twice[0].asDict()}")
    return left.join(right, list(on), "left")


def indicator(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full join of two key sets with side: left_only, right_only or both."""
    a, b = left.select(*on).distinct().withColumn("__l", F.lit(True)), right.select(*on).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, list(on), "full").select(*on, side.alias("side"))


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond: Column = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def until(rows: DataFrame, cutoffs: DataFrame, on: Sequence[str], at: str, cutoff: str) -> DataFrame:
    """Rows dated on or before their key's cutoff; keys without one keep all."""
    return rows.join(cutoffs.select(*on, cutoff), list(on), "left").where(F.col(cutoff).isNull() | (F.col(at) <= F.col(cutoff))).drop(cutoff)


def within_days(left: DataFrame, right: DataFrame, on: str, at: str, right_at: str, days: int, anti: bool = False) -> DataFrame:
    """Left rows with (anti: without) a right row of their key dated 0 to `days` days later.

    The band becomes an equality on windows of `days` days, so that the join can be dealt out by key and time.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / (days + 1))
    a = left.withColumn("__b", F.explode(F.array(bucket(at), bucket(at) + 1)))
    r = right.select(F.col(on).alias("__on"), F.col(right_at).alias("__at"), bucket(right_at).alias("__rb"))
    hit = a.join(r, (F.col(on) == F.col("__on")) & (F.col("__b") == F.col("__rb")) & F.datediff(F.col("__at"), F.col(at)).between(0, days), "left_semi")
    hit = hit.drop("__b").distinct()
    return null_safe(left, hit, left.columns, "left_anti") if anti else null_safe(left, hit, left.columns, "left_semi")


def grid(keys: DataFrame, periods: DataFrame, values: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Every key with every period (a short list), measures 0 where there is no row."""
    listed = periods.agg(F.collect_set(periods.columns[0]).alias("__p"))
    full = keys.join(F.broadcast(listed)).withColumn(periods.columns[0], F.explode("__p")).drop("__p")
    return full.join(values, list(on), "left").fillna(0, list(measures))


def regex_lexicon(texts: DataFrame, text: str, lexicon: dict[str, str]) -> DataFrame:
    """(text, term) for each term whose pattern is found; each distinct text is searched once."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(t)) for t, p in lexicon.items()]))
    # explode would have the optimizer infer a filter on the array, and so search every text twice
    return texts.select(text).distinct().select(text, F.explode_outer(hits).alias("term")).where(F.col("term").isNotNull())
