"""Spines, period panels, shrinkage and the population-relative index. Every rank and prior is per period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import pct_rank


def alignment(spine: DataFrame, tables: Mapping[str, DataFrame], key: str, attributes: Sequence[str] = ()) -> DataFrame:
    """Per table: keys missing from it, keys outside the spine, duplicate keys, rows whose shared attributes differ."""
    out = None
    for name, t in tables.items():
        shared = [a for a in attributes if a in t.columns]
        per = t.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.min(a).alias(f"__{a}") for a in shared])
        differ = F.lit(False)
        for a in shared:
            differ = differ | ~F.col(a).eqNullSafe(F.col(f"__{a}"))
        both = spine.select(key, *shared, F.lit(1).alias("__s")).join(per, key, "full")
        one = both.agg(
            F.count(F.when(F.col("__n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("__s").isNull(), 1)).alias("outside"),
            F.count(F.when(F.col("__n") > 1, 1)).alias("duplicates"), F.count(F.when(F.col("__s").isNotNull() & F.col("__n").isNotNull() & differ, 1)).alias("mismatched"),
        ).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def join_families(spine: DataFrame, families: Mapping[str, DataFrame], key: str) -> DataFrame:
    """The spine with every family's columns. A column that several families share stays one column where all its
    values agree (nulls included), else each later one becomes family__column. Keys must be unique in each family."""
    out = spine
    for name, family in families.items():
        new = family.columns
        clash = [c for c in new if c != key and c in out.columns]
        renamed = family.withColumnsRenamed({c: f"{name}__{c}" for c in clash})
        out = out.join(renamed, key, "left")
        if clash:
            odd = out.agg(*[F.max((~F.col(c).eqNullSafe(F.col(f"{name}__{c}"))).cast("int")).alias(c) for c in clash]).first()
            out = out.drop(*[f"{name}__{c}" for c in clash if not odd[c]])
    return out


def windowed_measures(cells: DataFrame, unit: str, period: str, measures: Sequence[str]) -> DataFrame:
    """cells: one row per unit and period (an integer ordinal), gaps filled. Adds m_quarter, m_ttm, m_expanding."""
    w = Window.partitionBy(unit).orderBy(period)
    wide = []
    for m in measures:
        wide += [F.col(m).alias(f"{m}_quarter"), F.sum(m).over(w.rowsBetween(-3, 0)).alias(f"{m}_ttm"), F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{m}_expanding")]
    return cells.select(unit, period, *wide)


def shrink(numerator: Column, denominator: Column, *period: str) -> Column:
    """Rate pulled to the period's mean by a Beta prior fitted to the period's rates by moments; the prior where the denominator is 0."""
    w = Window.partitionBy(*period)
    raw = F.when(denominator > 0, numerator / denominator)
    mean, var = F.avg(raw).over(w), F.var_samp(raw).over(w)
    strength = F.when((mean > 0) & (mean < 1) & (var > 0), F.greatest(mean * (1 - mean) / F.when(var > 0, var) - 1, F.lit(1e-6))).otherwise(1.0)
    return (F.coalesce(raw, F.lit(0.0)) * denominator + mean * strength) / (denominator + strength)


def gap_index(panel: DataFrame, period: str, volume: str, count: str, grounding: Sequence[tuple[str, str]], tail: float = 0.05) -> DataFrame:
    """pct_volume, pct_substance, their difference w, and flags for its tails, within each period.

    Substance is log1p(count) times the mean of the shrunken grounding rates (pairs of numerator and denominator).
    """
    rates = [shrink(F.col(a), F.col(b), period) for a, b in grounding]
    total = rates[0]
    for r in rates[1:]:
        total = total + r
    df = panel.withColumn("grounding", total / len(rates)).withColumn("substance", F.log1p(F.col(count)) * F.col("grounding"))
    df = df.withColumn("pct_volume", pct_rank(F.col(volume), period)).withColumn("pct_substance", pct_rank(F.col("substance"), period))
    df = df.withColumn("w", F.col("pct_volume") - F.col("pct_substance"))
    cut = df.groupBy(period).agg(F.percentile("w", F.lit(1 - tail)).alias("__hi"), F.percentile("w", F.lit(tail)).alias("__lo"))
    return df.join(cut, period).withColumn("high_tail", F.col("w") >= F.col("__hi")).withColumn("low_tail", F.col("w") <= F.col("__lo")).drop("__hi", "__lo")


def disclosure_index(disclosure: DataFrame, activity: DataFrame, reports: DataFrame, unit: str, period: str, volume: str, active: str, count: str, grounding: Sequence[str], tail: float = 0.05) -> DataFrame:
    """The index of units that disclose: w, its two ranks and the flags of its tails, within each period.

    disclosure (volume, active), activity (count and the counts in `grounding`) and reports have a row a unit and period.
    Rates are shrunk within the period over all activity rows. A period without a report of its own takes the activity of
    the last one that had (before any has, the row goes); then rows that are not active go, and ranks are taken.
    """
    total = F.lit(0.0)
    for g in grounding:
        total = total + shrink(F.col(g), F.col(count), period)
    shrunk = activity.select(unit, period, F.col(count).cast("double").alias("__c"), (total / len(grounding)).alias("__g"))
    known = reports.select(unit, period).distinct().withColumn("__r", F.lit(True))
    df = disclosure.select(unit, period, volume, active).join(shrunk, [unit, period], "left").join(known, [unit, period], "left")
    upto = Window.partitionBy(unit).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.last(F.when(F.col("__r"), F.col(c)), ignorenulls=True).over(upto) for c in ("__c", "__g")})
    df = df.where(F.col("__c").isNotNull() & F.col("__g").isNotNull() & (F.col(active) > 0)).withColumn("substance", F.log1p("__c") * F.col("__g"))
    df = df.withColumn("pct_volume", pct_rank(F.col(volume), period)).withColumn("pct_substance", pct_rank(F.col("substance"), period)).withColumn("w", F.col("pct_volume") - F.col("pct_substance"))
    cut = df.groupBy(period).agg(F.percentile("w", F.lit(1 - tail)).alias("__hi"), F.percentile("w", F.lit(tail)).alias("__lo"))
    df = df.join(cut, period).withColumn("high_tail", F.col("w") >= F.col("__hi")).withColumn("low_tail", F.col("w") <= F.col("__lo"))
    return df.drop("__hi", "__lo", "__r").withColumnsRenamed({"__c": count, "__g": "grounding"})


def quadrant_screen(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """unit, period, expanding, persistent and quadrant of a panel with w, pct_volume and pct_substance.

    expanding: the mean of w up to the period. persistent: w was at or over its period's median in two rows in a row, at
    any time. quadrant: by whether volume and substance reach their period's medians.
    """
    own, over = Window.partitionBy(unit).orderBy(period), Window.partitionBy(unit)
    middle = panel.groupBy(period).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in ("w", "pct_volume", "pct_substance")])
    df = panel.join(middle, period).withColumn("expanding", F.avg("w").over(own)).withColumn("__above", F.col("w") >= F.col("__m_w"))
    df = df.withColumn("__twice", F.col("__above") & F.coalesce(F.lag("__above").over(own), F.lit(False)))
    loud, solid = F.col("pct_volume") >= F.col("__m_pct_volume"), F.col("pct_substance") >= F.col("__m_pct_substance")
    quadrant = F.when(loud & solid, "VALIDATE").when(loud, "INVESTIGATE").when(solid, "EXPLORE").otherwise("DEPRIORITIZE")
    return df.select(unit, period, "expanding", F.max("__twice").over(over).alias("persistent"), quadrant.alias("quadrant"))


def vendor_presence(mentions: DataFrame, doc: str, family: str, families: Sequence[str], self_of: str | None = None) -> DataFrame:
    """Per document, whether and how often each listed family is mentioned; mentions of the document's own are left out."""
    own = mentions if self_of is None else mentions.where(~F.col(family).eqNullSafe(F.col(self_of)))
    counted = [F.count(F.when(F.col(family) == f, 1)).alias(f"n_{f}") for f in families]
    return own.groupBy(doc).agg(*counted).select(doc, *[c for f in families for c in (f"n_{f}", (F.col(f"n_{f}") > 0).alias(f"has_{f}"))])


def first_disclosed(facts: DataFrame, by: Sequence[str], filed: str, tie: Sequence[str]) -> DataFrame:
    """The value filed first; later restatements never replace it."""
    w = Window.partitionBy(*by).orderBy(filed, *tie)
    return facts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def concept_fallback(facts: DataFrame, by: Sequence[str], concept: str, value: str, priority: Sequence[str], singleton: Sequence[str] = ()) -> DataFrame:
    """One value per key: that of the first concept in `priority` that has one. Concepts in `singleton` count only where
    all their rows of the key agree and there are at least two."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(concept))
    per = facts.where(rank > 0).groupBy(*by, concept).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"))
    ok = ~F.col(concept).isin(*singleton) | ((F.col("__lo") == F.col("__hi")) & (F.col("__n") >= 2)) if singleton else F.lit(True)
    best = per.where(ok & F.col("__lo").isNotNull()).groupBy(*by).agg(F.min(F.struct(rank.alias("r"), F.col("__lo").alias(value), F.col(concept).alias("concept_used"))).alias("b"))
    return best.select(*by, f"b.{value}", "b.concept_used")


def value_creation(df: DataFrame, ebit: str, tax: str, equity: str, debt: str, cost_equity: str, cost_debt: str) -> DataFrame:
    """roic, wacc and spread; null where invested capital is not positive."""
    capital = F.col(equity) + F.col(debt)
    ok = capital > 0
    df = df.withColumn("roic", F.when(ok, F.col(ebit) * (1 - F.col(tax)) / capital))
    df = df.withColumn("wacc", F.when(ok, F.col(equity) / capital * F.col(cost_equity) + F.col(debt) / capital * F.col(cost_debt) * (1 - F.col(tax))))
    return df.withColumn("spread", F.col("roic") - F.col("wacc"))
