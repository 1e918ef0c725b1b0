"""Daily series and event windows. Offsets are row positions in a unit's own series, never calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(prices: DataFrame, unit: str, day: str, level: str) -> DataFrame:
    """Adds rn (row position from 1) and ret (change of the non-null level to the row before)."""
    w = Window.partitionBy(unit).orderBy(day)
    df = prices.where(F.col(level).isNotNull()).withColumn("rn", F.row_number().over(w))
    before = F.lag(level).over(w)
    return df.withColumn("ret", F.when(before != 0, F.col(level) / F.when(before != 0, before) - 1))


def event_rows(events: DataFrame, daily: DataFrame, unit: str, at: str, day: str) -> DataFrame:
    """Each event with event_rn, the position of the unit's first row on or after its date; null if there is none."""
    from .joins import asof

    return asof(events, daily.select(unit, day, F.col("rn").alias("event_rn")), [unit], at, day, ["event_rn"], direction="forward").drop(f"matched_{day}")


def offset_value(events: DataFrame, daily: DataFrame, unit: str, offset: int, value: str, name: str) -> DataFrame:
    right = daily.select(F.col(unit).alias("__u"), F.col("rn").alias("__rn"), F.col(value).alias(name))
    return events.join(right, (F.col(unit) == F.col("__u")) & (F.col("event_rn") + offset == F.col("__rn")), "left").drop("__u", "__rn")


def frame_beta(daily: DataFrame, unit: str, excess: str, factor: str, low: int, high: int, floor: int) -> DataFrame:
    """beta, alpha and n over rows [low, high) relative to each row; null under `floor` complete rows or a constant factor.

    Positions count all rows of the series; rows that lack the factor only drop out of the moments.
    """
    w = Window.partitionBy(unit).orderBy("rn").rowsBetween(low, high - 1)
    both = F.col(excess).isNotNull() & F.col(factor).isNotNull()
    y, x = F.when(both, F.col(excess)), F.when(both, F.col(factor))
    n = F.count(x).over(w)
    ok = (n >= floor) & (F.var_pop(x).over(w) > 0)
    return daily.select("*", n.alias("n"), F.when(ok, F.regr_slope(y, x).over(w)).alias("beta"), F.when(ok, F.regr_intercept(y, x).over(w)).alias("alpha"))


def crash_measures(residuals: DataFrame, by: list[str], r: str, floor: int) -> DataFrame:
    """ncskew and duvol of the residuals of each group; null under `floor` rows or without variation."""
    x = F.col(r)
    g = residuals.where(x.isNotNull()).withColumn("__m", F.avg(x).over(Window.partitionBy(*by)))
    up = x >= F.col("__m")
    agg = g.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x**2).alias("s2"), F.sum(x**3).alias("s3"), F.count(F.when(up, 1)).alias("nu"), F.count(F.when(~up, 1)).alias("nd"),
        F.sum(F.when(up, x**2)).alias("su"), F.sum(F.when(~up, x**2)).alias("sd"),
    )
    n = F.col("n").cast("double")
    enough = (F.col("n") >= floor) & (F.col("s2") > 0) & (n > 2)
    skew = F.when(enough, -(n * F.pow(n - 1, F.lit(1.5)) * F.col("s3")) / ((n - 1) * (n - 2) * F.pow("s2", F.lit(1.5))))
    sides = (F.col("n") >= floor) & (F.col("nu") > 1) & (F.col("nd") > 1) & (F.col("su") > 0) & (F.col("sd") > 0)
    duvol = F.when(sides, F.log((F.col("nu") - 1) * F.col("sd") / ((F.col("nd") - 1) * F.col("su"))))
    return agg.select(*by, "n", skew.alias("ncskew"), duvol.alias("duvol"))


def weeks(daily: DataFrame, unit: str, day: str, volume: str) -> DataFrame:
    """Compound returns and total volume per week (Monday to Sunday)."""
    gross = F.exp(F.sum(F.log1p(F.col("ret"))))
    return daily.where("ret > -1").groupBy(unit, F.date_trunc("week", day).cast("date").alias("week")).agg((gross - 1).alias("ret"), F.sum(volume).alias(volume), F.count("ret").alias("days"))


def annualise(rate: Column, periods: int = 252) -> Column:
    return F.pow(1 + rate, F.lit(float(periods))) - 1


def frame_moments(daily: DataFrame, unit: str, excess: str, factor: str, low: int, high: int, floor: int) -> DataFrame:
    """beta, se_beta and idio_vol (deviation of the residuals) over rows [low, high) of each row; nulls as in frame_beta."""
    w = Window.partitionBy(unit).orderBy("rn").rowsBetween(low, high - 1)
    both = F.col(excess).isNotNull() & F.col(factor).isNotNull()
    y, x = F.when(both, F.col(excess)), F.when(both, F.col(factor))
    n, sxx = F.count(x).over(w), F.regr_sxx(y, x).over(w)
    ok = (n >= max(floor, 3)) & (sxx > 0)
    beta = F.regr_slope(y, x).over(w)
    variance = F.greatest(F.regr_syy(y, x).over(w) - beta * F.regr_sxy(y, x).over(w), F.lit(0.0)) / (n - 2)
    return daily.select("*", n.alias("n"), F.when(ok, beta).alias("beta"), F.when(ok, F.sqrt(variance / F.when(sxx > 0, sxx))).alias("se_beta"), F.when(ok, F.sqrt(variance)).alias("idio_vol"))


def beta_shift(events: DataFrame, moments: DataFrame, unit: str, before: int, after: int) -> DataFrame:
    """d_beta and its error between the windows that end `before` and `after` rows from the event (independent windows)."""
    out = events
    for name, offset in (("__a", before), ("__b", after)):
        right = moments.select(F.col(unit).alias("__u"), F.col("rn").alias("__rn"), F.col("beta").alias(f"{name}_beta"), F.col("se_beta").alias(f"{name}_se"))
        out = out.join(right, (F.col(unit) == F.col("__u")) & (F.col("event_rn") + offset == F.col("__rn")), "left").drop("__u", "__rn")
    out = out.withColumn("d_beta", F.col("__b_beta") - F.col("__a_beta")).withColumn("se_d_beta", F.sqrt(F.col("__a_se") ** 2 + F.col("__b_se") ** 2))
    return out.drop("__a_beta", "__b_beta", "__a_se", "__b_se")


def momentum(daily: DataFrame, unit: str, low: int, high: int, floor: int, name: str = "momentum") -> DataFrame:
    """Compound return over rows [low, high) of each row; null under `floor` returns."""
    w = Window.partitionBy(unit).orderBy("rn").rowsBetween(low, high - 1)
    r = F.when(F.col("ret") > -1, F.col("ret"))
    return daily.withColumn(name, F.when(F.count(r).over(w) >= floor, F.exp(F.sum(F.log1p(r)).over(w)) - 1))


def abnormal_returns(events: DataFrame, daily: DataFrame, unit: str, key: str, excess: str, factor: str, low: int, high: int, floor: int, beta_at: int, beta_window: tuple[int, int], beta_floor: int) -> DataFrame:
    """car per event: the sum over rows [low, high) of the excess over alpha + beta x factor, as fitted on the rows of
    beta_window around the row `beta_at` from the event. Null under `floor` rows or without a fit."""
    fits = frame_beta(daily, unit, excess, factor, *beta_window, beta_floor).select(F.col(unit).alias("__u"), F.col("rn").alias("__at"), "alpha", "beta")
    e = events.join(fits, (F.col(unit) == F.col("__u")) & (F.col("event_rn") + beta_at == F.col("__at")), "left").drop("__u", "__at")
    e = e.withColumn("__rn", F.explode(F.sequence(F.col("event_rn") + low, F.col("event_rn") + high - 1)))
    d = daily.select(F.col(unit).alias("__u"), F.col("rn").alias("__d"), F.col(excess).alias("__y"), F.col(factor).alias("__x"))
    rows = e.join(d, (F.col(unit) == F.col("__u")) & (F.col("__rn") == F.col("__d")))
    off = F.col("__y") - F.col("alpha") - F.col("beta") * F.col("__x")
    car = rows.groupBy(F.col(key).alias("__key")).agg(F.count(off).alias("__n"), F.sum(off).alias("__s"))
    return events.join(car, F.col(key) == F.col("__key"), "left").withColumn("car", F.when(F.col("__n") >= floor, F.col("__s"))).drop("__key", "__n", "__s")


def expanded_residuals(weekly: DataFrame, unit: str, order: str, y: str, x: str, reach: int = 2, floor: int = 10) -> DataFrame:
    """weekly rows of units that have enough, with the residual of y on x at -reach..+reach rows (and a constant).

    Shifts are window lags, so a row only needs its neighbours to exist; rows that lack one are left out. A unit's rows
    are one short series, solved on its own.
    """
    import numpy as np
    import pandas as pd

    w = Window.partitionBy(unit).orderBy(order)
    names = [f"__x{k}" for k in range(2 * reach + 1)]
    wide = weekly.select("*", *[(F.lag(x, reach - k) if k < reach else F.lead(x, k - reach)).over(w).alias(n) for k, n in enumerate(names)]).dropna(subset=[y, *names])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in weekly.schema.fields)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < floor:
            return part.assign(residual=np.nan).drop(columns=names).iloc[:0]
        m = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)])
        v = part[y].to_numpy(float)
        return part.drop(columns=names).assign(residual=v - m @ np.linalg.lstsq(m, v, rcond=None)[0])

    return wide.groupBy(unit).applyInPandas(solve, f"{kinds}, residual double")
