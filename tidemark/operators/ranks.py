"""Ranks over a whole table without a window over it: values are dealt by range, and each range starts where the ones before end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .firms import checkpoint_dir

#: Periods of a point-in-time rank: a row holds a count for each.
MOST_PERIODS = 4096


def running(cells: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """cells (one row per value of `order`) with `<c>_upto`, the sum of c up to and including the row, and `<c>_all`."""
    checkpoint_dir(cells.sparkSession)
    # the checkpoint keeps the ranges as they were dealt, for the totals and for the rows alike
    dealt = cells.repartitionByRange(order).withColumn("__range", F.spark_partition_id()).checkpoint()
    per = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums)])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.select("__range", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))], *[F.sum(f"__s{i}").over(every).alias(f"{c}_all") for i, c in enumerate(sums)])
    within = Window.partitionBy("__range").orderBy(order)
    out = dealt.join(F.broadcast(per), "__range")  # one row a partition
    return out.select(*cells.columns, *[(F.sum(c).over(within) + F.col(f"__b{i}")).alias(f"{c}_upto") for i, c in enumerate(sums)], *[f"{c}_all" for c in sums])


def midranks(df: DataFrame, value: str) -> DataFrame:
    """value, rank: the average rank of each distinct value over all rows, from 1."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    return running(cells, value, ["__n"]).select(value, (F.col("__n_upto") - (F.col("__n") - 1) / 2).alias("rank"))


def ecdf(df: DataFrame, value: str, train: str) -> DataFrame:
    """value, ecdf: the share of the rows marked in `train` that are not above each distinct value."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(train).alias("__n"))
    return running(cells, value, ["__n"]).select(value, F.when(F.col("__n_all") > 0, F.col("__n_upto") / F.col("__n_all")).alias("ecdf"))


def earlier_midrank(df: DataFrame, period: str, value: str) -> DataFrame:
    """Mid-rank of a value among all values of earlier periods (pit_rank); in the first period among its own.

    One row per distinct value holds its count before each period, and one running sum over the values serves all
    periods at once. Periods are few (checked); rows, values and keys may be many.
    """
    held = df.where(F.col(value).isNotNull())
    periods = [r[0] for r in held.select(period).distinct().orderBy(period).limit(MOST_PERIODS + 1).collect()]
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    if not periods:
        return df.withColumn("pit_rank", F.lit(None).cast("double"))
    counts = held.groupBy(F.col(value).alias("__v")).agg(*[F.count_if(F.col(period) == F.lit(p)).alias(f"n{i}") for i, p in enumerate(periods)])
    own = F.array(*[F.col(f"n{i}") for i in range(len(periods))])
    earlier = F.transform(F.sequence(F.lit(0), F.lit(len(periods) - 1)), lambda i: F.when(i == 0, F.get(own, 0)).otherwise(F.aggregate(F.slice(own, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)))
    cells = counts.select("__v", own.alias("__own"), earlier.alias("__e")).select("__v", "__own", *[F.get("__e", i).alias(f"e{i}") for i in range(len(periods))])
    ranked = running(cells, "__v", [f"e{i}" for i in range(len(periods))])
    rank = lambda i: F.when(F.col(f"e{i}_all") > 0, (2 * F.col(f"e{i}_upto") - F.col(f"e{i}")) / (2 * F.col(f"e{i}_all")))
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.get("__own", i).alias("n"), rank(i).alias("r")) for i, p in enumerate(periods)])
    long = ranked.select("__v", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("x")).select("__v", F.col("x.p").alias("__at"), F.col("x.r").alias("pit_rank"))
    return df.join(long, (F.col(period) == F.col("__at")) & (F.col(value) == F.col("__v")), "left").drop("__at", "__v")
