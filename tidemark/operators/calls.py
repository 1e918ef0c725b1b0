"""Checks of call transcripts: whose call it is, when it was, and which transcript stands for an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

# How an opening names the period, the date and the host.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
QUARTER = r"(?i)\b(?:(first|second|third|fourth)[ -]quarter|q([1-4])|([1-4])q)\b"
YEAR = r"(?i)(?:fiscal(?: year)?|fy|of|')?\s*'?(20[0-9]{2}|[0-9]{2})\b"
DATE = r"\b(January|February|March|April|May|June|July|August|September|October|November|December) ([0-9]{1,2}),? (20[0-9]{2})\b"
HOST = r"\b[Ww]elcome to (?:the )?((?:[A-Z0-9&][A-Za-z0-9&'.,-]*\s+){0,6}?[A-Z0-9&][A-Za-z0-9&'.,-]*?)(?:'s)?\s+(?:(?:20[0-9]{2}|[Ff]iscal|[Ff]irst|[Ss]econd|[Tt]hird|[Ff]ourth|[Qq][1-4]|[1-4][Qq])\b|[Ee]arnings|[Cc]onference|[Rr]esults)"


def stated_period(intro: Column) -> Column:
    """'2024Q1' from the first quarter that the opening names and the year beside it (before, or within the sentence after)."""
    word = F.lower(F.regexp_extract(intro, QUARTER, 1))
    number = F.coalesce(*[F.when(word == w, F.lit(q)) for w, q in ORDINALS.items()], F.regexp_extract(intro, QUARTER, 2).try_cast("int"), F.regexp_extract(intro, QUARTER, 3).try_cast("int"))
    around = F.regexp_extract(intro, r"(?i)(?:\b(20[0-9]{2})\s+)?" + QUARTER, 1)
    after = F.regexp_extract(F.regexp_extract(intro, QUARTER + r"([^.]{0,60})", 4), YEAR, 1)
    year = F.coalesce(around.try_cast("int"), after.try_cast("int"))
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(number.isNotNull() & year.isNotNull(), F.concat(year.cast("string"), F.lit("Q"), number.cast("string")))


def stated_date(head: Column) -> Column:
    parts = [F.regexp_extract(head, DATE, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws(" ", *parts), "MMMM d yyyy"))


def host_company(intro: Column) -> Column:
    name = F.trim(F.regexp_extract(intro, HOST, 1))
    return F.when(name != "", F.rtrim(F.regexp_replace(name, r"[ ,.]+$", "")))


def call_check(calls: DataFrame, early: int = 7, late: int = 7) -> DataFrame:
    """calls (call_id, company_name, call_date, fiscal_period, intro) with host, stated_period, stated_date, release_gap,
    other_host and exclude_reason: another company's call, another day than stated, another period than stated; null if none.
    """
    df = calls.withColumns({"host": host_company(F.col("intro")), "stated_period": stated_period(F.col("intro")), "stated_date": stated_date(F.col("intro"))})
    df = df.withColumn("other_host", F.col("host").isNotNull() & ~N.is_host(F.col("host"), N.alias_forms(F.col("company_name"))))
    gap = F.datediff("call_date", "stated_date")
    df = df.withColumn("release_gap", gap)
    reason = F.when(F.col("other_host"), "other_company").when(gap.isNotNull() & ~gap.between(-early, late), "other_date").when(F.col("stated_period") != F.col("fiscal_period"), "other_period")
    return df.withColumn("exclude_reason", reason)


def representative(calls: DataFrame, group: str, rank: str, length: str) -> DataFrame:
    """is_representative: of a group's calls without a reason against them the one of the best source, then the longest."""
    w = Window.partitionBy(group).orderBy(F.col("exclude_reason").isNotNull().cast("int"), rank, F.col(length).desc(), "call_id")
    return calls.withColumn("is_representative", (F.row_number().over(w) == 1) & F.col("exclude_reason").isNull())
