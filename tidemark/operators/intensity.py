"""Documents with the volume of what they disclose, those that disclose nothing included, and rates over any keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\t\n\f\r ]+"


def volumes(paragraphs: DataFrame, document: str, text: str = "paragraph_text") -> DataFrame:
    """document, n_paragraphs, n_words of the scorable paragraphs; a word is what white space parts."""
    words = F.regexp_count(F.btrim(text, F.lit(" ")), F.lit(WORD_BREAK)).cast("long") + 1
    return paragraphs.where("is_scorable").groupBy(document).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(words).alias("n_words"))


def frame_counts(frames: DataFrame, document: str, counts: Mapping[str, Column]) -> DataFrame:
    """document, n_frames and a sum of each named expression (a condition counts as 0 or 1)."""
    return frames.groupBy(document).agg(F.count(F.lit(1)).alias("n_frames"), *[F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).alias(n) for n, c in counts.items()])


def document_table(documents: DataFrame, paragraphs: DataFrame, frames: DataFrame, document: str, counts: Mapping[str, Column]) -> DataFrame:
    """documents that have scorable paragraphs, with their volumes and counts; without frames a count is zero, not null."""
    out = documents.join(volumes(paragraphs, document), document).join(frame_counts(frames, document, counts), document, "left")
    return out.fillna(0, subset=["n_frames", *counts])


def fiscal_year(day: Column, closing_month: Column) -> Column:
    """The year whose closing month is the first at or after the day's."""
    return F.year(day) + (F.month(day) > F.coalesce(closing_month, F.lit(12))).cast("int")


def aggregate(documents: DataFrame, document: str, keys: Sequence[str], counts: Sequence[str], conditional: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Sums by keys, `<c>_per_1k` words, any_frames, and for conditional counts their share of the frames (null without).

    Keys with fewer than `least` paragraphs have no row. Counts are named n_...; the prefix goes in the names of rates.
    """
    every = ["n_frames", *counts]
    g = documents.groupBy(*keys).agg(F.count_distinct(document).alias("n_docs"), *[F.sum(c).alias(c) for c in ("n_paragraphs", "n_words", *every)]).where(F.col("n_paragraphs") >= least)
    bare = lambda c: c.removeprefix("n_")
    rates = {f"{bare(c)}_per_1k": 1000.0 * F.col(c) / F.col("n_words") for c in every} | {"any_frames": (F.col("n_frames") > 0).cast("double")}
    return g.withColumns(rates | {f"{bare(c)}_rate": F.when(F.col("n_frames") > 0, F.col(c) / F.col("n_frames")) for c in conditional})
