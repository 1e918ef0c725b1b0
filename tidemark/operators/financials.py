"""Financial statements at the date they became public."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import asof_nearest


def scaled(statements: DataFrame, millions: Sequence[str], outflows: Sequence[str] = ()) -> DataFrame:
    """Columns given in millions as units, and signed outflows as positive amounts."""
    out = statements.withColumns({c: F.col(c) * 1e6 for c in millions})
    return out.withColumns({c: -F.col(c) for c in outflows})


def point_in_time(annual: DataFrame, quarterly: DataFrame, filings: DataFrame, releases: DataFrame, days: int = 10, running: str = "LTM") -> DataFrame:
    """Both tables with period, filing_date_pt, accession_number and pit_source.

    A statement (ticker, period_end) is matched to the filing whose period ends nearest, at most `days` away; annual
    statements only to annual filings. Without one, the release date nearest in the same way serves. Statements whose
    period_status says that the year still runs are left out. filings: ticker, form, accession_number, filing_date,
    period_end_date; releases: ticker, period, period_end, eps_rpt_date.
    """
    status = F.coalesce(F.col("period_status") == running, F.lit(False))
    out = None
    for period, statements in (("annual", annual.where(~status)), ("quarterly", quarterly)):
        keys = statements.select("ticker", "period_end").distinct()
        usable = (filings.where("form = '10-K'") if period == "annual" else filings).where("filing_date IS NOT NULL").select("ticker", F.col("period_end_date").alias("__end"), "accession_number", "filing_date")
        dated = releases.where((F.col("period") == period) & F.col("eps_rpt_date").isNotNull()).select("ticker", F.col("period_end").alias("__end"), "eps_rpt_date")
        keys = asof_nearest(keys, usable, ["ticker"], "period_end", "__end", ["accession_number", "filing_date"], days, ["filing_date", "accession_number"]).drop("matched___end", "gap_days")
        keys = asof_nearest(keys, dated, ["ticker"], "period_end", "__end", ["eps_rpt_date"], days, ["eps_rpt_date"]).drop("matched___end", "gap_days")
        source = F.when(F.col("filing_date").isNotNull(), "edgar").when(F.col("eps_rpt_date").isNotNull(), "fs_release")
        keys = keys.select("ticker", "period_end", F.coalesce("filing_date", "eps_rpt_date").alias("filing_date_pt"), "accession_number", source.alias("pit_source"))
        part = statements.withColumn("period", F.lit(period)).join(keys, ["ticker", "period_end"], "left")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def ratios(panel: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """name = numerator / denominator, null where the denominator is not positive."""
    return panel.withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)) for name, a, b in pairs})
