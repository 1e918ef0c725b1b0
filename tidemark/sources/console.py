"""Ad-hoc SQL with a row limit, and the aggregate builder behind a chart."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = {"avg": F.avg, "sum": F.sum, "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count, "min": F.min, "max": F.max}


def run_sql(spark: SparkSession, sql: str, limit: int = 1000) -> dict:
    """rows, columns, seconds and error of a statement; never more than `limit` rows, whatever the text says."""
    text = sql.strip().rstrip(";").strip()
    began = time.time()
    try:
        df = spark.sql(text).limit(limit)
        rows = [r.asDict() for r in df.collect()]
        return {"rows": rows, "columns": df.columns, "n": len(rows), "seconds": time.time() - began, "error": None}
    except Exception as e:  # a console shows the message of whatever went wrong
        return {"rows": [], "columns": [], "n": 0, "seconds": time.time() - began, "error": str(e).splitlines()[0]}


def tables(spark: SparkSession) -> list[dict]:
    """Name and columns of each table and view of the session."""
    return [{"name": t.name, "columns": [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name)]} for t in spark.catalog.listTables()]


def aggregate_view(df: DataFrame, x: str, colour: str | None, measures: Sequence[tuple[str, str]], filters: Mapping[str, Sequence] | None = None, limit: int = 500) -> DataFrame:
    """Up to five measures by x (and colour) under IN filters, rounded to 4 digits, with row_count, ordered, limited."""
    if len(measures) > 5:
        raise ValueError("at most five measures")
    for c, values in (filters or {}).items():
        df = df.where(F.col(c).isin(*values))
    keys = [F.col(x).alias("x"), *([F.col(colour).alias("colour")] if colour else [])]
    aggs = [F.round(MEASURES[f](c), 4).alias(f"{f}_{c}") for f, c in measures]
    names = ["x", *(["colour"] if colour else [])]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("row_count")).orderBy(*names).limit(limit)


def raw_view(df: DataFrame, columns: Sequence[str], limit: int = 2000) -> DataFrame:
    return df.select(*columns).limit(limit)


#: Questions that the console offers, over the panel views of the catalog.
PRESETS = {
    "largest_by_volume": "SELECT ticker, year, n_frames, activities__n_activities AS n_activities, round(w, 4) AS index, round(pct_substance, 4) AS pct_substance FROM {firm_year} WHERE year = {year} ORDER BY n_frames DESC, ticker LIMIT 15",
    "index_by_year": "SELECT year, count(DISTINCT ticker) AS total_firms, round(avg(w), 4) AS avg_index, round(avg(pct_substance), 4) AS avg_pct_substance, round(avg(n_frames), 2) AS avg_n_frames FROM {firm_year} GROUP BY year ORDER BY year",
    "archetypes": "SELECT archetype, count(*) AS firm_count, round(avg(archetype_stability), 3) AS avg_stability, round(avg(n_frames), 1) AS avg_frames, round(avg(promotional_posture), 3) AS avg_promo, round(avg(risk_orientation), 3) AS avg_risk FROM {firm} WHERE archetype IS NOT NULL GROUP BY archetype ORDER BY firm_count DESC, archetype",
    "own_and_third_party": "SELECT year, round(sum(proprietary_ai), 0) AS total_proprietary, round(sum(third_party_named_provider), 0) AS total_third_party_named, round(avg(pct_substance), 3) AS avg_substance FROM {firm_year} GROUP BY year ORDER BY year",
    "largest_documents": "SELECT ticker, form, accession_number, fecha AS filing_date, n_frames, n_activities, proprietary_ai, named_product_or_process FROM {document} ORDER BY n_frames DESC, accession_number LIMIT 20",
    "provider_families": "SELECT provider_family, count(*) AS total_mentions, count(DISTINCT ticker) AS unique_firms FROM {activity} WHERE provider_family IS NOT NULL AND provider_family != '' GROUP BY provider_family ORDER BY total_mentions DESC, provider_family",
}


def preset(spark: SparkSession, name: str, views: Mapping[str, str], year: int = 2024) -> DataFrame:
    """A preset over views named for firm_year, firm, document and activity."""
    return spark.sql(PRESETS[name].format(year=int(year), **views))
