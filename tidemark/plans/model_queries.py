"""Queries for linear models and for document volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intensity as N
from ..operators import models as M
from ..operators import text as T
from ..session import table
from .registry import query
from .text_queries import _LINES, paragraphs

_XY = "x AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_suppkey AS c FROM lineitem)"
_FIT = "f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, count(*) AS n FROM x)"


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_suppkey").alias("c"))


@query(f"WITH {_XY}, {_FIT}, s AS (SELECT c, sum((y - a - b * x) * (x - mx)) AS s FROM x, f GROUP BY c) SELECT round(b, 4) AS coef, round(r2, 6) AS r2, round(sqrt((SELECT sum(s * s) FROM s) / (sxx * sxx) * (SELECT count(*) / (count(*) - 1.0) FROM s) * (n - 1.0) / (n - 2.0)), 4) AS se FROM f")
def ols_cluster(spark: SparkSession, d: str) -> DataFrame:
    m = M.fit(_line(spark, d), "y", ["x"], "cluster", "c")
    return spark.createDataFrame([(round(float(m["coef"][1]), 4), round(m["r2"], 6), round(float(m["se"][1]), 4))], "coef double, r2 double, se double")


@query(f"WITH {_XY}, {_FIT}, s AS (SELECT sum(power((y - a - b * x) * (x - mx), 2)) AS m FROM x, f) SELECT round(b, 4) AS coef, round(sqrt(m / (sxx * sxx) * n / (n - 2.0)), 4) AS se_hc1 FROM f, s")
def ols_hc1(spark: SparkSession, d: str) -> DataFrame:
    m = M.fit(_line(spark, d), "y", ["x"], "hc1")
    return spark.createDataFrame([(round(float(m["coef"][1]), 4), round(float(m["se"][1]), 4))], "coef double, se_hc1 double")


@query(f"WITH {_XY}, w AS (SELECT c, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y FROM x WINDOW g AS (PARTITION BY c)), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) AS syy, count(*) AS n, count(DISTINCT c) AS k FROM w), r AS (SELECT sum(power(y - b * x, 2)) AS rss FROM w, b) SELECT round(b, 4) AS coef, round(sqrt(rss / (n - 1 - k) / sxx), 4) AS se, round(1 - rss / syy, 6) AS r2, round(1 - rss / syy * (n - 1.0) / (n - 1 - k), 6) AS adj_r2 FROM b, r")
def ols_fe_categorical(spark: SparkSession, d: str) -> DataFrame:
    m = M.fit(_line(spark, d), "y", ["x"], group="c")
    return spark.createDataFrame([(round(float(m["coef"][0]), 4), round(float(m["se"][0]), 4), round(m["r2"], 6), round(m["adj_r2"], 6))], "coef double, se double, r2 double, adj_r2 double")


@query("""WITH x AS (SELECT o_custkey AS c, year(o_orderdate) * 4 + quarter(o_orderdate) AS g, ln(o_totalprice) AS y, CAST(c_acctbal AS DOUBLE) AS u, CAST(c_nationkey AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
 k AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY g) > 1), w AS (SELECT y - avg(y) OVER q AS y, u - avg(u) OVER q AS u, v - avg(v) OVER q AS v FROM k WINDOW q AS (PARTITION BY g)),
 r AS (SELECT count(*) AS n, sum(u * y) / sqrt(sum(u * u) * sum(y * y)) AS a, sum(v * y) / sqrt(sum(v * v) * sum(y * y)) AS b, sum(u * v) / sqrt(sum(u * u) * sum(v * v)) AS c FROM w)
 SELECT 'first' AS block, n, round(a * a, 8) AS r2, round(a * a, 8) AS delta_r2 FROM r UNION ALL SELECT 'second', n, round((a * a + b * b - 2 * a * b * c) / (1 - c * c), 8), round((a * a + b * b - 2 * a * b * c) / (1 - c * c) - a * a, 8) FROM r""")
def nested_r2(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = o.select(F.col("o_custkey").alias("c"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("g"), F.log("o_totalprice").alias("y"), F.col("c_acctbal").cast("double").alias("u"), F.col("c_nationkey").cast("double").alias("v"))
    rows = M.nested(x, "y", [("first", ["u"]), ("second", ["v"])], "g", "c")
    return spark.createDataFrame([(r["block"], r["n"], round(r["r2"], 8), round(r["delta_r2"], 8)) for r in rows], "block string, n long, r2 double, delta_r2 double")


@query("""WITH p AS (SELECT c_nationkey % 5 AS u, CAST(year(o_orderdate) AS INT) AS t, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), z AS (SELECT *, u < 2 AS e, t >= (SELECT min(t) + 3 FROM p) AS post FROM p)
 SELECT round(avg(y) FILTER (e AND post) - avg(y) FILTER (e AND NOT post) - avg(y) FILTER (NOT e AND post) + avg(y) FILTER (NOT e AND NOT post), 3) AS effect, count(*) AS n FROM z""")
def difference_in_differences(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = o.groupBy((F.col("c_nationkey") % 5).alias("u"), F.year("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("y"))
    first = p.agg(F.min("t")).first()[0]
    m = M.difference_in_differences(p.withColumn("e", F.col("u") < 2).withColumn("post", F.col("t") >= first + 3), "y", "e", "post", "u", "t")
    return spark.createDataFrame([(round(m["effect"], 3), m["n"])], "effect double, n long")


@query("SELECT round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 8) AS first, round((1 - abs(corr(l_quantity, l_extendedprice))) / 2, 8) AS second, round(sqrt(0.5), 8) AS loading FROM lineitem")
def pca_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    share, loadings = M.principal(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(round(float(share[0]), 8), round(float(share[1]), 8), round(float(abs(loadings[0, 0])), 8))], "first double, second double, loading double")


@query("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT l_returnflag, round(avg(l_extendedprice - a - b * l_quantity), 4) AS excess FROM lineitem, f GROUP BY 1")
def residual_excess(spark: SparkSession, d: str) -> DataFrame:
    return M.residual(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "r").groupBy("l_returnflag").agg(F.round(F.avg("r"), 4).alias("excess"))


@query("""WITH x AS (SELECT o_custkey AS g, o_orderkey AS o, o_totalprice AS a, CAST(epoch(o_orderdate) AS DOUBLE) / 86400 AS b FROM orders), w AS (SELECT a, b, a - avg(a) OVER (PARTITION BY g) AS a1, b - avg(b) OVER (PARTITION BY g) AS b1, a - lag(a) OVER (PARTITION BY g ORDER BY o) AS a2, b - lag(b) OVER (PARTITION BY g ORDER BY o) AS b2 FROM x)
 SELECT 'pooled' AS kind, round(corr(a, b), 8) AS r, count(*) AS n FROM w UNION ALL SELECT 'within', round(corr(a1, b1), 8), count(*) FROM w UNION ALL SELECT 'difference', round(corr(a2, b2), 8), count(a2) FROM w""")
def agg_corr_forms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("a"), (F.unix_timestamp("o_orderdate") / 86400.0).alias("b"))
    return spark.createDataFrame([(k, round(v["r"], 8), v["n"]) for k, v in M.correlations(o, "a", "b", "g", "o").items()], "kind string, r double, n long")


@query("SELECT s AS sample, round(regr_slope(y, x), 4) AS coef, count(*) AS n FROM (SELECT l_quantity AS x, l_extendedprice AS y, unnest(CASE l_returnflag WHEN 'A' THEN ['all', 'without N', 'without R'] WHEN 'N' THEN ['all', 'without A', 'without R'] WHEN 'R' THEN ['all', 'without A', 'without N'] ELSE ['all', 'without A', 'without N', 'without R'] END) AS s FROM lineitem) GROUP BY 1")
def robustness_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = M.robustness(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], {"all": F.lit(True)}, "l_returnflag", errors="hc1")
    return spark.createDataFrame([(r["sample"], round(r["coef"], 4), r["n"]) for r in rows if r["term"] == "l_quantity"], "sample string, coef double, n long")


def _monthly(spark: SparkSession, d: str) -> list[tuple[int, float, float]]:
    """One row a month: ordinal, mean value and number of orders; a short series by nature."""
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    g = table(spark, d, "orders").groupBy(m.alias("m")).agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    return [(r.m, r.v, r.n) for r in g.orderBy("m").collect()]


@query()
def its_hac(spark: SparkSession, d: str) -> DataFrame:
    """Break sweep over the middle of the monthly series: pre-trend, step and change of slope with Newey-West errors."""
    series = _monthly(spark, d)
    first, last = series[0][0], series[-1][0]
    rows = M.break_sweep(series, range(first + 24, last - 23, 6))
    names = ["event", "n", "pre_trend", "se_pre_trend", "step", "se_step", "slope_change", "se_slope_change", "r2"]
    kinds = "event int, n int, " + ", ".join(f"{c} double" for c in names[2:]) + ", best_fit boolean"
    return spark.createDataFrame([(*[r[c] if isinstance(r[c], int) else round(r[c], 6) for c in names], r["best_fit"]) for r in rows], kinds)


_DOCS = _LINES + """, v AS (SELECT doc_id, count(*) AS n_paragraphs, sum(len(regexp_extract_all(trim(paragraph_text), '[\\t\\n\\f\\r ]+')) + 1) AS n_words FROM p WHERE length(trim(paragraph_text)) > 3 AND regexp_matches(paragraph_text, '[A-Za-z0-9]') GROUP BY 1),
 fr AS (SELECT doc_id, count(*) AS n_frames, sum(coalesce(toxic, 0)) AS n_tox, sum(coalesce(quality, 0)) AS n_good FROM labels GROUP BY 1),
 t AS (SELECT d.doc_id, d.lang, d.source, n_paragraphs, n_words, coalesce(n_frames, 0) AS n_frames, coalesce(n_tox, 0) AS n_tox, coalesce(n_good, 0) AS n_good FROM documents d JOIN v USING (doc_id) LEFT JOIN fr USING (doc_id))
"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return N.document_table(docs, paragraphs(spark, d), table(spark, d, "labels"), "doc_id", {"n_tox": F.col("toxic"), "n_good": F.col("quality")})


@query(_DOCS + "SELECT doc_id, n_paragraphs, CAST(n_words AS BIGINT) AS n_words, n_frames, CAST(n_tox AS DOUBLE) AS n_tox, CAST(n_good AS DOUBLE) AS n_good FROM t")
def document_table(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", "n_paragraphs", "n_words", "n_frames", "n_tox", "n_good")


@query(_DOCS + "SELECT lang, source, count(*) AS n_docs, CAST(sum(n_words) AS BIGINT) AS n_words, round(1000.0 * sum(n_frames) / sum(n_words), 8) AS frames_per_1k, round(1000.0 * sum(n_tox) / sum(n_words), 8) AS tox_per_1k, CAST(sum(n_frames) > 0 AS DOUBLE) AS any_frames, round(CASE WHEN sum(n_frames) > 0 THEN 1.0 * sum(n_tox) / sum(n_frames) END, 8) AS tox_rate FROM t GROUP BY 1, 2")
def aggregate_intensity(spark: SparkSession, d: str) -> DataFrame:
    g = N.aggregate(_documents(spark, d), "doc_id", ["lang", "source"], ["n_tox", "n_good"], ["n_tox"])
    return g.select("lang", "source", "n_docs", "n_words", *[F.round(c, 8).alias(c) for c in ("frames_per_1k", "tox_per_1k")], "any_frames", F.round("tox_rate", 8).alias("tox_rate"))


@query(_LINES + """, q AS (SELECT doc_id, x, lower(x) AS lx FROM (SELECT doc_id, unnest(regexp_extract_all(paragraph_text, '[^.!?]+[.!?]*')) AS x FROM p WHERE content_type = 'prose'))
 SELECT doc_id, count(*) AS n, max(length(x)) AS most, min(length(x)) AS least, round(avg(length(x)), 6) AS mean FROM q WHERE length(x) > 15 AND regexp_matches(lx, '(^|[^a-z0-9])(the|und)([^a-z0-9]|$)') GROUP BY 1""")
def sentence_score_agg(spark: SparkSession, d: str) -> DataFrame:
    """Count, largest, smallest and mean score over the sentences that hold a term; the score here is their length."""
    s = paragraphs(spark, d).where("content_type = 'prose'").select("doc_id", F.explode(F.regexp_extract_all("paragraph_text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("x"))
    return T.term_sentences(s, ["doc_id"], "x", ["the", "und"], F.length("x")).withColumn("mean", F.round("mean", 6))
