"""Queries for market windows, dated statements, frozen models, manifests and gated terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as NM
from ..functions.semantics import fold_lower, lexicon_pattern
from ..operators import financials as FS
from ..operators import market as M
from ..operators import posture as PO
from ..session import table
from ..sources.files import reconcile
from .panel_queries import _DAILY, daily
from .registry import query

_X = "x AS (SELECT u, d, rn, CASE WHEN ret IS NOT NULL AND mk IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND mk IS NOT NULL THEN mk END AS m, ret FROM s LEFT JOIN f USING (d))"


@query(f"""WITH {_DAILY}, {_X}, w AS (SELECT u, d, count(m) OVER z AS n, regr_sxx(y, m) OVER z AS sxx, regr_slope(y, m) OVER z AS b, regr_syy(y, m) OVER z - power(regr_sxy(y, m) OVER z, 2) / nullif(regr_sxx(y, m) OVER z, 0) AS rss FROM x WINDOW z AS (PARTITION BY u ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
 SELECT u, d, round(CASE WHEN n >= 6 AND sxx > 0 THEN b END, 3) AS beta, round(CASE WHEN n >= 6 AND sxx > 0 THEN sqrt(greatest(rss, 0) / (n - 2) / sxx) END, 3) AS se_beta, round(CASE WHEN n >= 6 AND sxx > 0 THEN sqrt(greatest(rss, 0) / (n - 2)) END, 3) AS idio_vol FROM w""")
def market_windows_moments(spark: SparkSession, d: str) -> DataFrame:
    s, f = daily(spark, d)
    m = M.frame_moments(s.join(f, "d", "left"), "u", "ret", "mk", -9, 1, 6)
    return m.select("u", "d", *[F.round(c, 3).alias(c) for c in ("beta", "se_beta", "idio_vol")])


@query(f"WITH {_DAILY}, w AS (SELECT u, d, count(ret) FILTER (ret > -1) OVER z AS n, sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER z AS l FROM s WINDOW z AS (PARTITION BY u ORDER BY rn ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING)) SELECT u, d, round(CASE WHEN n >= 4 THEN exp(l) - 1 END, 3) AS momentum FROM w")
def momentum(spark: SparkSession, d: str) -> DataFrame:
    return M.momentum(daily(spark, d)[0], "u", -8, -1, 4).select("u", "d", F.round("momentum", 3).alias("momentum"))


@query(f"""WITH {_DAILY}, {_X}, fit AS (SELECT u, rn, CASE WHEN count(m) OVER z >= 4 AND var_pop(m) OVER z > 0 THEN regr_slope(y, m) OVER z END AS b, CASE WHEN count(m) OVER z >= 4 AND var_pop(m) OVER z > 0 THEN regr_intercept(y, m) OVER z END AS a FROM x WINDOW z AS (PARTITION BY u ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
 e AS (SELECT o_orderkey, o_custkey AS u, (SELECT min(rn) FROM s WHERE s.u = o.o_custkey AND s.d >= CAST(o.o_orderdate AS DATE) + 9000) AS at FROM orders o),
 c AS (SELECT o_orderkey, count(x.y - a - b * x.m) AS n, sum(x.y - a - b * x.m) AS car FROM e LEFT JOIN fit ON fit.u = e.u AND fit.rn = e.at - 2 JOIN x ON x.u = e.u AND x.rn BETWEEN e.at - 1 AND e.at + 1 GROUP BY 1)
 SELECT o_orderkey, round(CASE WHEN n >= 2 THEN car END, 3) AS car FROM e LEFT JOIN c USING (o_orderkey)""")
def abnormal_returns(spark: SparkSession, d: str) -> DataFrame:
    s, f = daily(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.date_add(F.col("o_orderdate").cast("date"), 9000).alias("at"))
    e = M.event_rows(o, s, "u", "at", "d")
    x = s.join(f, "d", "left").select("u", "rn", "ret", F.col("mk"))
    return M.abnormal_returns(e, x, "u", "o_orderkey", "ret", "mk", -1, 2, 2, -2, (-7, 1), 4).select("o_orderkey", F.round("car", 3).alias("car"))


@query()
def win_leads_lags_regression(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of each user's weekly returns on the market's from two weeks before to two after."""
    s, f = daily(spark, d)
    week = F.date_trunc("week", "d").cast("date").alias("week")
    w = s.where("ret > -1").groupBy("u", week).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("r")).join(f.groupBy(week).agg((F.exp(F.sum(F.log1p("mk"))) - 1).alias("m")), "week")
    return M.expanded_residuals(w, "u", "week", "r", "m").select("u", "week", F.round("residual", 5).alias("residual"))


@query("""WITH st AS (SELECT o_orderkey AS id, o_custkey AS ticker, CAST(o_orderdate AS DATE) AS pe, o_orderstatus AS st, CASE WHEN o_orderkey % 4 = 0 THEN 'annual' ELSE 'quarterly' END AS period FROM orders), a AS (SELECT * FROM st WHERE period = 'quarterly' OR st <> 'P'),
 fl AS (SELECT o_custkey AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '10-Q' END AS form, o_orderkey AS acc, CAST(o_orderdate AS DATE) + 40 AS fd, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 13 - 6 AS INT) AS fe FROM orders WHERE o_orderkey % 2 = 0),
 re AS (SELECT o_custkey AS ticker, CASE WHEN o_orderkey % 4 = 0 THEN 'annual' ELSE 'quarterly' END AS period, CAST(o_orderdate AS DATE) + 5 AS re, CAST(o_orderdate AS DATE) + 20 AS rd FROM orders WHERE o_orderkey % 5 = 0),
 m AS (SELECT id, (SELECT min(abs(date_diff('day', pe, fe))) FROM fl WHERE fl.ticker = a.ticker AND (a.period = 'quarterly' OR form = '10-K')) AS g, (SELECT min(abs(date_diff('day', pe, re))) FROM re WHERE re.ticker = a.ticker AND re.period = a.period) AS h FROM a)
 SELECT period, CASE WHEN g <= 10 THEN 'edgar' WHEN h <= 10 THEN 'fs_release' END AS pit_source, count(*) AS n FROM a JOIN m USING (id) GROUP BY 1, 2""")
def fs_pit_financials(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("s"))
    st = o.select("ticker", F.col("day").alias("period_end"), F.when(F.col("s") == "P", "LTM").otherwise(F.col("s")).alias("period_status"), "o_orderkey")
    fl = o.where("o_orderkey % 2 = 0").select("ticker", F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("10-Q").alias("form"), F.col("o_orderkey").alias("accession_number"), F.date_add("day", 40).alias("filing_date"), F.date_add("day", (F.col("o_orderkey") % 13 - 6).cast("int")).alias("period_end_date"))
    re = o.where("o_orderkey % 5 = 0").select("ticker", F.when(F.col("o_orderkey") % 4 == 0, "annual").otherwise("quarterly").alias("period"), F.date_add("day", 5).alias("period_end"), F.date_add("day", 20).alias("eps_rpt_date"))
    x = FS.point_in_time(st.where("o_orderkey % 4 = 0"), st.where("o_orderkey % 4 <> 0"), fl, re)
    return x.groupBy("period", "pit_source").agg(F.count(F.lit(1)).alias("n"))


_CENTRES = [[0.0, 0.0], [1.0, -0.5], [-1.0, 1.0]]
_Z = "(c_acctbal - 4500) / 3000.0 AS a, (c_nationkey - 12) / 7.0 AS b"
_D = [f"power(a - {a}, 2) + power(b - {b}, 2)" for a, b in _CENTRES]


@query(f"WITH z AS (SELECT c_custkey, c_mktsegment <> 'BUILDING' AS active, {_Z} FROM customer), d AS (SELECT *, {_D[0]} AS d0, {_D[1]} AS d1, {_D[2]} AS d2 FROM z) SELECT c_custkey, CAST(CASE WHEN NOT active THEN -1 WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INT) AS cluster, CASE WHEN NOT active THEN 'none' WHEN d0 <= d1 AND d0 <= d2 THEN 'middle' WHEN d1 <= d2 THEN 'rich' ELSE 'far' END AS archetype FROM d")
def frozen_projection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    out = PO.frozen_projection(c, ["c_acctbal", "c_nationkey"], [4500.0, 12.0], [3000.0, 7.0], _CENTRES, {0: "middle", 1: "rich", 2: "far"}, F.col("c_mktsegment") != "BUILDING")
    return out.select("c_custkey", "cluster", "archetype")


@query("SELECT id, name, n_orders FROM (SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 100000000, s_name FROM supplier) m LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = m.id")
def union_sql(spark: SparkSession, d: str) -> DataFrame:
    """Two manifests in one and what is known of each, as a SQL statement over registered views."""
    for t in ("customer", "supplier", "orders"):
        table(spark, d, t).createOrReplaceTempView(f"manifest_{t}")
    return spark.sql(
        "SELECT id, name, n_orders FROM (SELECT c_custkey AS id, c_name AS name FROM manifest_customer UNION ALL SELECT s_suppkey + 100000000, s_name FROM manifest_supplier) m "
        "LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM manifest_orders GROUP BY o_custkey) o ON o.o_custkey = m.id"
    )


@query("WITH t AS (SELECT doc_id, lower(replace(replace(text, 'İ', 'i'), 'Σ', 'σ')) AS t FROM documents) SELECT doc_id, regexp_matches(t, '(?:^|[^a-z0-9])(?:that|que)(?:[^a-z0-9]|$)') AND regexp_matches(t, '(?:^|[^a-z0-9])(?:idiot|clown)(?:[^a-z0-9]|$)') AS kept FROM t")
def context_gated_term(spark: SparkSession, d: str) -> DataFrame:
    """A term counts only where a term of its context stands in the same text."""
    x = table(spark, d, "documents").select("doc_id", fold_lower(F.col("text")).alias("t"))
    return x.select("doc_id", (F.col("t").rlike(lexicon_pattern(["that", "que"])) & F.col("t").rlike(lexicon_pattern(["idiot", "clown"]))).alias("kept"))


@query("WITH o AS (SELECT md5(text) AS h, min(n_chars) AS v FROM documents WHERE lang = 'en' GROUP BY 1) SELECT 'carried' AS what, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM documents JOIN o ON md5(text) = h UNION ALL SELECT 'missing', count(*), NULL FROM documents WHERE text IS NULL OR md5(text) NOT IN (SELECT h FROM o WHERE h IS NOT NULL)")
def incremental_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of an earlier cut (here: of the English documents) under the keys of the present one."""
    units = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "n_chars", "lang")
    carried, missing = reconcile(units.where("lang = 'en'").select("doc_id", "h", F.col("n_chars").alias("v")), units, "h", ["doc_id"])
    a = carried.agg(F.lit("carried").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    return a.unionByName(missing.agg(F.lit("missing").alias("what"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("v")))


@query("SELECT s_suppkey, lower(replace(s_name, '#', ' ')) AS normal, true AS own FROM supplier")
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of names, and whether each is recognised under its own aliases."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return s.select("s_suppkey", NM.normal_name("s_name").alias("normal"), NM.is_host("s_name", NM.alias_forms("s_name")).alias("own"))
