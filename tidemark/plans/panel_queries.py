"""Queries for panels, event windows, financial series and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import quarter_ordinal
from ..operators import market as M
from ..operators import panels as P
from ..operators import stats as ST
from ..session import table
from .registry import query
from .relational import _GRID, quarterly

_DAILY = "day AS (SELECT user_id AS u, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY 1, 2), f AS (SELECT d, avg(v) / 100 AS mk FROM day WHERE v IS NOT NULL GROUP BY 1), s0 AS (SELECT u, d, v, row_number() OVER (PARTITION BY u ORDER BY d) AS rn, lag(v) OVER (PARTITION BY u ORDER BY d) AS pv FROM day WHERE v IS NOT NULL), s AS (SELECT u, d, v, rn, CASE WHEN pv <> 0 THEN v / pv - 1 END AS ret FROM s0)"


def daily(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))
    return M.series(e, "u", "d", "v"), e.where("v IS NOT NULL").groupBy("d").agg((F.avg("v") / 100).alias("mk"))


@query(f"WITH {_DAILY} SELECT u, d, CAST(rn AS INT) AS rn, round(ret, 6) AS ret FROM s")
def win_pct_change(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d)[0].select("u", "d", "rn", F.round("ret", 6).alias("ret"))


@query(f"WITH {_DAILY}, o AS (SELECT o_orderkey, o_custkey AS u, CAST(o_orderdate AS DATE) + 9000 AS at FROM orders), i AS (SELECT o.*, (SELECT min(rn) FROM s WHERE s.u = o.u AND s.d >= o.at) AS rn FROM o) SELECT i.o_orderkey, CAST(i.rn AS INT) AS event_rn, round(b.v, 4) AS before, round(a.v, 4) AS after FROM i LEFT JOIN s b ON b.u = i.u AND b.rn = i.rn - 1 LEFT JOIN s a ON a.u = i.u AND a.rn = i.rn + 2")
def win_event_offset(spark: SparkSession, d: str) -> DataFrame:
    s, _ = daily(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.date_add(F.col("o_orderdate").cast("date"), 9000).alias("at"))
    e = M.event_rows(o, s, "u", "at", "d")
    e = M.offset_value(M.offset_value(e, s, "u", -1, "v", "before"), s, "u", 2, "v", "after")
    return e.select("o_orderkey", "event_rn", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query(f"WITH {_DAILY}, x AS (SELECT u, d, ret, mk, rn FROM s LEFT JOIN f USING (d)), w AS (SELECT u, d, count(CASE WHEN ret IS NOT NULL THEN mk END) OVER z AS n, var_pop(CASE WHEN ret IS NOT NULL THEN mk END) OVER z AS vx, regr_slope(ret, mk) OVER z AS b FROM x WINDOW z AS (PARTITION BY u ORDER BY rn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) SELECT u, d, n, round(CASE WHEN n >= 4 AND vx > 0 THEN b END, 4) AS beta FROM w")
def market_windows_beta(spark: SparkSession, d: str) -> DataFrame:
    s, f = daily(spark, d)
    return M.frame_beta(s.join(f, "d", "left"), "u", "ret", "mk", -5, 1, 4).select("u", "d", "n", F.round("beta", 4).alias("beta"))


@query(f"WITH {_DAILY}, x AS (SELECT u % 20 AS g, ln(1 + v) AS r FROM s WHERE v > -1), c AS (SELECT g, r - avg(r) OVER (PARTITION BY g) AS e FROM x), a AS (SELECT g, count(*) AS n, sum(e * e) AS s2, sum(e * e * e) AS s3, count(*) FILTER (e >= 0) AS nu, sum(e * e) FILTER (e >= 0) AS su, count(*) FILTER (e < 0) AS nd, sum(e * e) FILTER (e < 0) AS sd FROM c GROUP BY 1) SELECT g, n, round(-(n * pow(n - 1.0, 1.5) * s3) / ((n - 1.0) * (n - 2.0) * pow(s2, 1.5)), 4) AS ncskew, round(ln(((nu - 1) * sd) / ((nd - 1) * su)), 4) AS duvol FROM a")
def crash_measures(spark: SparkSession, d: str) -> DataFrame:
    s, _ = daily(spark, d)
    x = s.where("v > -1").select((F.col("u") % 20).alias("g"), F.log1p("v").alias("r"))
    c = x.withColumn("e", F.col("r") - F.avg("r").over(Window.partitionBy("g")))
    # deviations are measured from the group's mean, which is zero up to rounding
    return M.crash_measures(c.withColumn("e", F.round("e", 12)), ["g"], "e", 5).select("g", "n", F.round("ncskew", 4).alias("ncskew"), F.round("duvol", 4).alias("duvol"))


@query(f"WITH {_DAILY} SELECT u, CAST(date_trunc('week', d) AS DATE) AS week, round(exp(sum(ln(1 + ret))) - 1, 4) AS ret, round(sum(v), 4) AS v, count(ret) AS days FROM s WHERE ret > -1 GROUP BY 1, 2")
def win_week_panel(spark: SparkSession, d: str) -> DataFrame:
    return M.weeks(daily(spark, d)[0], "u", "d", "v").select("u", "week", F.round("ret", 4).alias("ret"), F.round("v", 4).alias("v"), "days")


@query(f"SELECT c_custkey, CAST(q AS INT) AS q, CAST(n AS BIGINT) AS n_quarter, CAST(sum(n) OVER w4 AS BIGINT) AS n_ttm, CAST(sum(n) OVER we AS BIGINT) AS n_expanding, round(sum(v) OVER w4, 2) AS v_ttm FROM ({_GRID}) WINDOW w4 AS (PARTITION BY c_custkey ORDER BY q ROWS 3 PRECEDING), we AS (PARTITION BY c_custkey ORDER BY q)")
def windowed_measures(spark: SparkSession, d: str) -> DataFrame:
    m = P.windowed_measures(quarterly(spark, d), "c_custkey", "q", ["n", "v"])
    return m.select("c_custkey", "q", "n_quarter", "n_ttm", "n_expanding", F.round("v_ttm", 2).alias("v_ttm"))


_PANEL = """p AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice) / 1000) AS volume, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderpriority < '3') AS b FROM orders GROUP BY 1, 2),
 m AS (SELECT *, avg(1.0 * a / n) OVER w AS ma, var_samp(1.0 * a / n) OVER w AS va, avg(1.0 * b / n) OVER w AS mb, var_samp(1.0 * b / n) OVER w AS vb FROM p WINDOW w AS (PARTITION BY y)),
 t AS (SELECT *, CASE WHEN ma > 0 AND ma < 1 AND va > 0 THEN greatest(ma * (1 - ma) / nullif(va, 0) - 1, 1e-6) ELSE 1.0 END AS sa, CASE WHEN mb > 0 AND mb < 1 AND vb > 0 THEN greatest(mb * (1 - mb) / nullif(vb, 0) - 1, 1e-6) ELSE 1.0 END AS sb FROM m),
 g AS (SELECT *, round(ln(1 + n) * ((a + ma * sa) / (n + sa) + (b + mb * sb) / (n + sb)) / 2, 9) AS substance FROM t),
 r AS (SELECT *, (rank() OVER (PARTITION BY y ORDER BY volume) + (count(*) OVER (PARTITION BY y, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY y) AS pv, (rank() OVER (PARTITION BY y ORDER BY substance) + (count(*) OVER (PARTITION BY y, substance) - 1) / 2.0) / count(*) OVER (PARTITION BY y) AS ps FROM g)"""


def yearly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(
        F.round(F.sum("o_totalprice") / 1000).alias("volume"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderpriority") < "3").alias("b"))


@query(f"WITH {_PANEL} SELECT k, y, round(substance, 6) AS substance, round(pv, 6) AS pct_volume FROM r")
def gap_index(spark: SparkSession, d: str) -> DataFrame:
    g = P.gap_index(yearly(spark, d), "y", "volume", "n", [("a", "n"), ("b", "n")])
    return g.select("k", "y", F.round(F.round("substance", 9), 6).alias("substance"), F.round("pct_volume", 6).alias("pct_volume"))


@query(f"""WITH {_PANEL}, s AS (SELECT k, y, volume, b, n, ((a + ma * sa) / (n + sa) + (b + mb * sb) / (n + sb)) / 2 AS gr, (k + y) % 3 <> 0 AS rep FROM t),
 f AS (SELECT k, y, volume, b, last_value(CASE WHEN rep THEN n END IGNORE NULLS) OVER z AS nn, last_value(CASE WHEN rep THEN gr END IGNORE NULLS) OVER z AS gg FROM s WINDOW z AS (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT k, y, round((rank() OVER (PARTITION BY y ORDER BY volume) + (count(*) OVER (PARTITION BY y, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY y), 6) AS pct_volume, round(ln(1 + nn) * gg, 6) AS substance, CAST(nn AS DOUBLE) AS n FROM f WHERE nn IS NOT NULL AND b > 0""")
def washing_index(spark: SparkSession, d: str) -> DataFrame:
    p = yearly(spark, d)
    x = P.disclosure_index(p.select("k", "y", "volume", F.col("b").alias("any")), p.select("k", "y", "n", "a", "b"), p.where("(k + y) % 3 <> 0"), "k", "y", "volume", "any", "n", ["a", "b"])
    return x.select("k", "y", *[F.round(c, 6).alias(c) for c in ("pct_volume", "substance")], "n")


@query("WITH p AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1, 2) SELECT y, round(avg(1.0 * f / n), 6) AS rate_f, round(avg(1.0 * u / n), 6) AS rate_u, round(sum(f) / sum(n), 6) AS pooled_f FROM p GROUP BY 1")
def posture_rates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return p.groupBy("y").agg(F.round(F.avg(F.col("f") / F.col("n")), 6).alias("rate_f"), F.round(F.avg(F.col("u") / F.col("n")), 6).alias("rate_u"), F.round(F.sum("f") / F.sum("n"), 6).alias("pooled_f"))


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS id, o_custkey % 25 AS nation FROM orders), s AS (SELECT c_custkey AS id, c_nationkey AS nation FROM customer), g AS (SELECT id, count(*) AS n, min(nation) AS nation FROM o GROUP BY 1)
 SELECT 'buyers' AS table_name, (SELECT count(*) FROM s LEFT JOIN g USING (id) WHERE g.id IS NULL) AS missing, (SELECT count(*) FROM g LEFT JOIN s USING (id) WHERE s.id IS NULL) AS outside, (SELECT count(*) FROM g WHERE n > 1) AS duplicates, (SELECT count(*) FROM g JOIN s USING (id) WHERE g.nation IS DISTINCT FROM s.nation) AS mismatched""")
def spine_alignment_check(spark: SparkSession, d: str) -> DataFrame:
    spine = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    buyers = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey")).alias("id"), (F.col("o_custkey") % 25).cast("int").alias("nation"))
    return P.alignment(spine, {"buyers": buyers}, "id", ["nation"])


@query("SELECT c_custkey AS id, c_nationkey AS nation, n, last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_families(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    return P.join_families(c, {"orders": a, "same": c}, "id")


@query("SELECT k, q, v FROM (SELECT o_custkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS q, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_first_disclosed(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), quarter_ordinal(F.col("o_orderdate")).alias("q"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    return P.first_disclosed(o, ["k", "q"], "o_orderdate", ["o_orderkey"]).select("k", "q", "v")


@query("WITH x AS (SELECT o_custkey AS k, o_orderpriority AS c, min(o_totalprice) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1, 2) SELECT k, arg_min(v, c) AS v, min(c) AS concept_used FROM x GROUP BY 1")
def concept_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("v"))
    return P.concept_fallback(o, ["k"], "c", "v", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("SELECT s_suppkey, round(s_acctbal * 0.79 / nullif(greatest(s_nationkey * 1000.0, 0), 0), 6) AS roic, round(CASE WHEN s_nationkey > 0 THEN CAST(0.6 * 0.09 + 0.4 * 0.05 * 0.79 AS DOUBLE) END, 6) AS wacc FROM supplier")
def value_creation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit(0.21).alias("t"), (F.col("s_nationkey") * 600.0).alias("e"), (F.col("s_nationkey") * 400.0).alias("d"), F.lit(0.09).alias("ke"), F.lit(0.05).alias("kd"))
    return P.value_creation(s, "s_acctbal", "t", "e", "d", "ke", "kd").select("s_suppkey", F.round("roic", 6).alias("roic"), F.round("wacc", 6).alias("wacc"))


@query("SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS coef, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'const', round(regr_intercept(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem")
def ols_gram(spark: SparkSession, d: str) -> DataFrame:
    rows = ST.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], cluster="l_suppkey")
    return spark.createDataFrame([(r["term"], round(r["coef"], 4), round(r["r2"], 6)) for r in rows], "term string, coef double, r2 double")


@query("WITH p AS (SELECT p_brand AS b, p_size % 10 AS t, count(*) / 1000.0 AS p FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p, b) AS k, count(*) OVER (PARTITION BY t) AS n FROM p) SELECT b, CAST(t AS INT) AS t, round(least(1.0, min(p * n / k) OVER (PARTITION BY t ORDER BY k DESC)), 8) AS q_value FROM r")
def benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("b"), (F.col("p_size") % 10).alias("t")).agg((F.count(F.lit(1)) / 1000.0).alias("p"))
    return ST.benjamini_hochberg(p, "p", ["t"]).select("b", "t", F.round("q_value", 8).alias("q_value"))


@query("WITH x AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, CASE WHEN sum(o_totalprice) > 300000 THEN 'high' ELSE 'low' END AS s FROM orders GROUP BY 1, 2) SELECT a.s AS before, b.s AS after, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY a.s), 4) AS pct FROM x a JOIN x b ON a.k = b.k AND b.y = a.y + 1 GROUP BY 1, 2")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.when(F.sum("o_totalprice") > 300000, "high").otherwise("low").alias("s"))
    after = x.select("k", (F.col("y") - 1).alias("y"), F.col("s").alias("after"))
    g = x.withColumnRenamed("s", "before").join(after, ["k", "y"]).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("before")), 4))


@query("WITH x AS (SELECT c_nationkey AS g, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey) SELECT g, round(avg((v > 150000)::INT) - (SELECT avg((v > 150000)::INT) FROM x), 6) AS deviation, round(median(v) / (SELECT median(v) FROM x), 6) AS median_ratio FROM x GROUP BY 1")
def rate_deviation_from_pooled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), F.col("o_totalprice").alias("v"))
    rate, med = F.avg((F.col("v") > 150000).cast("int")), F.percentile("v", F.lit(0.5))
    p = x.agg(rate.alias("rate"), med.alias("med")).first()
    return x.groupBy("g").agg(F.round(rate - F.lit(p.rate), 6).alias("deviation"), F.round(med / F.lit(p.med), 6).alias("median_ratio"))


@query("SELECT count(*) AS n, round(1.0 * count(c_acctbal) / count(*), 6) AS coverage, round(1.0 * count(nullif(c_mktsegment, 'BUILDING')) / count(*), 6) AS segment_coverage FROM customer")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    share = lambda x: F.round(F.count(x) / F.count(F.lit(1)), 6)
    return c.agg(F.count(F.lit(1)).alias("n"), share(F.col("c_acctbal")).alias("coverage"), share(F.when(F.col("c_mktsegment") != "BUILDING", 1)).alias("segment_coverage"))


@query(f"""WITH {_PANEL}, w AS (SELECT k, y, pv, ps, avg(pv - ps) OVER (PARTITION BY k ORDER BY y) AS w_exp, pv - ps AS w FROM r), middle AS (SELECT y, median(w) AS med, median(pv) AS mv, median(ps) AS ms FROM w GROUP BY 1),
 a AS (SELECT w.*, mv, ms, w >= med AS above FROM w JOIN middle USING (y)), b AS (SELECT *, above AND coalesce(lag(above) OVER (PARTITION BY k ORDER BY y), false) AS twice FROM a)
 SELECT k, y, round(w_exp, 6) AS expanding, bool_or(twice) OVER (PARTITION BY k) AS persistent, CASE WHEN pv >= mv AND ps >= ms THEN 'VALIDATE' WHEN pv >= mv THEN 'INVESTIGATE' WHEN ps >= ms THEN 'EXPLORE' ELSE 'DEPRIORITIZE' END AS quadrant FROM b""")
def persistence_quadrant_screen(spark: SparkSession, d: str) -> DataFrame:
    g = P.gap_index(yearly(spark, d), "y", "volume", "n", [("a", "n"), ("b", "n")])
    return P.quadrant_screen(g, "k", "y").withColumn("expanding", F.round("expanding", 6))


@query()
def archetypal_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Weights of each nation on three extreme order profiles (a matrix of one row per nation)."""
    import numpy as np

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = o.groupBy("c_nationkey").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f"), F.avg((F.col("o_orderpriority") < "3").cast("int")).alias("u"), (F.avg("o_totalprice") / 1e6).alias("v")).orderBy("c_nationkey").collect()
    _, a = ST.archetypes(np.array([[r.f, r.u, r.v] for r in x]), 3)
    return spark.createDataFrame([(r.c_nationkey, *[round(float(w), 4) for w in row]) for r, row in zip(x, a, strict=True)], "nation int, a1 double, a2 double, a3 double")


@query()
def bootstrap_cluster(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", "c_acctbal")
    return ST.bootstrap_clusters(c, "c_nationkey", 5, "b1").groupBy("replicate").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
