"""Queries for scans, projections, joins, aggregates, windows, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions.hashing import seeded
from ..operators import joins as J
from ..operators import ranks as R
from ..operators import windows as W
from ..session import table
from ..sources.catalog import with_table_row
from .registry import query

def _day() -> Column:
    return F.col("o_orderdate").cast("date")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def scan_parts_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    return a.unionByName(table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance"), allowMissingColumns=True)


@query("SELECT doc_id, 'documents.parquet' AS source_file, CAST(row_number() OVER () - 1 AS BIGINT) AS source_row FROM documents")
def scan_with_row_index(spark: SparkSession, d: str) -> DataFrame:
    return with_table_row(spark, f"{d}/documents.parquet").select("doc_id", F.lit("documents.parquet").alias("source_file"), "source_row")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT c_custkey AS id, 'us' AS country_code, upper(c_mktsegment) AS segment FROM customer")
def project_literal_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("us").alias("country_code"), F.upper("c_mktsegment").alias("segment"))


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND NOT (event_type = 'view' AND value < 10)")
def filter_bool_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("value").isNotNull() & ~((F.col("event_type") == "view") & (F.col("value") < 10))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_returnflag, 'N') IS DISTINCT FROM NULLIF(l_linestatus, 'O')")
def filter_ne_missing(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c, v: F.when(F.col(c) != v, F.col(c))
    return table(spark, d, "lineitem").where(S.ne_missing(blank("l_returnflag", "N"), blank("l_linestatus", "O"))).select("l_orderkey", "l_linenumber")


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY 1")
def case_when(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").groupBy(size.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


_SIC = "TRY_CAST(p_partkey * 7 % 10000 AS INTEGER)"
_SIC2 = "TRY_CAST(substr(lpad(CAST(p_partkey * 7 % 10000 AS VARCHAR), 4, '0'), 1, 2) AS INTEGER)"


def _sector_sql() -> str:
    """The two tiers from the tables of bounds and groups that the expressions use."""
    first = " ".join(f"WHEN {_SIC} < {high} THEN '{name}'" for high, name in S.DIVISIONS)
    second = " ".join(f"WHEN {' OR '.join(f'{_SIC2} BETWEEN {a} AND {b}' for a, b in spans)} THEN '{name}'" for name, spans in S.SECTORS)
    return f"SELECT CASE {first} ELSE '{S.OTHER_SECTOR}' END AS division, CASE {second} ELSE '{S.OTHER_SECTOR}' END AS sector, count(*) AS n FROM part GROUP BY 1, 2"


@query(_sector_sql())
def case_sector(spark: SparkSession, d: str) -> DataFrame:
    sic = F.col("p_partkey") * 7 % 10000
    return table(spark, d, "part").groupBy(S.sic_division(sic).alias("division"), S.sic_sector(sic).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


RULES = [("credit|fraud|risk", "Control"), ("green|blue", "Sell"), ("steel|iron|copper", "Build"), ("^[a-m]", "Serve")]


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(p_name), 'credit|fraud|risk') THEN 'Control' WHEN regexp_matches(lower(p_name), 'green|blue') THEN 'Sell' WHEN regexp_matches(lower(p_name), 'steel|iron|copper') THEN 'Build' WHEN regexp_matches(lower(p_name), '^[a-m]') THEN 'Serve' ELSE 'other' END AS label FROM part) GROUP BY 1")
def case_purpose_action(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(S.first_match(F.lower("p_name"), RULES, "other").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN value > 50 THEN -value END, 0.0) AS amount FROM events")
def coalesce_priority(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_type") == "purchase", v), F.when(v > 50, -v), F.lit(0.0)).alias("amount"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.lookup(F.col("o_orderstatus"), {"F": "filled", "O": "open"}).alias("status"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag FROM lineitem WHERE l_quantity > 45")
def null_marker_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", S.null_markers(F.col("l_returnflag"), ["", "N"]).alias("flag"))


@query("SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 4) AS clipped FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)")
def clip_winsorize(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    bounds = o.agg(F.percentile("o_totalprice", F.lit(0.01)).alias("lo"), F.percentile("o_totalprice", F.lit(0.99)).alias("hi")).first()
    return o.select("o_orderkey", F.round(S.clip(F.col("o_totalprice"), F.lit(bounds.lo), F.lit(bounds.hi)), 4).alias("clipped"))


@query("SELECT s_suppkey, round(s_acctbal * 1000000, 2) AS units, round(CASE WHEN s_nationkey > 10 THEN s_acctbal / s_nationkey END, 6) AS per_nation, round(-s_acctbal, 2) AS outflow FROM supplier")
def unit_scale_safe_div(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(b * 1000000, 2).alias("units"), F.round(F.when(F.col("s_nationkey") > 10, S.safe_div(b, F.col("s_nationkey"))), 6).alias("per_nation"), F.round(-b, 2).alias("outflow"))


# joins
@query("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_left_one(spark: SparkSession, d: str) -> DataFrame:
    right = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.left_one(table(spark, d, "orders"), right, ["o_custkey"]).select("o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def join_full_coalesce(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, ["nationkey"], "full")


@query("SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k GROUP BY 1")
def join_outer_indicator(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    return J.indicator(a, b, ["k"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def _types(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"))


_ASOF = "WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS vt, event_id AS view_id FROM events WHERE event_type = 'view') "


@query(_ASOF + "SELECT e.event_id, (SELECT view_id FROM v WHERE v.user_id = e.user_id AND v.vt <= e.ts ORDER BY vt DESC, view_id DESC LIMIT 1) AS view_id FROM e")
def join_asof_backward(spark: SparkSession, d: str) -> DataFrame:
    e, v = _types(spark, d)
    return J.asof(e, v, ["user_id"], "ts", "at", ["view_id"], tie=["view_id"]).select("event_id", "view_id")


@query(_ASOF + "SELECT e.event_id, (SELECT view_id FROM v WHERE v.user_id = e.user_id AND v.vt > e.ts ORDER BY vt, view_id LIMIT 1) AS view_id FROM e")
def join_asof_forward_strict(spark: SparkSession, d: str) -> DataFrame:
    e, v = _types(spark, d)
    return J.asof(e, v, ["user_id"], "ts", "at", ["view_id"], direction="forward", strict=True, tie=["view_id"]).select("event_id", "view_id")


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, CAST(ts AS DATE) AS vt, max(event_id) AS hi, min(event_id) AS lo FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 c AS (SELECT e.event_id, date_diff('day', vt, day) AS gap, hi, lo FROM e JOIN v ON e.user_id = v.user_id), p AS (SELECT event_id, arg_min(CASE WHEN gap >= 0 THEN hi ELSE lo END, abs(gap) * 2 + (gap < 0)::INT) AS view_id, min(abs(gap)) AS g FROM c GROUP BY 1)
 SELECT e.event_id, CASE WHEN g <= 3 THEN view_id END AS view_id, CASE WHEN g <= 3 THEN CAST(g AS INT) END AS gap_days FROM e LEFT JOIN p ON e.event_id = p.event_id""")
def join_asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e, v = _types(spark, d)
    e, v = e.withColumn("day", F.col("ts").cast("date")), v.withColumn("at", F.col("at").cast("date"))
    return J.asof_nearest(e, v, ["user_id"], "day", "at", ["view_id"], days=3, tie=["view_id"]).select("event_id", "view_id", "gap_days")


@query("""WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS y, max(CAST(o_orderdate AS DATE)) AS pe, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
 p AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY y) AS prior_v, lead(v) OVER (PARTITION BY k ORDER BY y) AS next_v FROM a),
 f AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) + 30 AS cutoff FROM orders WHERE o_orderpriority = '1-URGENT')
 SELECT f.o_orderkey, m.v, m.prior_v, m.next_v FROM f LEFT JOIN LATERAL (SELECT v, prior_v, next_v FROM p WHERE p.k = f.k AND p.pe <= f.cutoff ORDER BY pe DESC LIMIT 1) m ON true""")
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.max(_day()).alias("pe"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    w = Window.partitionBy("k").orderBy("y")
    a = a.withColumn("prior_v", F.lag("v").over(w)).withColumn("next_v", F.lead("v").over(w))
    f = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("k"), F.date_add(_day(), 30).alias("cutoff"))
    return J.asof(f, a, ["k"], "cutoff", "pe", ["v", "prior_v", "next_v"]).select("o_orderkey", "v", "prior_v", "next_v")


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT user_id, max(CAST(ts AS DATE)) - 9000 AS cutoff FROM events GROUP BY 1) ON o_custkey = user_id WHERE cutoff IS NULL OR CAST(o_orderdate AS DATE) <= cutoff")
def join_range_before_date(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.date_sub(F.max(F.col("ts").cast("date")), 9000).alias("cutoff"))
    return J.until(table(spark, d, "orders").withColumn("day", _day()), cut, ["o_custkey"], "day", "cutoff").select("o_orderkey")


@query("SELECT o_orderkey FROM orders a WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'O' AND date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) BETWEEN 0 AND 30)")
def join_window_exists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", _day().alias("day"))
    return J.within_days(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "day", "day", 30).select("o_orderkey")


LEXICON = {"the": r"(?:^|[^a-z0-9])the(?:[^a-z0-9]|$)", "und": r"(?:^|[^a-z0-9])und(?:[^a-z0-9]|$)", "idiot": r"(?:^|[^a-z0-9])idiot(?:[^a-z0-9]|$)"}


@query("""SELECT term, count(*) AS n FROM (SELECT DISTINCT lower(text) AS t FROM documents) JOIN (VALUES ('the', '(^|[^a-z0-9])the([^a-z0-9]|$)'), ('und', '(^|[^a-z0-9])und([^a-z0-9]|$)'), ('idiot', '(^|[^a-z0-9])idiot([^a-z0-9]|$)')) l(term, p) ON regexp_matches(t, p) GROUP BY 1""")
def join_regex_theta(spark: SparkSession, d: str) -> DataFrame:
    return J.regex_lexicon(table(spark, d, "documents").select(F.lower("text").alias("t")), "t", LEXICON).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_GRID = "SELECT c_custkey, q, coalesce(n, 0) AS n, round(coalesce(v, 0), 2) AS v FROM customer CROSS JOIN (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q FROM orders) LEFT JOIN (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS oq, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) ON o_custkey = c_custkey AND oq = q"


def quarterly(spark: SparkSession, d: str) -> DataFrame:
    """Customers by quarter with the number and value of orders, gaps filled."""
    o = table(spark, d, "orders").withColumn("q", S.quarter_ordinal(F.col("o_orderdate")))
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey"), "q").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    return J.grid(table(spark, d, "customer").select("c_custkey"), o.select("q").distinct(), sums, ["c_custkey", "q"], ["n", "v"])


@query(f"SELECT c_custkey, CAST(q AS INT) AS q, CAST(n AS BIGINT) AS n, v FROM ({_GRID})")
def join_cross_grid(spark: SparkSession, d: str) -> DataFrame:
    return quarterly(spark, d).withColumn("v", F.round("v", 2))


@query("SELECT a.doc_id, b.rep, b.n FROM documents a JOIN (SELECT md5(text) AS h, min(doc_id) AS rep, count(*) AS n FROM documents GROUP BY 1) b ON md5(a.text) = b.h")
def join_broadcast_by_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "h").select("doc_id", "rep", "n")


@query("SELECT l.doc_id, l.quality, e.vec_id, e.label FROM labels l JOIN documents x ON l.doc_id = x.doc_id JOIN (SELECT md5(text) AS h, min(doc_id) AS rep FROM documents GROUP BY 1) r ON md5(x.text) = r.h JOIN embeddings e ON e.vec_id = r.rep")
def join_two_hop_representative(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    reps = x.groupBy("h").agg(F.min("doc_id").alias("vec_id"))
    return table(spark, d, "labels").join(x, "doc_id").join(reps, "h").join(table(spark, d, "embeddings"), "vec_id").select("doc_id", "quality", "vec_id", "label")


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS buyers, (SELECT count(*) FROM customer) AS customers")
def join_concat_horizontal(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("buyers")).withColumn("one", F.lit(1))
    return a.join(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("customers")).withColumn("one", F.lit(1)), "one").drop("one")


@query("SELECT w AS word, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def join_unnest_equality(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.join(words.select("word").distinct(), "word").groupBy("word").agg(F.count_distinct("p_partkey").alias("n"))


_YEAR = "SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2"


@query(f"WITH a AS ({_YEAR}) SELECT a.k, a.y, a.v, b.v AS next_v FROM a LEFT JOIN a b ON a.k = b.k AND b.y = a.y + 1")
def join_self_year_shift(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return a.join(a.select("k", (F.col("y") - 1).alias("y"), F.col("v").alias("next_v")), ["k", "y"], "left")


@query("SELECT a.event_id, b.n FROM (SELECT event_id, CASE WHEN value > 50 THEN event_type END AS t FROM events) a JOIN (SELECT CASE WHEN value > 50 THEN event_type END AS t, count(*) AS n FROM events GROUP BY 1) b ON a.t IS NOT DISTINCT FROM b.t")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("t"))
    return J.null_safe(e, e.groupBy("t").agg(F.count(F.lit(1)).alias("n")), ["t"]).select("event_id", "n")


# aggregates
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS lo, max(l_tax) AS hi, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice END), 2) AS discounted, bool_or(l_quantity > 49) AS any_big, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY 1, 2")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("discounted"),
        F.bool_or(F.col("l_quantity") > 49).alias("any_big"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@query("SELECT o_custkey, min(o_orderkey) AS first_key, arg_min(o_totalprice, o_orderkey) AS first_price, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states FROM orders GROUP BY 1")
def agg_first_by_order(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("first_key"), F.min_by("o_totalprice", "o_orderkey").alias("first_price"), F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(pairs, lambda x: x["o_orderpriority"]), ",").alias("priorities"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"),
    )


@query("SELECT k, m AS month FROM (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY n DESC, m) AS r FROM (SELECT o_custkey AS k, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def agg_mode(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("k").agg(F.min_by("month", F.struct(-F.col("n"), "month")).alias("month"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.95), 4) AS q95, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def agg_median_quantile(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q, n: F.round(F.percentile("o_totalprice", F.lit(q)), 4).alias(n)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(p(0.5, "med"), p(0.95, "q95"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders x WHERE x.o_custkey = o.o_custkey)")
def agg_latest_by_group_max(spark: SparkSession, d: str) -> DataFrame:
    return W.keep_latest_group(table(spark, d, "orders").withColumn("day", _day()), ["o_custkey"], ["day"]).select("o_custkey", "o_orderkey")


@query("SELECT source, round(1000.0 * sum(h) / sum(w), 6) AS per_1k, round(avg(CASE WHEN w > 0 THEN 1.0 * h / w END), 8) AS mean_of_means, round(1.0 * sum(h) / sum(w), 8) AS pooled FROM (SELECT source, length(text) AS w, length(text) - length(replace(text, 'e', '')) AS h FROM documents) GROUP BY 1")
def agg_ratio_of_sums(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("source", F.length("text").alias("w"), (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("h"))
    h, w = F.sum("h"), F.sum("w")
    return x.groupBy("source").agg(F.round(1000.0 * h / w, 6).alias("per_1k"), F.round(F.avg(S.safe_div(F.col("h"), F.col("w"))), 8).alias("mean_of_means"), F.round(h / w, 8).alias("pooled"))


@query("SELECT n_name, round(100.0 * m['BUILDING'] / t, 4) AS building, round(100.0 * m['BUILDING'] / t - 100.0 * ot / ou, 4) AS deviation FROM (SELECT n_name, map(['BUILDING'], [count(*) FILTER (c_mktsegment = 'BUILDING')]) AS m, count(*) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS ot, count(*) AS ou FROM customer)")
def agg_crosstab(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    hit = F.count(F.when(F.col("c_mktsegment") == "BUILDING", 1))
    g = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(hit.alias("b"), F.count(F.lit(1)).alias("t"))
    every = Window.partitionBy()  # rows here are nations
    share = 100.0 * F.col("b") / F.col("t")
    return g.select("n_name", F.round(share, 4).alias("building"), F.round(share - 100.0 * F.sum("b").over(every) / F.sum("t").over(every), 4).alias("deviation"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT field, v AS value, n, round(1.0 * n / sum(n) OVER (PARTITION BY field), 6) AS share FROM (SELECT 'flag' AS field, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2)")
def agg_unpivot_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.explode(F.array(F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value")), F.struct(F.lit("status").alias("field"), F.col("l_linestatus").alias("value")))).alias("x"))
    g = x.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


@query("SELECT event_type, count(*) AS c0, count(*) FILTER (value > 20) AS c1, count(*) FILTER (value > 20 AND user_id % 2 = 0) AS c2, count(DISTINCT user_id) FILTER (value > 20) AS users FROM events GROUP BY ROLLUP (event_type)")
def agg_nested_ladder_funnel(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("value") > 20
    return table(spark, d, "events").rollup("event_type").agg(
        F.count(F.lit(1)).alias("c0"), F.count_if(a).alias("c1"), F.count_if(a & (F.col("user_id") % 2 == 0)).alias("c2"), F.count_distinct(F.when(a, F.col("user_id"))).alias("users"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def agg_corr_regr(spark: SparkSession, d: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(x, y), 6).alias("r"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM orders) SELECT round(corr(a, b), 6) AS spearman FROM r")
def agg_spearman(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_totalprice", "o_custkey")
    for c in ("o_totalprice", "o_custkey"):
        o = o.join(R.midranks(o, c).withColumnRenamed("rank", f"r_{c}"), c)
    return o.agg(F.round(F.corr("r_o_totalprice", "r_o_custkey"), 6).alias("spearman"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 30")
def agg_period_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n")).where("n >= 30")


@query("SELECT lang, count(*) AS n, sum(CASE WHEN p AND y THEN w END) AS tp, round(sum(CASE WHEN p AND y THEN w ELSE 0 END) / nullif(sum(CASE WHEN p THEN w ELSE 0 END), 0), 6) AS precision_, round(sum(CASE WHEN p AND y THEN w ELSE 0 END) / nullif(sum(CASE WHEN y THEN w ELSE 0 END), 0), 6) AS recall FROM (SELECT lang, n_chars > 1500 AS p, quality = 1 AS y, CAST(1 + doc_id % 3 AS DOUBLE) AS w FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def agg_weighted_confusion(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("n_chars") > 1500).alias("p"), (F.col("quality") == 1).alias("y"), (1.0 + F.col("doc_id") % 3).alias("w"))
    s = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    both = F.col("p") & F.col("y")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(both, F.col("w"))).alias("tp"), F.round(F.try_divide(s(both), s(F.col("p"))), 6).alias("precision_"), F.round(F.try_divide(s(both), s(F.col("y"))), 6).alias("recall"))


@query("WITH x AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*) AS n FROM x), o AS (SELECT avg((a = b)::INT) AS po FROM x), e AS (SELECT sum(pa * pb) AS pe FROM (SELECT a AS v, count(*) / (SELECT n FROM n) AS pa FROM x GROUP BY 1) JOIN (SELECT b AS v, count(*) / (SELECT n FROM n) AS pb FROM x GROUP BY 1) USING (v)) SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM n, o, e")
def agg_kappa(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import kappa

    return kappa(table(spark, d, "labels"), "quality", "toxic").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT c_mktsegment AS x, n_name AS colour, round(avg(o_totalprice), 4) AS avg_o_totalprice, round(median(o_totalprice), 4) AS median_o_totalprice, count(*) AS row_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 500")
def explorer_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.console import aggregate_view

    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return aggregate_view(o, "c_mktsegment", "n_name", [("avg", "o_totalprice"), ("median", "o_totalprice")], {"o_orderstatus": ["F", "O"]})


@query("SELECT c_custkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY total DESC, c_custkey LIMIT 20")
def topk_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "c_custkey").limit(20)


# windows
@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_latest_run_wins(spark: SparkSession, d: str) -> DataFrame:
    return W.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("WITH x AS (SELECT *, bool_or(value > 90) OVER (PARTITION BY user_id) AS has_pos FROM events) SELECT event_id FROM (SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS r FROM x WHERE value > 90 OR NOT has_pos) WHERE r = 1")
def win_latest_positive_else_negative(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return W.latest_positive(e, ["user_id"], F.col("value") > 90, ["day"]).select("event_id")


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, CAST(sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER w AS BIGINT) AS island FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead_islands(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).withColumn("after", F.lead("event_type").over(w))
    return W.islands(e, ["user_id"], ["ts", "event_id"], S.ne_missing(F.col("event_type"), F.col("before"))).select("event_id", "before", "after", "island")


@query(f"SELECT c_custkey, CAST(q AS INT) AS q, CAST(sum(n) OVER (PARTITION BY c_custkey ORDER BY q ROWS 3 PRECEDING) AS BIGINT) AS ttm, CAST(CASE WHEN count(*) OVER (PARTITION BY c_custkey ORDER BY q ROWS 3 PRECEDING) = 4 THEN sum(n) OVER (PARTITION BY c_custkey ORDER BY q ROWS 3 PRECEDING) END AS BIGINT) AS full_ttm, CAST(sum(n) OVER (PARTITION BY c_custkey ORDER BY q) AS BIGINT) AS expanding, round(avg(n) OVER (PARTITION BY c_custkey ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_mean FROM ({_GRID})")
def win_rolling_expanding(spark: SparkSession, d: str) -> DataFrame:
    g, by, order = quarterly(spark, d), ["c_custkey"], ["q"]
    w = Window.partitionBy(*by).orderBy(*order)
    return g.select(
        "c_custkey", "q", W.rolling(F.col("n"), by, order, 4).alias("ttm"), W.rolling(F.col("n"), by, order, 4, 4).alias("full_ttm"),
        F.sum("n").over(w).alias("expanding"), F.round(F.avg("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), 6).alias("prior_mean"),
    )


@query("SELECT o_orderkey, round(max(o_totalprice) OVER w, 2) AS running_max, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER w AS last_f, count(*) OVER (PARTITION BY o_custkey) AS n, (SELECT count(DISTINCT o_orderstatus) FROM orders x WHERE x.o_custkey = o.o_custkey) = 1 AS one_state FROM orders o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def win_cummax_ffill(spark: SparkSession, d: str) -> DataFrame:
    order, by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(F.max("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running_max"),
        S.ffill(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), order).alias("last_f"), F.count(F.lit(1)).over(by).alias("n"),
        (F.min("o_orderstatus").over(by) == F.max("o_orderstatus").over(by)).alias("one_state"),
    )


@query("SELECT p_partkey, round((rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 8) AS pct, p_size >= quantile_cont(p_size, 0.95) OVER (PARTITION BY p_brand) AS high FROM part")
def win_rank_pct_tails(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("pct", F.round(S.pct_rank(F.col("p_size"), "p_brand"), 8))
    return p.select("p_partkey", "pct", (F.col("p_size") >= F.percentile("p_size", F.lit(0.95)).over(Window.partitionBy("p_brand"))).alias("high"))


@query("WITH x AS (SELECT o_orderkey, year(o_orderdate) AS y, floor(o_totalprice / 1000) AS v FROM orders), f AS (SELECT min(y) AS y0 FROM x), c AS (SELECT y, v, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT a.y, a.v, (sum(CASE WHEN b.v < a.v THEN b.n ELSE 0 END) + sum(CASE WHEN b.v <= a.v THEN b.n ELSE 0 END)) / (2.0 * sum(b.n)) AS p FROM c a, f, c b WHERE b.y < a.y OR (a.y = y0 AND b.y = a.y) GROUP BY 1, 2) SELECT o_orderkey, round(p, 8) AS pit_rank FROM x LEFT JOIN r ON x.y = r.y AND x.v = r.v")
def win_pit_rank(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.floor(F.col("o_totalprice") / 1000).alias("v"))
    return R.earlier_midrank(x, "y", "v").select("o_orderkey", F.round("pit_rank", 8).alias("pit_rank"))


@query("SELECT a.o_orderkey, round(1.0 * (SELECT count(*) FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_totalprice <= a.o_totalprice) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 8) AS ecdf FROM orders a WHERE o_orderstatus = 'P'")
def win_ecdf(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus IN ('F', 'P')").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("train"))
    share = R.ecdf(o, "o_totalprice", "train")
    return o.where("NOT train").join(share, "o_totalprice").select("o_orderkey", F.round("ecdf", 8).alias("ecdf"))


@query("""WITH x AS (SELECT o_custkey AS k, year(o_orderdate) AS y, quarter(o_orderdate) AS q, min(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1, 2, 3), z AS (SELECT k, y, q, y * 4 + q - lag(y * 4 + q) OVER w AS s, date_diff('day', lag(day) OVER w, day) AS g FROM x WINDOW w AS (PARTITION BY k ORDER BY day))
 SELECT k, CAST(y AS INT) AS y, CAST(q AS INT) AS q, CASE WHEN s IS NULL THEN 'first' WHEN NOT (g >= 30 AND s >= 1 AND g BETWEEN 91 * s - 60 AND 91 * s + 70) THEN 'conflict' WHEN s = 1 THEN 'next' ELSE 'gap' END AS sequence FROM z""")
def win_sequence_label(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.min(_day()).alias("day"))
    return W.sequence_labels(x, ["k"], "y", "q", "day").select("k", "y", "q", "sequence")


@query("WITH x AS (SELECT o_custkey AS k, year(o_orderdate) AS y, 91 * quarter(o_orderdate) AS days, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), c AS (SELECT k, y, days, round(sum(v) OVER (PARTITION BY k, y ORDER BY days), 2) AS ytd FROM x) SELECT k, CAST(y AS INT) AS y, CAST(days AS INT) AS days, round(ytd - coalesce(lag(ytd) OVER w, 0), 2) AS discrete FROM c WINDOW w AS (PARTITION BY k, y ORDER BY days) QUALIFY days - coalesce(lag(days) OVER w, 0) BETWEEN 75 AND 100")
def win_ytd_to_discrete(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), (F.quarter("o_orderdate") * 91).alias("days")).agg(F.sum("o_totalprice").alias("v"))
    c = x.withColumn("ytd", F.round(F.sum("v").over(Window.partitionBy("k", "y").orderBy("days")), 2))
    return W.ytd_to_discrete(c, ["k", "y"], "days", "ytd").select("k", "y", "days", F.round("discrete", 2).alias("discrete"))


# order, sampling, sets
@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_limit_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 4")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).where("r <= 4").select("p_brand", "p_partkey")


@query("SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), 's1')) AS h FROM customer ORDER BY h LIMIT 50")
def seeded_hash_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", seeded(F.col("c_custkey"), "s1").alias("h")).orderBy("h").limit(50)


@query("WITH x AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), 's2'))) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, round(n / least(n, 20), 6) AS inclusion_weight FROM x WHERE r <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sampling import stratified

    return stratified(table(spark, d, "customer"), ["c_mktsegment"], "c_custkey", 20, "s2").select("c_custkey", "c_mktsegment", F.round("inclusion_weight", 6).alias("inclusion_weight"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("WITH a AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, 'F' AS src, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, 'O' AS src, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.y = b.y)")
def fill_gap_union(spark: SparkSession, d: str) -> DataFrame:
    def part(s: str) -> DataFrame:
        return table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.lit(s).alias("src"), F.count(F.lit(1)).alias("n"))

    return part("F").unionByName(part("O").join(part("F"), ["k", "y"], "left_anti"))


@query("WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'dropped' WHEN abs(b.v - a.v) / abs(a.v) > 0.25 THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k")
def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.catalog import compare_snapshots

    def at(m: int) -> DataFrame:
        return table(spark, d, "orders").where(F.col("o_orderkey") % m != 0).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))

    return compare_snapshots(at(7), at(5), ["k"], "v", 0.25).select("k", "state")


@query("WITH x AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS d, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey, year(o_orderdate)) SELECT k, d, round(CASE WHEN date_diff('day', lag(d) OVER w, d) BETWEEN 340 AND 380 AND lag(v) OVER w > 0 THEN v / lag(v) OVER w - 1 END, 6) AS growth FROM x WINDOW w AS (PARTITION BY k ORDER BY d)")
def win_growth_gap_guard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.max(_day()).alias("d"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    return W.guarded_growth(x, ["k"], "d", "v").select("k", "d", F.round("growth", 6).alias("growth"))


@query("WITH x AS (SELECT o_custkey AS k, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS q, count(*) AS n FROM orders GROUP BY 1, 2) SELECT k, q, CAST(CASE WHEN q - lag(q, 3) OVER w = 3 THEN sum(n) OVER (PARTITION BY k ORDER BY q ROWS 3 PRECEDING) END AS BIGINT) AS ttm FROM x WINDOW w AS (PARTITION BY k ORDER BY q)")
def win_ttm_consecutive(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), S.quarter_ordinal(F.col("o_orderdate")).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return W.ttm_consecutive(x, ["k"], "q", "n").select("k", "q", "ttm")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR (o_orderpriority = '3-MEDIUM' AND o_totalprice > 100000))")
def trigger_population(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array(F.col("o_orderpriority"))
    hit = lambda *v: F.arrays_overlap(tags, F.array(*[F.lit(x) for x in v]))
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (hit("1-URGENT", "2-HIGH") | (hit("3-MEDIUM") & (F.col("o_totalprice") > 100000)))).select("o_custkey", "o_orderkey")
