"""Queries for firm-level rules, on the nearest thing that the tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import firms as X
from ..session import table
from .registry import query


@query("""WITH f AS (SELECT o_custkey AS firm, o_orderpriority AS form, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 3 = 0 THEN 'delisted' ELSE 'active' END AS status FROM orders),
 l AS (SELECT firm, max(d) AS last FROM f WHERE form = '3-MEDIUM' GROUP BY 1), n AS (SELECT f.*, last, EXISTS (SELECT 1 FROM f x WHERE x.firm = f.firm AND x.form = '2-HIGH' AND date_diff('day', f.d, x.d) BETWEEN 0 AND 60) AS paired FROM f LEFT JOIN l ON f.firm = l.firm WHERE form = '1-URGENT'),
 r AS (SELECT firm, d, CASE WHEN paired AND (last IS NULL OR last <= d) THEN 1 WHEN status = 'delisted' AND paired THEN 2 WHEN status = 'delisted' AND (last IS NULL OR d > last) THEN 3 END AS rule FROM n), b AS (SELECT firm, min(rule) AS rule FROM r WHERE rule IS NOT NULL GROUP BY 1)
 SELECT firm, CASE WHEN rule < 3 THEN max(d) ELSE min(d) END AS delisting_date, rule FROM r JOIN b USING (firm, rule) GROUP BY firm, rule""")
def universe_delistings(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(
        F.col("o_custkey").alias("firm"), F.col("o_orderpriority").alias("form"), F.col("o_orderdate").cast("date").alias("day"),
        F.lit(None).cast("string").alias("items"), F.when(F.col("o_custkey") % 3 == 0, "delisted").otherwise("active").alias("status"))
    return X.delistings(f, ["1-URGENT"], ["2-HIGH"], ["3-MEDIUM"], "1900-01-01", days=60)


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS f, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS l, list(DISTINCT l_partkey) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
 p AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.f = b.f AND a.k <> b.k AND abs(date_diff('day', a.d, b.d)) <= 200 AND (abs(date_diff('day', a.d, b.d)) <= 1 OR a.l = b.l
  OR len(list_intersect(a.s, b.s)) >= 0.1 * len(list_distinct(list_concat(a.s, b.s))) AND len(list_filter(a.s, lambda x: x IS NOT NULL)) > 0 AND len(list_intersect(a.s, b.s)) > 0)),
 r(a, b) AS (SELECT k, k FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS key, min(b) AS "group" FROM r GROUP BY 1""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    # an order's parts stand for a transcript's sketch; all sketches here are far under 256 values, so similarity is exact
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("s"))
    c = table(spark, d, "orders").join(parts, "o_orderkey", "left").select(
        F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("l"), F.coalesce("s", F.array().cast("array<bigint>")).alias("s"))
    return X.same_event_groups(c, "f", "k", "d", "l", "s", similar=0.1)


@query("WITH x AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INT) AS y, o_orderstatus AS ch, o_orderpriority < '3' AS fam FROM orders) SELECT k, y, count(*) FILTER (ch = 'F') AS na, count(*) FILTER (ch = 'O') AS nb, round(1.0 * count(*) FILTER (ch = 'F' AND fam) / count(*) FILTER (ch = 'F') - 1.0 * count(*) FILTER (ch = 'O' AND fam) / count(*) FILTER (ch = 'O'), 6) AS gap_fam FROM x GROUP BY 1, 2 HAVING count(*) FILTER (ch = 'F') >= 3 AND count(*) FILTER (ch = 'O') >= 3")
def channel_gap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("ch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") < "3").alias("fam"))
    g = X.channel_gap(x, ["k", "y"], "ch", "n", ["fam"], "F", "O")
    return g.withColumn("gap_fam", F.round("gap_fam", 6))


@query("SELECT c_nationkey AS g, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS se, round(avg(c_acctbal) / (stddev_samp(c_acctbal) / sqrt(count(*))), 4) AS t FROM customer GROUP BY 1")
def agg_ttest(spark: SparkSession, d: str) -> DataFrame:
    t = X.mean_test(table(spark, d, "customer").withColumnRenamed("c_nationkey", "g"), ["g"], "c_acctbal")
    return t.select("g", "n", *[F.round(c, 4).alias(c) for c in ("mean", "se", "t")])


@query("""WITH m AS (SELECT DISTINCT p_brand AS assignee, f.firm FROM part, (VALUES ('one', 'brand#1'), ('two', 'brand#2')) f(firm, pattern) WHERE regexp_matches(lower(p_brand), pattern)),
 p AS (SELECT DISTINCT firm, p_partkey, p_size % 4 AS year, p_size < 5 AS core, p_size < 25 AND regexp_matches(lower(p_name), 'a') AS rel FROM part JOIN m ON p_brand = assignee)
 SELECT firm, CAST(year AS INT) AS year, count(*) AS total, count(*) FILTER (core OR rel) AS ai, count(*) FILTER (core) AS core, round(1.0 * count(*) FILTER (core OR rel) / count(*), 4) AS intensity FROM p GROUP BY 1, 2""")
def patents_counts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    code = F.when(F.col("p_size") < 5, "G06N3/04").when(F.col("p_size") < 25, "G06Q10/1").otherwise("A01B1/0")
    p = part.select(F.col("p_partkey").alias("publication"), F.col("p_brand").alias("assignee"), (F.col("p_size") % 4).alias("year"), F.array(code).alias("codes"), F.col("p_name").alias("text"))
    rules = spark.sql("SELECT * FROM VALUES ('one', 'brand#1'), ('two', 'brand#2') AS t(firm, pattern)")
    return X.patent_counts(p, p, rules, ["G06N3"], ["G06Q10", "G06N3"], "a")


@query()
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"), F.count(F.lit(1)).cast("double").alias("n")), "c_custkey")
    return X.matched_controls(c, "c_custkey", "c_nationkey", ["v", "n", "c_acctbal"], [1, 2, 4, 5, 7]).withColumn("distance", F.round("distance", 6))


# Fields of invented activities, one an order, so that every rule of the flags is met by some of them.
_ACTION = ["deploy", "integrate", "scale", "develop", "invest", "procure", "partner", "staff", "measure", "govern", "restrict", None]
_TARGET = ["customers", "employees", "internal_process", "developers", None]
_SOURCE = ["own", "third_party", "mixed", "open_source", "co_developed", "acquired", None]
_STAGE = ["unspecified", "exploring", "piloting", "deployed", "scaled"]
_EVIDENCE = ["named", "metric", None]
_FUNCTION = ["customer support", "N/A", "risk control", None]
_OBJECT = ["AI tools", "chat assistant", "fraud model", None, "our new AI-powered platform for loans"]
_ROLE = ["provider", "customer", "own_brand", "model"]
_NAME = ["Acme Cloud", "some vendor", "in-house", "Zenith"]
_FUNCTIONS = [("support|service", "service"), ("risk|fraud", "control")]
_PROVIDERS = [("in-house|own", "proprietary"), ("vendor|third", "third_party_unnamed"), ("acme", "Acme"), (".", "other_named")]
_OBJECTS = [("assistant|chat", "assistant"), ("model", "model")]


def _pick_sql(values: list, step: int) -> str:
    """A field by the order's key: the values in turn, each for `step` keys."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][1 + (o_orderkey // {step}) % {len(values)}]"


def activities(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.floor(F.col("o_orderkey") / step) % len(values)).cast("int"))
    entity = F.struct(pick(_NAME, 5).alias("name"), pick(_ROLE, 2).alias("role"))
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", pick(_ACTION, 1).alias("action"), pick(_TARGET, 3).alias("target"), pick(_SOURCE, 2).alias("source"), pick(_STAGE, 7).alias("stage"), pick(_EVIDENCE, 11).alias("evidence_type"),
        pick(_FUNCTION, 13).alias("function"), pick(_OBJECT, 3).alias("object"), F.when(F.col("o_orderkey") % 3 != 0, F.array(entity)).otherwise(F.array().cast("array<struct<name:string,role:string>>")).alias("entities"),
    )


def _flag_sql() -> str:
    fields = {"action": _pick_sql(_ACTION, 1), "target": _pick_sql(_TARGET, 3), "source": _pick_sql(_SOURCE, 2), "stage": _pick_sql(_STAGE, 7), "evidence_type": _pick_sql(_EVIDENCE, 11), "function": _pick_sql(_FUNCTION, 13), "object": _pick_sql(_OBJECT, 3)}
    used = "coalesce(action IN ('deploy', 'integrate', 'scale'), false)"
    rules = {
        "customer_facing_deployment": f"{used} AND target = 'customers'", "internal_deployment": f"{used} AND target IN ('employees', 'internal_process')", "developer_tools": f"{used} AND target = 'developers'",
        "proprietary_ai": "coalesce(action = 'develop', false) OR coalesce(source = 'own', false)", "own_brand_named": "role = 'own_brand'", "third_party_ai": "source IN ('third_party', 'mixed', 'open_source')",
        "co_developed_or_acquired": "source IN ('co_developed', 'acquired')", "named_customer": "role = 'customer'", "third_party_named_provider": "role IN ('provider', 'model') AND name IN ('Acme Cloud', 'Zenith')",
        "infrastructure_investment": "action = 'invest'", "acquisition_or_licensing": "action = 'procure'", "partnership": "action = 'partner'", "talent_or_training": "action = 'staff'",
        "quantified_outcome": "coalesce(action = 'measure', false) OR coalesce(evidence_type = 'metric', false)", "governance_or_restriction": "action IN ('govern', 'restrict')", "piloting_or_exploring": "stage IN ('exploring', 'piloting')",
        "named_product_or_process": "evidence_type = 'named'", "named_function": "function IN ('customer support', 'risk control')", "deployed_or_scaled": "stage IN ('deployed', 'scaled')",
    }
    counts = ", ".join(f"count(*) FILTER ({rule}) AS {name}" for name, rule in rules.items())
    inner = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    entity = f"CASE WHEN o_orderkey % 3 <> 0 THEN {_pick_sql(_NAME, 5)} END AS name, CASE WHEN o_orderkey % 3 <> 0 THEN {_pick_sql(_ROLE, 2)} END AS role"
    return f"SELECT o_orderstatus, {counts} FROM (SELECT o_orderstatus, {inner}, {entity} FROM orders) GROUP BY 1"


@query(_flag_sql())
def activity_flags(spark: SparkSession, d: str) -> DataFrame:
    x = X.activity_flags(X.taxonomy(activities(spark, d), _FUNCTIONS, _PROVIDERS, _OBJECTS))
    return x.groupBy("o_orderstatus").agg(*[F.count_if(name).alias(name) for name, _ in X.FLAGS])


@query(f"""WITH a AS (SELECT {_pick_sql(_ACTION, 1)} AS action, {_pick_sql(_SOURCE, 2)} AS source, {_pick_sql(_EVIDENCE, 11)} AS evidence, {_pick_sql(_FUNCTION, 13)} AS f, {_pick_sql(_OBJECT, 3)} AS o,
  CASE WHEN o_orderkey % 3 <> 0 AND {_pick_sql(_ROLE, 2)} IN ('provider', 'model') THEN {_pick_sql(_NAME, 5)} END AS name FROM orders),
 b AS (SELECT *, CASE name WHEN 'Acme Cloud' THEN 'Acme' WHEN 'some vendor' THEN 'third_party_unnamed' WHEN 'in-house' THEN 'proprietary' WHEN 'Zenith' THEN 'other_named' END AS p, coalesce(source IN ('own', 'mixed'), false) AS own,
  CASE WHEN o IS NULL OR o = 'AI tools' THEN 'AI, unspecified object' WHEN o = 'chat assistant' THEN 'assistant' WHEN o = 'fraud model' THEN 'model' WHEN evidence = 'named' THEN 'named product or platform' ELSE 'other' END AS object_family,
  CASE f WHEN 'customer support' THEN 'service' WHEN 'risk control' THEN 'control' ELSE 'unspecified' END AS function_family FROM a)
 SELECT provider_family, activity_function, count(*) AS n FROM (SELECT CASE WHEN p IN ('Acme', 'other_named', 'third_party_unnamed') THEN p WHEN own OR p = 'proprietary' THEN 'proprietary' ELSE 'unspecified' END AS provider_family,
  concat_ws(' · ', action, object_family, function_family) AS activity_function FROM b) GROUP BY 1, 2""")
def activity_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    x = X.taxonomy(activities(spark, d), _FUNCTIONS, _PROVIDERS, _OBJECTS)
    return x.groupBy("provider_family", "activity_function").agg(F.count(F.lit(1)).alias("n"))
