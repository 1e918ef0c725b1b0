"""Small fixtures for rules that the query tables do not reach."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, semantics
from tidemark.operators import joins, market, panels, sampling, stats, text, windows
from tidemark.sources import catalog, console, documents
from tidemark.streaming import incremental

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_paragraphs(spark):
    body = "Intro line.\nSecond line.\n| a | b |\n| --- | --- |\n| 1 | 2 |\n• one\n• two"
    other = "![img1.jpg](img1.jpg)\n12\nTable of Contents\nReal text here.\n---\nMore text."
    df = spark.createDataFrame([(1, body), (2, other), (3, "See [Risk Factors](#a1) below."), (4, " Text with nbsp  "), (5, None), (6, ""), (7, "•\nAI\nReal words")], "id int, t string")
    p = text.split_paragraphs(df, ["id"], "t")
    got = {}
    for r in p.orderBy("id", "paragraph_index").collect():
        got.setdefault(r.id, []).append((r.content_type, r.paragraph_index, r.paragraph_text, r.is_scorable))
    assert [x[:2] for x in got[1]] == [("prose", 1), ("prose", 2), ("table", 3), ("list", 6)]
    assert got[1][2][2].count("\n") == 2
    assert [x[1] for x in got[2]] == [4, 6]
    assert got[3][0][2] == "See \x01 below."
    assert got[4][0][2] == "Text with nbsp"
    assert [x[3] for x in got[7]] == [False, False, True]
    assert 5 not in got and 6 not in got


def test_sentences(spark):
    df = spark.createDataFrame([(1, "prose", 1, "Mr. Smith joined the U.S. team. It grew."), (1, "list", 2, "• one\n• two"), (1, "table", 4, "| a |")], "id int, content_type string, paragraph_index long, paragraph_text string")
    s = rows(text.split_sentences(df, ["id"]).select("paragraph_index", "sentence_index", "sentence_text"), "paragraph_index", "sentence_index")
    assert s == [(1, 1, "Mr. Smith joined the U.S. team."), (1, 2, "It grew."), (2, 1, "• one"), (2, 2, "• two"), (4, 1, "| a |")]


def test_hash(spark):
    assert hashing.blake2b8(None) == hashing.blake2b8("") and len(hashing.blake2b8("x")) == 16
    df = spark.createDataFrame([("a",), (None,)], "t string").select(hashing.content_hash("t").alias("h"))
    assert {r.h for r in df.collect()} == {hashing.blake2b8("a"), hashing.blake2b8("")}


def test_lexicon_and_semantics(spark):
    df = spark.createDataFrame([(1, "We deploy generative AI in our products."), (2, "Our valuation model uses an algorithm."), (3, "certain chair remains, said Thailand")], "i int, t string")
    got = rows(text.lexical_score(df, "t", ["ai", "generative ai"], ["algorithm", "model"]).select("i", "strong_terms", "weak_terms"), "i")
    assert got == [(1, ["ai", "generative ai"], []), (2, [], ["algorithm", "model"]), (3, [], [])]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "i int, v array<double>")
    s = text.semantic_score(v, "v", {"use": [[0.8, 0.0], [0.0, 0.7]], "negative": [[0.6, 0.0]]})
    assert rows(s.select("i", "score_use", "negative_similarity", "best_anchor"), "i") == [(1, 0.8, 0.6, "use"), (2, 0.7, 0.0, "use")]


def test_asof(spark):
    e = spark.createDataFrame([(1, "A", D(2023, 12, 31)), (2, "A", D(2024, 1, 1)), (3, "A", D(2024, 4, 1)), (4, "B", D(2024, 4, 1)), (5, None, D(2024, 4, 1))], "id int, k string, d date")
    s = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("A", D(2024, 4, 1), 2), (None, D(2024, 1, 1), 9)], "k string, at date, v int")
    get = lambda **a: [r[1] for r in rows(joins.asof(e, s, ["k"], "d", "at", ["v"], **a).select("id", "v"), "id")]
    assert get() == [None, 1, 2, None, None]
    assert get(strict=True) == [None, None, 1, None, None]
    assert get(direction="forward") == [1, 1, 2, None, None]
    assert get(direction="forward", strict=True) == [1, 2, None, None, None]


def test_asof_nearest(spark):
    e = spark.createDataFrame([(1, "A", D(2024, 1, 11)), (2, "A", D(2024, 1, 12)), (3, "A", D(2024, 2, 6))], "id int, k string, d date")
    s = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("A", D(2024, 2, 1), 2), ("A", D(2024, 2, 11), 3)], "k string, at date, v int")
    assert [r[1] for r in rows(joins.asof_nearest(e, s, ["k"], "d", "at", ["v"], 10).select("id", "v"), "id")] == [1, None, 2]


def test_left_one_and_indicator(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    with pytest.raises(ValueError):
        joins.left_one(a, b, ["k"])
    assert rows(joins.indicator(a, b, ["k"]), "k") == [(1, "left_only"), (2, "both"), (3, "right_only")]


def test_turns(spark):
    t = [(1, 0, "Operator", "Welcome. Later we take questions."), (1, 1, "CEO", "Hello"), (1, 2, "Operator", "The first question comes from X"), (1, 3, "Analyst", "Why?"), (2, 0, "CEO", "Only me"), (2, 1, "CEO", " ")]
    df = spark.createDataFrame(t, "c int, turn int, speaker string, text string")
    got = rows(text.call_turns(df, "c", "turn", "speaker", "text", "(?i)^\\s*operator", "(?i)first\\s+question").select("c", "paragraph_index", "section"), "c", "paragraph_index")
    assert [g[2] for g in got] == ["prepared", "prepared", "handoff", "qa", "unknown"]


def test_ytd_and_first(spark):
    f = spark.createDataFrame([("A", 90, 100.0), ("A", 181, 250.0), ("A", 273, 420.0), ("A", 400, 600.0)], "k string, days int, v double")
    assert [r[0] for r in rows(windows.ytd_to_discrete(f, ["k"], "days", "v").select("discrete", "days"), "days")] == [100, 150, 170]
    g = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("A", D(2024, 2, 1), 2)], "k string, filed date, v int")
    assert panels.first_disclosed(g, ["k"], "filed", ["v"]).first().v == 1


def test_sequence(spark):
    s = [("a", 2024, 1, D(2024, 5, 1)), ("a", 2024, 2, D(2024, 7, 30)), ("b", 2024, 1, D(2024, 5, 1)), ("b", 2024, 4, D(2025, 2, 1)), ("c", 2024, 2, D(2024, 5, 1)), ("c", 2024, 1, D(2024, 9, 1))]
    df = windows.sequence_labels(spark.createDataFrame(s, "k string, y int, q int, d date"), ["k"], "y", "q", "d")
    assert [r[2] for r in rows(df.select("k", "d", "sequence"), "k", "d")] == ["first", "next", "first", "gap", "first", "conflict"]


def test_beta_and_event(spark):
    days = [("A", D(2024, 1, 1) + dt.timedelta(i), 0.001 + 1.5 * ((i * 7) % 5 - 2) / 100, ((i * 7) % 5 - 2) / 100, i + 1) for i in range(30)]
    df = spark.createDataFrame(days, "u string, d date, e double, m double, rn int")
    got = market.frame_beta(df, "u", "e", "m", -9, 1, 10).orderBy("rn").collect()
    assert got[8].beta is None and abs(got[20].beta - 1.5) < 1e-9 and abs(got[20].alpha - 0.001) < 1e-9
    e = spark.createDataFrame([(1, "A", D(2023, 12, 30)), (2, "A", D(2025, 1, 1))], "id int, u string, at date")
    assert rows(market.event_rows(e, df.where("rn > 1"), "u", "at", "d").select("id", "event_rn"), "id") == [(1, 2), (2, None)]


def test_shrink_and_index(spark):
    p = spark.createDataFrame([("a", 1, 10, 0, 0), ("b", 1, 20, 5, 5), ("c", 1, 20, 5, 1)], "k string, y int, volume int, n int, g int")
    s = {r.k: r.s for r in p.withColumn("s", panels.shrink(F.col("g"), F.col("n"), "y")).collect()}
    assert abs(s["a"] - 0.6) < 1e-9 and s["b"] > s["a"] > s["c"]
    i = {r.k: r.pct_volume for r in panels.gap_index(p, "y", "volume", "n", [("g", "n")]).collect()}
    assert abs(i["a"] - 1 / 3) < 1e-12 and i["b"] == i["c"] == 2.5 / 3


def test_stats(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ np.array([2.0, -1.0]) + rng.normal(size=200) / 10
    df = spark.createDataFrame([(float(b), float(a[0]), float(a[1]), i % 20) for i, (a, b) in enumerate(zip(x, y, strict=True))], "y double, a double, b double, g int")
    got = stats.ols(df, "y", ["a", "b"], cluster="g")
    design = np.column_stack([np.ones(200), x])
    assert np.allclose([r["coef"] for r in got], np.linalg.lstsq(design, y, rcond=None)[0])
    assert abs(stats.t_tail(2.0, 10) - 0.07338803) < 1e-6 and abs(stats.t_tail(0.5, 3) - 0.6514479) < 1e-6
    assert np.allclose(stats.simplex(np.array([[0.2, 0.3, 0.5], [5.0, 0, 0]])), [[0.2, 0.3, 0.5], [1, 0, 0]])
    z, a = stats.archetypes(np.array([[0.0, 0], [1, 0], [0, 1], [0.3, 0.3]]), 3)
    assert np.allclose(a.sum(1), 1) and ((np.array([[0.0, 0], [1, 0], [0, 1], [0.3, 0.3]]) - a @ z) ** 2).sum() < 0.05
    assert stats.rand_index(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1.0
    b, se = stats.newey_west(design, y, 3)
    assert np.allclose(b, [r["coef"] for r in got]) and (se > 0).all()


def test_sampling(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("s"), (F.col("id") % 7).alias("c"))
    one, two = (sorted(r.id for r in sampling.staged(df, ["s"], ["c"], "id", (10, 5, 20), "x").repartition(n).collect()) for n in (1, 5))
    assert one == two and len(one) == len(set(one)) == 30 + 35 + 20
    w = sampling.stratified(df, ["s"], "id", 10, "x").agg(F.sum("inclusion_weight")).first()[0]
    assert abs(w - 300) < 1e-9


def test_semantics(spark):
    df = spark.createDataFrame([("(1,200)", 1.0, 0.0, "İΣ"), ("N/A", 1.0, 2.0, "A")], "t string, a double, b double, s string")
    got = df.select(semantics.vendor_number(F.col("t")), semantics.safe_div(F.col("a"), F.col("b")), semantics.fold_lower(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(-1200.0, None, "iσ"), (None, 0.5, "a")]


def test_families(spark):
    spine = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    same, other = spine, spark.createDataFrame([(1, "x"), (2, "z")], "id int, a string")
    assert panels.join_families(spine, {"f": same}, "id").columns == ["id", "a"]
    assert panels.join_families(spine, {"f": other}, "id").columns == ["id", "a", "f__a"]


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    c.add("silver.t", keys=["k"])
    c.add("bronze.raw", additive=True)
    c.write("silver.t", spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"))
    c.write("silver.t", spark.createDataFrame([(3, "c")], "k int, v string"))
    assert rows(c.scan("silver.t"), "k") == [(3, "c")] and c.manifest("silver.t")["rows"] == 1
    with pytest.raises(ValueError):
        c.write("silver.t", spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    with pytest.raises(PermissionError):
        c.write("bronze.raw", spark.range(1))
    for _ in range(2):
        c.append_run("bronze.raw", spark.range(3), "r1")
    c.append_run("bronze.raw", spark.range(3, 5), "r2")
    assert c.scan("bronze.raw").count() == 5
    assert c.pending(spark.range(7), "bronze.raw", "id").count() == 2
    u = catalog.union_relaxed(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2.5, "x")], "a double, b string"))
    assert dict(u.dtypes) == {"a": "double", "b": "string"} and u.count() == 2


def test_console(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert console.run_sql(spark, "select * from ten;", 3)["n"] == 3
    assert console.run_sql(spark, "select * from ten limit 5")["n"] == 5
    assert console.run_sql(spark, "select nothing from nowhere")["error"]
    assert any(t["name"] == "ten" for t in console.tables(spark))


def test_documents(spark):
    assert documents.html_text("<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"
    page = '<xbrli:context id="c"><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:context><xbrli:context id="i"><xbrli:instant>2024-03-31</xbrli:instant></xbrli:context><ix:nonFraction name="g:R" contextRef="c" scale="3">1,234</ix:nonFraction><ix:nonFraction name="g:A" contextRef="i" sign="-">5,678</ix:nonFraction>'
    df = documents.read_facts(spark.createDataFrame([("T", page), ("U", "<p>none</p>")], "ticker string, html string"), ["ticker"], "html")
    assert rows(df.select("concept", "numeric_value", "period_type", "period_start"), "concept") == [("g:A", -5678.0, "instant", None), ("g:R", 1234000.0, "duration", "2024-01-01")]
    lines = ["| Item 1. Business | 3 |", "| Item 1A. Risk | 5 |", "| Item 2. Property | 9 |", "| Item 3. Legal | 9 |", "| Item 4. Mine | 9 |", "", "Item 1. Business", "We sell.", "Item 1A. Risk", "It may fail.", "Item 2. Property", "None."]
    assert documents.segment_items(lines) == {"1": "Item 1. Business\nWe sell.", "1A": "Item 1A. Risk\nIt may fail.", "2": "Item 2. Property\nNone."}


def test_incremental(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(src)
    incremental.append_new(spark, src, df.schema, out, cp, "k")
    spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string").write.mode("append").parquet(src)
    incremental.append_new(spark, src, df.schema, out, cp, "k")
    incremental.append_new(spark, src, df.schema, out, cp, "k")
    assert rows(spark.read.parquet(out).select("k", "v"), "k") == [(1, "a"), (2, "b"), (3, "d")]


def test_taxonomy(spark):
    from tidemark.operators import firms

    e = "array<struct<name:string,role:string>>"
    df = spark.createDataFrame(
        [(1, "deploy", "chat assistant", "support", "customers", "deployed", "mixed", [("Acme Cloud", "provider")], "named"), (2, "invest", None, "N/A", None, None, None, [], None)],
        f"id int, action string, object string, function string, target string, stage string, source string, entities {e}, evidence_type string")
    t = firms.activity_flags(firms.taxonomy(df, [("support|service", "Service")], [("acme", "Acme")], [("assistant", "Assistant")])).orderBy("id").collect()
    assert (t[0].function_family, t[0].provider_families, t[0].provider_family, t[0].activity) == ("Service", ["Acme", "proprietary"], "Acme", "deploy · Assistant")
    assert t[0].customer_facing_deployment and t[0].third_party_ai and t[0].named_function and t[0].third_party_named_provider and not t[0].infrastructure_investment
    assert (t[1].function_family, t[1].provider_family, t[1].object_family) == ("unspecified", "unspecified", "AI, unspecified object") and t[1].infrastructure_investment and not t[1].named_function
    a = spark.createDataFrame([("A", "h", "call", D(2024, 1, 1)), ("A", "h", "filing", D(2024, 2, 1))], "firm string, h string, channel string, d date")
    one = firms.one_per_firm(a, "firm", ["h"], "channel", "d").collect()
    assert [(r.channel, r.first_seen) for r in one] == [("filing", D(2024, 1, 1))]


def test_groups(spark):
    from tidemark.operators import firms

    nodes = spark.range(60).select(F.col("id").alias("key"))
    edges = spark.range(49).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    got = {r.key: r.group for r in firms.min_label(nodes, edges).collect()}
    assert all(got[i] == (0 if i < 50 else i) for i in range(60))


def test_nearest_text_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.5), (3, 1.5), (3, None)], "p int, v double")
    got = {(r.p, r.v): r.pit_rank for r in windows.earlier_midrank(df, "p", "v").collect()}
    assert got == {(1, 1.0): 0.25, (1, 2.0): 0.75, (2, 1.5): 0.5, (3, 1.5): 0.5, (3, None): None}
