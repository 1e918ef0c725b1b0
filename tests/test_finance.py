"""Names, calls, files, windows and frozen models on small examples."""

from datetime import date as D
from difflib import SequenceMatcher

import numpy as np

from tidemark.functions import names
from tidemark.operators import calls, market, posture
from tidemark.sources import console, files


def test_names(spark):
    assert names.normal("Café Société’s, Inc. & Co") == "cafe societe inc & co" and names.normal(None) == ""
    assert names.bare("The Lowe's Companies, Inc.") == "lowe" and set(names.aliases("Willis Towers Watson plc")) == {"willis towers watson", "willis towers", "willis", "wtw"}
    assert "m and t bank" in names.aliases("M & T Bank Corp")
    df = spark.createDataFrame([("Exxon Mobil Corp", "ExxonMobil"), ("Lowe's Companies", "Lowe's"), ("Apple Inc.", "Apple Inc"), ("Apple Inc.", "Microsoft"), ("Revvity Inc", "Revitty"), ("A", None)], "company string, host string")
    got = df.select("host", names.is_host("host", names.alias_forms("company")).alias("own"), names.fuzzy_ratio("company", "host").alias("r")).collect()
    assert [r.own for r in got] == [True, True, True, False, True, False]
    assert got[0].r == SequenceMatcher(None, "Exxon Mobil Corp", "ExxonMobil").ratio() and (got[5].r is None or np.isnan(got[5].r))


def test_call_check(spark):
    rows = [
        (1, "Hilton Worldwide Holdings Inc", D(2024, 7, 30), "2024Q2", "Good morning and welcome to the Hilton Second Quarter 2024 earnings call. Today is July 30, 2024."),
        (2, "Acme Corp", D(2024, 7, 30), "2024Q2", "Welcome to the Zenith Industries second quarter of fiscal 2024 conference call."),
        (3, "Acme Corp", D(2024, 7, 30), "2024Q2", "Welcome to Acme Q1 FY'24 results. It is May 2, 2024."),
        (4, "Acme Corp", D(2024, 7, 30), "2024Q2", "Welcome to Acme 2024 first quarter results."), (5, "Acme Corp", D(2024, 7, 30), "2024Q2", None),
    ]
    got = {r.call_id: r for r in calls.call_check(spark.createDataFrame(rows, "call_id int, company_name string, call_date date, fiscal_period string, intro string")).collect()}
    assert (got[1].host, got[1].stated_period, got[1].stated_date, got[1].release_gap, got[1].exclude_reason) == ("Hilton", "2024Q2", D(2024, 7, 30), 0, None)
    assert got[2].exclude_reason == "other_company" and got[3].exclude_reason == "other_date" and got[3].stated_period == "2024Q1"
    assert got[4].exclude_reason == "other_period" and got[5].exclude_reason is None and got[5].host is None
    more = spark.createDataFrame([(1, "g", 1, 10, "x"), (2, "g", 2, 90, None), (3, "g", 2, 95, None)], "call_id int, grp string, source_rank int, n int, exclude_reason string")
    assert [r.call_id for r in calls.representative(more, "grp", "source_rank", "n").where("is_representative").collect()] == [3]


def test_expanded_residuals(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=40)
    y = 0.5 + sum(c * np.roll(m, s) for c, s in ((0.3, 2), (1.0, 0), (0.2, -2))) + 0.01 * rng.normal(size=40)
    df = spark.createDataFrame([("a", i, float(y[i]), float(m[i])) for i in range(40)] + [("b", i, 1.0, 2.0) for i in range(5)], "u string, w int, y double, x double")
    got = {r.w: r.residual for r in market.expanded_residuals(df, "u", "w", "y", "x").collect()}
    at = np.arange(2, 38)
    design = np.column_stack([np.ones(36), *[m[at + k] for k in (-2, -1, 0, 1, 2)]])
    want = y[at] - design @ np.linalg.lstsq(design, y[at], rcond=None)[0]
    assert sorted(got) == at.tolist() and np.allclose([got[i] for i in at], want)


def test_out_of_sample():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    r = posture.out_of_sample(x, x + rng.normal(0, 0.02, x.shape))
    assert r["rand"] > 0.99 and min(r["jaccard"]) > 0.99 and r["n"] == 150


def test_files(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("a,b\n1, x \n2,\n")
    assert sorted((r.a, r.b) for r in files.from_csv(spark, str(p)).collect()) == [("1", "x"), ("2", None)]
    assert [tuple(r) for r in files.lexicon(spark, {"f": {"terms": ["t"], "country": "us"}}).collect()] == [("f", "t", '{"country": "us"}')]
    ran = []
    run = lambda: files.run_cached(spark, [str(p)], str(tmp_path / "mark"), lambda: ran.append(1))
    assert (run(), run()) == (True, False)
    p.write_text("a,b\n1,2\n")
    assert run() and len(ran) == 2
    files.write_results(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), str(tmp_path / "out"), ["k"])
    assert [r.v for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == ["a", "b"]


def test_console_and_presets(spark):
    assert console.run_sql(spark, "SELECT id AS limit_up FROM range(5000) -- no limit", 10)["n"] == 10
    spark.createDataFrame([("A", 2024, 5, 2, 0.1, 0.5, 1, 0), ("B", 2024, 9, 1, 0.2, 0.25, 0, 1)], "ticker string, year int, n_frames int, activities__n_activities int, w double, pct_substance double, proprietary_ai int, third_party_named_provider int").createOrReplaceTempView("fy")
    spark.createDataFrame([("x", 0.9, 3.0, 0.1, 0.2), (None, 0.1, 1.0, 0.0, 0.0)], "archetype string, archetype_stability double, n_frames double, promotional_posture double, risk_orientation double").createOrReplaceTempView("fi")
    spark.createDataFrame([("A", "10-K", "1", D(2024, 1, 1), 3, 1, 0, 1)], "ticker string, form string, accession_number string, fecha date, n_frames int, n_activities int, proprietary_ai int, named_product_or_process int").createOrReplaceTempView("doc")
    spark.createDataFrame([("A", "Acme"), ("B", "Acme"), ("B", "")], "ticker string, provider_family string").createOrReplaceTempView("act")
    views = {"firm_year": "fy", "firm": "fi", "document": "doc", "activity": "act"}
    got = {name: [tuple(r) for r in console.preset(spark, name, views).collect()] for name in console.PRESETS}
    assert got["largest_by_volume"][0] == ("B", 2024, 9, 1, 0.2, 0.25) and got["index_by_year"] == [(2024, 2, 0.15, 0.375, 7.0)]
    assert got["archetypes"] == [("x", 1, 0.9, 3.0, 0.1, 0.2)] and got["provider_families"] == [("Acme", 2, 2)] and len(got["largest_documents"]) == 1 and got["own_and_third_party"] == [(2024, 1.0, 1.0, 0.375)]
