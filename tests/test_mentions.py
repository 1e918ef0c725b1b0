"""Lexicons with gates and owners, share classes, components and changes of results on small examples."""

from pyspark.sql import functions as F

from tidemark.operators import mentions as M
from tidemark.operators import statements as S

VENDORS = [
    {"family": "Acme", "ecosystem": "e", "country": "us", "vendor_type": "model", "vendor_ticker": "ACM", "terms": ["Acme", "acme cloud", "einstein"]},
    {"family": "Other", "ecosystem": "f", "country": "us", "vendor_type": "app", "terms": ["acme", "zed"]},
]


def test_mentions(spark):
    terms = M.lexicon_terms(VENDORS, ["Einstein"])
    assert list(terms) == ["acme", "acme cloud", "zed"] and terms["acme"]["family"] == "Acme"
    rows = [(1, 1, "We use ACME cloud and zed."), (1, 2, "zed alone; acmeist"), (2, 1, "zed with a crm"), (3, 1, None)]
    x = M.vendor_mentions(spark.createDataFrame(rows, "d int, p int, t string"), "t", terms, {"zed": ["crm", "cloud"]})
    assert sorted((r.d, r.p, r.term, r.family, r.context_gated) for r in x.collect()) == [(1, 1, "acme", "Acme", False), (1, 1, "acme cloud", "Acme", False), (1, 1, "zed", "Other", True), (2, 1, "zed", "Other", True)]
    docs = spark.createDataFrame([(1, "ACM"), (2, "XYZ"), (3, None)], "d int, ticker string")
    w = {r.d: r for r in M.vendor_wide(docs, x, "d", "p", "ticker", ["e", "f"], ["model"]).collect()}
    assert (w[1].n_vendor_paragraphs, w[1].n_vendor_self_paragraphs, w[1].vendor_stack_e, w[1].vendor_entsw_f, w[1].vendor_terms) == (1, 1, False, True, ["zed"])
    assert (w[2].n_vendor_paragraphs, w[3].n_vendor_paragraphs, w[3].vendor_terms) == (1, 0, [])


def test_statements(spark):
    f = spark.createDataFrame([(1, None, 10.0), (1, "a", 4.0), (2, "a", 4.0), (2, "b", 5.0), (3, "a", 4.0), (4, "a", 1.0), (4, "a", 2.0), (4, "b", 1.0)], "k int, m string, v double")
    assert sorted(map(tuple, S.class_sums(f, ["k"], "m", "v").collect())) == [(1, 10.0), (2, 9.0)]
    j = spark.createDataFrame([(1, '{"a": [1, 2], "b": ["x"]}'), (2, "broken"), (3, None), (4, '{"a": []}')], "k int, j string")
    assert [tuple(r) for r in S.column_arrays(j, "j", {"a": "int", "b": "string"}, ["k"]).collect()] == [(1, 0, 1, "x"), (1, 1, 2, None)]
    a = spark.createDataFrame([(1, 1.0, 0.001, 100), (2, 1.0, 0.2, 100), (3, 1.0, 0.2, 100)], "k int, e double, p double, n int")
    b = spark.createDataFrame([(1, -1.0, 0.02, 104), (2, 1.1, 0.2, 106), (4, 1.0, 0.2, 100)], "k int, e double, p double, n int")
    r = {x.k: x for x in S.result_changes(a, b, ["k"], "e", "p", "n").collect()}
    assert (r[1].sign_flip, r[1].bucket_change, r[1].n_change, r[1].effect_change) == (True, True, False, True)
    assert (r[2].sign_flip, r[2].bucket_change, r[2].n_change, r[2].effect_change) == (False, False, True, False)
    assert (r[3].membership, r[4].membership) == ("dropped", "added")


def test_posture(spark):
    f = spark.createDataFrame([(1, ["promotional"], ["risk_x"], ["a"], "realized", True), (1, None, None, None, None, None)], "k int, rhetoric array<string>, concepts array<string>, specificity array<string>, temporal string, is_customer_facing boolean")
    r = M.posture_rates(f, ["k"]).first()
    assert (r.promotional_posture, r.hedging_posture, r.risk_orientation, r.governance_orientation, r.temporal_posture, r.ai_positioning, r.n_posture_frames) == (0.25, 0, 0.5, 0, 0.5, 0.5, 2) and abs(r.specificity_rate - 0.1) < 1e-12
    w = S.winsorized(spark.range(101).select(F.col("id").cast("double").alias("v")), ["v"], 0.1).agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert tuple(w) == (10.0, 90.0, 101)
