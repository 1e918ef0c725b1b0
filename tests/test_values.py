"""Values of the queries that have no SQL, and of functions without a query, against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import hashing
from tidemark.operators import models, prefilter, sampling, windows
from tidemark.plans import registry
from tidemark.sources import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t():
    return {n: pd.read_parquet(f"{SF}/{n}.parquet") for n in ("orders", "customer", "labels", "documents", "pages")}


def test_matched_controls(spark, t):
    o = t["orders"].groupby("o_custkey").agg(v=("o_totalprice", "sum"), n=("o_orderkey", "size")).reset_index()
    c = t["customer"].merge(o, left_on="c_custkey", right_on="o_custkey")
    f = ["v", "n", "c_acctbal"]
    treated, pool = c[c.c_custkey.isin([1, 2, 4, 5, 7])], c[~c.c_custkey.isin([1, 2, 4, 5, 7])].dropna(subset=f)
    inverse = np.linalg.pinv(np.cov(pool[f].to_numpy(float).T) + np.eye(3) * 1e-6)
    want = []
    for _, x in treated.iterrows():
        p = pool[pool.c_nationkey == x.c_nationkey]
        d = p[f].to_numpy(float) - x[f].to_numpy(float)
        near = sorted(zip(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0)), p.c_custkey))[:3]
        want += [(int(x.c_custkey), int(k), round(float(v), 4)) for v, k in near]
    got = registry.QUERIES["matched_controls"](spark, SF).collect()
    assert sorted((r.treated, r.control, round(r.distance, 4)) for r in got) == sorted(want)


def test_archetypes_are_shares(spark):
    got = registry.QUERIES["archetypal_analysis"](spark, SF).collect()
    again = registry.QUERIES["archetypal_analysis"](spark, SF).collect()
    assert got == again and all(abs(r.a1 + r.a2 + r.a3 - 1) < 1e-3 and min(r.a1, r.a2, r.a3) >= 0 for r in got)
    assert all(max(r[f"a{i}"] for r in got) > 0.95 for i in (1, 2, 3))  # every extreme is close to some nation


def test_bootstrap(spark, t):
    c = t["customer"]
    named = sorted(c.c_nationkey.unique())
    want = {}
    for r in range(5):
        drawn = [named[int(hashlib.sha256(f"b1|{r}|{j}".encode()).hexdigest()[:12], 16) % len(named)] for j in range(len(named))]
        rows = pd.concat([c[c.c_nationkey == k] for k in drawn])
        want[r] = (len(rows), round(rows.c_acctbal.mean(), 4))
    got = {r.replicate: (r.n, r["mean"]) for r in registry.QUERIES["bootstrap_cluster"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_its_query(spark, t):
    o = t["orders"]
    m = o.o_orderdate.dt.year * 12 + o.o_orderdate.dt.month - 1
    g = o.groupby(m).o_totalprice.agg(["mean", "size"])
    series = [(int(i), float(a), float(n)) for i, (a, n) in zip(g.index, g.to_numpy(), strict=True)]
    got = registry.QUERIES["its_hac"](spark, SF).collect()
    assert got and sum(r.best_fit for r in got) == 1
    for r in got:
        want = models.interrupted(series, r.event)
        assert abs(r.step - want["step"]) < 1e-3 * (1 + abs(want["step"])) and abs(r.se_step - want["se_step"]) < 1e-3 * (1 + want["se_step"])


def test_prefilter_query(spark, t):
    got = registry.QUERIES["prefilter_train"](spark, SF).collect()
    known = t["labels"][t["labels"].doc_id.isin(t["documents"].doc_id)]
    assert sorted(r.doc_id for r in got) == sorted(known.doc_id)
    good, bad = ([r.probability for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.6


def test_pages(spark, t):
    got = registry.QUERIES["parse_pages"](spark, SF).collect()
    assert Counter(r.page_id for r in got).keys() <= set(t["pages"].page_id) and len(got) > 0
    assert not any("<script" in str(v) or "<p>" in str(v) for r in got for v in r)


def test_nested_cv_and_frozen(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)  # trees can tell, a line cannot
    df = spark.createDataFrame([(i, i // 3, float(a), float(b), int(v), 1.0) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "id int, g int, a double, b double, y int, w double").repartition(2).cache()
    grid = (("logistic", 0.1), ("trees", 3))
    scored, chosen = prefilter.nested_cv(df, "g", "y", ["a", "b"], 2, 2, grid, "w")
    rows = scored.collect()
    assert len({r.id for r in rows}) == 1200 and {c["kind"] for c in chosen} == {"trees"} and len({(r.g, r.fold) for r in rows}) == 400
    assert np.mean([r.predicted == bool(r.y) for r in rows]) > 0.85
    model = prefilter.fit_model(df, "y", ["a", "b"], "trees", 3, rounds=20)
    prefilter.freeze(model, str(tmp_path / "m"), 0.4, ["a", "b"], "v1")
    a = {r.id: r.predicted_proba for r in prefilter.apply_frozen(spark, str(tmp_path / "m"), df).collect()}
    b = {r.id: r.p for r in prefilter.scored(model, df, "p").collect()}
    assert a == b
    with pytest.raises(ValueError, match="needs"):
        prefilter.apply_frozen(spark, str(tmp_path / "m"), df.drop("b"))


def test_seeded_orders_and_last(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "k int, s string")
    got = {r.k for r in sampling.stratified(df, ["s"], "k", 5, "x", hashing.seeded8).collect()}
    order = lambda k: hashlib.blake2b(f"{k}|x".encode(), digest_size=8).hexdigest()
    assert got == {*sorted(range(0, 40, 2), key=order)[:5], *sorted(range(1, 40, 2), key=order)[:5]}
    assert sorted(r.k for r in windows.keep_last(df, ["s"], [df.k]).collect()) == [38, 39]
    d = spark.createDataFrame([("8-K", "text"), ("10-K", "x"), ("6-K", " ")], "form string, body string")
    assert [tuple(r) for r in documents.whole_documents(d, "form", "body").collect()] == [("8-K", "8K_FULL", "text")]


def test_forms_of_correlation(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(i % 5), int(i), float(v), float(2 * v + rng.normal())) for i, v in enumerate(rng.normal(size=100))], "g int, t int, a double, b double")
    r = models.correlations(df, "a", "b", "g", "t")
    assert r["pooled"]["r"] > 0.8 and r["pooled"]["p"] < 1e-6 and r["difference"]["n"] == 95 and r["within"]["p"] < 1e-6
    v = models.variance_inflation(df, ["a", "b"])
    assert abs(v["a"] - 1 / (1 - r["pooled"]["r"] ** 2)) < 1e-6
    m = models.fit(df, "b", ["a"])
    assert abs(models.restriction(m, np.array([[0.0, 1.0]])) - models.wald(m, ["a"])) < 1e-9 and models.restriction(m, np.array([[0.0, 1.0]]), np.array([m["coef"][1]])) < 1e-12
