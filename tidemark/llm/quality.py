"""Quality rules: text statistics and a minimum-covariance-determinant outlier test, all in DataFrame functions.

Every document gets five statistics. Per (language, source) the robust centre and scatter of the transformed
statistics come from concentration steps: several starts (medians and quartile widths; rows picked by hash as centres),
each step keeping the H share of the rows with the least distance and estimating mean and covariance anew from them. After
TRIAL steps the start of the least determinant goes on until the determinant settles. A document is rejected when
its squared Mahalanobis distance exceeds the 1 - TAIL quantile of chi-square with five degrees of freedom.

Groups come in every size, down to one row, where no covariance can be had from the group alone. The estimate is
therefore the regularized one (minimum regularized covariance determinant): the corpus-wide estimate, found first in the
same way, weighs as much as PRIOR rows of the group. A variance under its floor is raised to it; statistics that are zero
in most documents (symbols, repeated lines) would otherwise make any document that has them an outlier.

The H share is exact: rows are summed by bands of distance, and the band in which the share ends enters with the
fraction that is missing. Per-row data never leave their partition: a step is one scan that shuffles one row of sums per
group, band and task (130 bands at most), so a group that holds a third of all rows costs what any other does.

Edge cases: a null text has no words and counts as empty; an empty text fails the base rules (under 50 words); a text may
be as long as a string can be, its words and windows are arrays of its row; null lang or source forms a group of its own;
equal rows get equal verdicts; an empty table gives no rows. Input columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_ROWS, cut, staged

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Share of a group's rows that the scatter is estimated from; rows that the corpus-wide estimate counts for.
H, PRIOR = 0.75, 60.0
#: Starts of a group, steps that all of them get, most steps after that, and the change of the log-determinant that ends them.
STARTS, TRIAL, STEPS, SETTLED = 3, 2, 30, 1e-3
#: Bands of squared distance per doubling, and the first and last of them; what is nearer or further is one band each.
BANDS, LOWEST, HIGHEST = 16, -53, 76
#: Share of good documents, were their statistics normal, that the test would reject.
TAIL = 1e-5
#: Least standard deviation of each transformed statistic.
FLOORS = {"f_words": 0.3, "f_wordlen": 0.05, "f_symbols": 0.12, "f_dup": 0.1, "f_repeat": 0.12}
FEATURES = list(FLOORS)
PAIRS = [(f, g) for i, f in enumerate(FEATURES) for g in FEATURES[: i + 1]]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, freedom: int) -> float:
    """Chi-square distribution function for odd degrees of freedom."""
    out, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, freedom + 1, 2):
        out, term = out - term, term * x / k
    return out


def chi2_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, freedom) < share else (low, middle)
    return high


#: Squared distance beyond which a document is an outlier, and what the covariance of the nearest H share is short by.
CUTOFF = chi2_quantile(1 - TAIL, len(FEATURES))
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, len(FEATURES)), len(FEATURES) + 2)


def window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def text_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in `keep` (default: all) plus COUNTS, n_lines and base_failed.

    A 3-word window's hash is packed with its position into one long (position in the low bits, as few as the text
    needs), so one primitive sort brings equal windows together and still tells where they are. Windows whose hash
    bits agree are then held against each other word by word; where that finds unlike windows under one hash (long
    texts leave few bits for it), those windows are compared as strings. The count is exact whatever the hash does.
    """
    keep = list(docs.columns) if keep is None else keep
    body = F.coalesce(F.col(text), F.lit(""))
    own = [F.col(c) for c in keep]
    # each step's columns are used more than once by the next, so Catalyst keeps the projections apart
    df = docs.select(
        *own,
        F.when(F.btrim(body, F.lit(SPACES)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(body, F.lit(SPACES)), SPACE_RUN)).alias("__w"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        (F.size(F.split(body, SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
    )
    shift = lambda f, a, b: F.call_function(f, a, b)  # noqa: E731  the count of bits is a column
    df = df.select(
        *own, "n_symbols", "__w",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__w").alias("__n"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.ceil(F.log2(F.size("__w") + F.lit(1.0))).cast("int").alias("__b"),
    )
    word = lambda p, k: F.get("__w", (p + k).cast("int"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 3),
        lambda i: shift("shiftleft", window_hash(word(i, 0), word(i, 1), word(i, 2)), F.col("__b")).bitwiseOR(i.cast("long")),
    )
    thin = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "__n", "__b", "__w"]
    df = df.select(*own, *thin, F.when(F.col("__n") >= 4, F.sort_array(windows)).alias("__s"))
    head = lambda x: shift("shiftright", x, F.col("__b"))
    place = lambda x: x.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1)
    alike = lambda x, y: F.coalesce(head(x) == head(y), F.lit(False))
    df = df.select(*own, *thin, F.filter("__s", lambda x, i: alike(F.get("__s", i - 1), x) | alike(F.get("__s", i + 1), x)).alias("__c"))
    agree = lambda p, q: (word(p, 0) == word(q, 0)) & (word(p, 1) == word(q, 1)) & (word(p, 2) == word(q, 2))
    clash = F.filter("__c", lambda x, i: alike(F.get("__c", i - 1), x) & ~agree(place(F.get("__c", i - 1)), place(x)))
    df = df.select(*own, *thin, "__c", F.array_distinct(F.transform(clash, head)).alias("__x"))
    clear = F.transform(F.filter("__c", lambda x: ~F.array_contains("__x", head(x))), place)
    unsure = F.transform(F.filter("__c", lambda x: F.array_contains("__x", head(x))), lambda x: F.struct(F.concat_ws(" ", word(place(x), 0), word(place(x), 1), word(place(x), 2)).alias("k"), place(x).alias("p")))
    df = df.select(*own, *thin, F.when(F.size("__x") <= 0, F.transform("__c", place)).otherwise(clear).alias("__p"), F.when(F.size("__x") > 0, F.sort_array(unsure)).alias("__u"))
    twin = lambda x, i: F.coalesce(F.get("__u", i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("__u", i + 1)["k"] == x["k"], F.lit(False))
    sure = F.coalesce(F.transform(F.filter("__u", twin), lambda x: x["p"]), F.array().cast("array<bigint>"))
    df = df.withColumn("__p", F.sort_array(F.concat("__p", sure)))
    step = F.transform("__p", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("__p", i + 1) - p, F.lit(3).cast("long"))))
    df = df.select(
        *own,
        F.col("__n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "f_words": F.log1p(F.col("n_words").cast("double")),
        "f_wordlen": F.log1p(F.col("word_chars") / n),
        "f_symbols": F.log1p(20.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        "f_dup": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "f_repeat": F.col("n_repeat_words") / n,
    })


def _group() -> Column:
    """(lang, source) as one name; to_json leaves nulls out, so they differ from every string."""
    return F.to_json(F.struct("lang", "source"))


def _starts(thin: DataFrame) -> DataFrame:
    """grp, start, m_*, c_*: medians or a row chosen by hash as centre, quartile widths (from fine histograms) as scatter."""
    cols = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.floor(F.col(f) * (20 / FLOORS[f])).alias("bin")) for f in FEATURES])).alias("x")
    h = thin.select("grp", cols).groupBy("grp", "x.f", "x.bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("grp", "f")
    h = h.withColumn("cum", F.sum("c").over(w.orderBy("bin")) / F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("cum") >= q, F.col("bin")))
    q = h.groupBy("grp", "f").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    middle = q.groupBy("grp").agg(
        *[((pick(f, "q2") + 0.5) * (FLOORS[f] / 20)).alias(f"m_{f}") for f in FEATURES],
        *[F.pow(F.greatest((pick(f, "q3") - pick(f, "q1")) * (FLOORS[f] / 20 / 1.349), F.lit(FLOORS[f])), F.lit(2.0)).alias(f"v_{f}") for f in FEATURES],
    )
    some = thin.groupBy("grp").agg(*[F.min_by(F.struct(*FEATURES), F.xxhash64(F.lit(k), *FEATURES)).alias(f"r{k}") for k in range(1, STARTS)])
    centres = F.array(F.struct(*[F.col(f"m_{f}").alias(f) for f in FEATURES]), *[F.col(f"r{k}") for k in range(1, STARTS)])
    each = middle.join(some, "grp").select("grp", F.posexplode(centres).alias("start", "m"), *[f"v_{f}" for f in FEATURES])
    return each.select("grp", "start", *[F.col(f"m.{f}").alias(f"m_{f}") for f in FEATURES], *[(F.col(f"v_{f}") if f == g else F.lit(0.0)).alias(f"c_{f}_{g}") for f, g in PAIRS])


def _factor(params: DataFrame) -> DataFrame:
    """Adds l_* (the Cholesky factor of c_*) and ld (the log of its determinant), each column from those before it."""
    steps = []
    for f, g in PAIRS:
        rest = " - ".join([f"c_{f}_{g}", *[f"l_{f}_{k} * l_{g}_{k}" for k in FEATURES[: FEATURES.index(g)]]])
        steps.append(f"sqrt(greatest({rest}, 1e-12D)) AS l_{f}_{g}" if f == g else f"({rest}) / l_{g}_{g} AS l_{f}_{g}")
    return params.selectExpr("*", *steps, f"2 * ({' + '.join(f'ln(l_{f}_{f})' for f in FEATURES)}) AS ld")


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, solving the triangular system by forward substitution; df carries its group's m_ and l_ columns."""
    solved = [f"({' - '.join([f'({f} - m_{f})', *[f'l_{f}_{g} * __z_{g}' for g in FEATURES[:i]]])}) / l_{f}_{f} AS __z_{f}" for i, f in enumerate(FEATURES)]
    return df.selectExpr("*", *solved, f"{' + '.join(f'__z_{f} * __z_{f}' for f in FEATURES)} AS d2").drop(*[f"__z_{f}" for f in FEATURES])


def _join(left: DataFrame, right: DataFrame, rows: int, how: str = "inner", keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Equi-join; right has `rows` rows at most and is broadcast if those are few."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, list(keys), how)


def _step(thin: DataFrame, params: DataFrame, rows: int, prior: dict[str, float] | None) -> DataFrame:
    """One concentration step of every (group, start) in params; `was` is the log-determinant before it."""
    par = params.select("grp", "start", "ld", *[c for c in params.columns if c[:2] in ("m_", "l_")])
    band = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(BANDS * F.log2(F.col("d2") + 1e-3))))
    near = _distance(_join(thin, par, rows)).withColumn("band", band)
    terms = {"n": "1.0D"} | {f"s_{f}": f for f in FEATURES} | {f"s_{f}_{g}": f"{f} * {g}" for f, g in PAIRS}
    bands = near.groupBy("grp", "start", "band").agg(F.max("ld").alias("was"), *[F.expr(f"sum({x}) AS {k}") for k, x in terms.items()])
    # the rows of a group up to the band's, less its own, are those that the bands before it take
    own, upto = "OVER (PARTITION BY grp, start)", "OVER (PARTITION BY grp, start ORDER BY band)"
    kept = bands.selectExpr("*", f"least(({H}D * sum(n) {own} - (sum(n) {upto} - n)) / n, 1.0D) AS w").where("w > 0")
    sums = kept.groupBy("grp", "start").agg(F.max("was").alias("was"), *[F.expr(f"sum(w * {k}) AS {k}") for k in terms])
    m = {f: f"s_{f} / n" for f in FEATURES}
    c = {(f, g): f"{CONSISTENCY!r}D * (s_{f}_{g} / n - s_{f} / n * s_{g} / n)" for f, g in PAIRS}
    share = f"({PRIOR}D / (n / {H}D + {PRIOR}D))"
    if prior is not None:
        m = {f: f"{share} * {prior[f'm_{f}']!r}D + (1 - {share}) * ({v})" for f, v in m.items()}
        c = {(f, g): f"{share} * {prior[f'c_{f}_{g}']!r}D + (1 - {share}) * ({v})" for (f, g), v in c.items()}
    c = {(f, g): f"greatest({v}, {FLOORS[f] ** 2!r}D)" if f == g else v for (f, g), v in c.items()}
    return _factor(sums.selectExpr("grp", "start", "was", *[f"{v} AS m_{f}" for f, v in m.items()], *[f"{v} AS c_{f}_{g}" for (f, g), v in c.items()]))


def _concentrate(thin: DataFrame, prior: dict[str, float] | None = None) -> DataFrame:
    """grp, m_*, c_*, l_*: the estimate of least determinant of each group. thin: grp and FEATURES."""
    params = cut(_factor(_starts(thin)))
    rows = params.count()
    for _ in range(TRIAL):
        params = cut(_step(thin, params, rows, prior))
    best = Window.partitionBy("grp").orderBy(F.round("ld", 6), "start")
    params = cut(params.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r"))
    for _ in range(STEPS):
        params = cut(_step(thin, params, rows, prior))
        change = params.agg(F.max(F.abs(F.col("ld") - F.col("was")))).first()[0]
        if change is None or change < SETTLED:
            break
    return params.drop("start", "was", "ld")


def mcd(stats: DataFrame) -> DataFrame:
    """Robust parameters per group: grp, m_*, c_*, l_*. stats: lang, source and FEATURES, cheap to scan again."""
    thin = stats.select(_group().alias("grp"), *FEATURES)
    whole = _concentrate(thin.withColumn("grp", F.lit("*"))).first()
    return _concentrate(thin, whole.asDict()) if whole is not None else _factor(_starts(thin))


def verdicts(stats: DataFrame, params: DataFrame) -> DataFrame:
    """stats (with features) plus d2 and kept."""
    right = params.select(F.col("grp").alias("__grp"), *[c for c in params.columns if c[:2] in ("m_", "l_")])
    joined = _join(stats.withColumn("__grp", _group()), right, params.count(), "left", ("__grp",))
    scored = _distance(joined).drop(*right.columns)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)))


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, COUNTS, n_lines, features, base_failed, d2, kept."""
    stats = cut(with_features(text_stats(docs, keep=["doc_id", "lang", "source"])))
    return verdicts(stats, mcd(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they are.

    Statistics are computed once and written beside their documents; the steps read their few columns alone, and the
    verdicts are then applied to that table in a scan, without a shuffle of texts.
    """
    own = docs.select(F.struct(*docs.columns).alias("__doc"), "lang", "source", "text")
    stats = staged(with_features(text_stats(own, keep=["__doc", "lang", "source"])).select("__doc", "lang", "source", "base_failed", *FEATURES))
    params = mcd(cut(stats.select("lang", "source", *FEATURES)))
    return verdicts(stats, params).where("kept").select("__doc.*")
