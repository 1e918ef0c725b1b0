"""A classifier on text signals with folds by key, and thresholds by F-beta."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def out_of_fold(df: DataFrame, key: str, label: str, features: Sequence[str], folds: int = 5, regularisation: float = 0.1) -> DataFrame:
    """key, label, fold and the probability from the model that has not seen the key's fold."""
    x = VectorAssembler(inputCols=list(features), outputCol="__raw").transform(df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")))
    out = None
    for f in range(folds):
        train, test = x.where(F.col("fold") != f), x.where(F.col("fold") == f)
        scaler = StandardScaler(inputCol="__raw", outputCol="features").fit(train)
        model = LogisticRegression(labelCol=label, regParam=regularisation, maxIter=30).fit(scaler.transform(train))
        p = model.transform(scaler.transform(test)).select(key, label, "fold", F.round(vector_to_array("probability")[1], 6).alias("probability"))
        out = p if out is None else out.unionByName(p)
    return out


def best_threshold(scored: DataFrame, label: str, probability: str, beta: float = 2.0) -> tuple[float, float]:
    """(threshold, F-beta) over the grid 0.05 to 0.95, from one aggregate."""
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    y = F.col(label) == 1
    aggs = [F.sum(y.cast("int")).alias("pos")]
    for i, t in enumerate(grid):
        hit = F.col(probability) >= t
        aggs += [F.sum((hit & y).cast("int")).alias(f"tp{i}"), F.sum(hit.cast("int")).alias(f"p{i}")]
    r = scored.agg(*aggs).first()
    score = [(1 + beta**2) * r[f"tp{i}"] / max(beta**2 * r.pos + r[f"p{i}"], 1) for i in range(len(grid))]
    best = max(range(len(grid)), key=lambda i: score[i])
    return grid[best], score[best]


#: Settings that are tried: (kind, strength of regularisation or depth of trees).
GRID = (("logistic", 1.0), ("logistic", 0.1), ("logistic", 0.01), ("trees", 3), ("trees", 4), ("trees", 6))


def _fold(df: DataFrame, group: str, folds: int, salt: str) -> DataFrame:
    return df.withColumn("__fold", F.pmod(F.xxhash64(F.lit(salt), group), F.lit(folds)).cast("int"))


def fit_model(df: DataFrame, label: str, features: Sequence[str], kind: str, setting: float, weight: str | None = None, rounds: int = 60) -> PipelineModel:
    """Assembler and classifier in one; trees are boosted, `setting` deep, with leaves of 40 rows or more."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="__raw")
    more = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        stages = [assemble, StandardScaler(inputCol="__raw", outputCol="features"), LogisticRegression(labelCol=label, regParam=float(setting), maxIter=50, **more)]
    else:
        stages = [assemble, GBTClassifier(labelCol=label, featuresCol="__raw", maxDepth=int(setting), maxIter=rounds, stepSize=0.06, minInstancesPerNode=40, seed=7, **more)]
    return Pipeline(stages=stages).fit(df)


def scored(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    extra = ["__raw", "features", "rawPrediction", "prediction", "probability"]
    out = model.transform(df).withColumn("__p", vector_to_array("probability")[1])
    return out.drop(*[c for c in extra if c in out.columns and c not in df.columns]).withColumnRenamed("__p", name)


def nested_cv(df: DataFrame, group: str, label: str, features: Sequence[str], outer: int = 5, inner: int = 3, grid: Sequence[tuple[str, float]] = GRID, weight: str | None = None, beta: float = 2.0) -> tuple[DataFrame, list[dict]]:
    """Every row scored by a model whose settings and threshold never saw its group, and what each outer fold chose.

    In each outer fold the inner folds score every setting out of fold; the best F-beta picks setting and threshold,
    and a model with that setting on all of the outer training rows scores the rest. All rows of a group share folds.
    """
    df = _fold(df, group, outer, "outer").withColumnRenamed("__fold", "__outer")
    out, chosen = None, []
    for k in range(outer):
        train, test = _fold(df.where(F.col("__outer") != k), group, inner, f"inner{k}"), df.where(F.col("__outer") == k)
        best = None
        for kind, setting in grid:
            parts = [scored(fit_model(train.where(F.col("__fold") != j), label, features, kind, setting, weight), train.where(F.col("__fold") == j)) for j in range(inner)]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            threshold, score = best_threshold(every, label, "probability", beta)
            if best is None or score > best["score"]:
                best = {"fold": k, "kind": kind, "setting": setting, "threshold": threshold, "score": score}
        chosen.append(best)
        final = scored(fit_model(train.drop("__fold"), label, features, best["kind"], best["setting"], weight), test)
        final = final.withColumn("predicted", F.col("probability") >= best["threshold"]).withColumnRenamed("__outer", "fold")
        out = final if out is None else out.unionByName(final)
    return out, chosen


def freeze(model: PipelineModel, path: str, threshold: float, features: Sequence[str], version: str) -> None:
    """Writes a model and what must go with it, so that it can be applied without being fitted again."""
    import json

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"threshold": threshold, "features": list(features), "version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def apply_frozen(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """df with predicted_proba, is_prefiltered, threshold and model_version; features that are missing are an error."""
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    missing = [f for f in meta["features"] if f not in df.columns]
    if missing:
        raise ValueError(f"the frozen model needs {missing}")
    out = scored(PipelineModel.load(f"{path}/model"), df, "predicted_proba")
    return out.withColumn("threshold", F.lit(meta["threshold"])).withColumn("is_prefiltered", F.col("predicted_proba") >= F.col("threshold")).withColumn("model_version", F.lit(meta["version"]))
