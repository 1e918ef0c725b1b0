"""Small tables from configuration files, results as files for people, and fingerprints of inputs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blanks as null; types are for the caller to say."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in df.columns])


def lexicon(spark: SparkSession, config: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """family, term, and what else a family states (as JSON), one row a term, from {family: {"terms": [...], ...}}."""
    rows = [(family, str(t), json.dumps({k: v for k, v in own.items() if k != "terms"}, sort_keys=True)) for family, own in config.items() for t in own.get("terms", [])]
    return spark.createDataFrame(rows, "family string, term string, more string")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, or YAML where a reader for it is installed."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs a YAML library; give the configuration as JSON") from e
    return yaml.safe_load(text)


def write_results(df: DataFrame, path: str, order: Sequence[str], kind: str = "csv") -> None:
    """A result for people: ordered, in one file, with a header (csv) or a line a row (json)."""
    out = df.orderBy(*order).coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash over the names, sizes and times of all files under the paths; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return listed.select(one.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("all")).first()["all"]


def run_cached(spark: SparkSession, inputs: Sequence[str], marker: str, stage: Callable[[], None]) -> bool:
    """Runs the stage unless the marker (a text path) holds the inputs' fingerprint; returns whether it ran."""
    now = fingerprint(spark, inputs)
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and [r.value for r in spark.read.text(marker).collect()] == [now]:
        return False
    stage()
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(marker)
    return True


def reconcile(outputs: DataFrame, units: DataFrame, text_key: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """After texts were cut anew: outputs under the units' new keys (one row a unit that has one), and the units without any.

    What was derived belongs to the text, not to its place, so it is carried over by the text's hash.
    """
    own = outputs.drop(*keys).dropDuplicates([text_key])
    return units.select(*keys, text_key).join(own, text_key), units.join(own.select(text_key), text_key, "left_anti")
