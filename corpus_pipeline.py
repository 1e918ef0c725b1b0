"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mixing, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before it kept.
run() writes each stage's rows as Parquet in the folder the session names in spark.checkpoint.dir and reads them back.

In every stage nulls may stand in any column, texts may be empty or very long, rows may repeat, the table may be empty, and
further columns (whatever their names) are left out of the result. What that means for a row is said with each stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, secrets, simhash
from tidemark.llm.common import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the outlier test reject.

    A null, empty or short text goes (under 50 words); null lang or source is a group like any other; repeated rows stay or
    go together.
    """
    return quality.keep_good(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group, the one with the smallest doc_id.

    Of several rows with that doc_id (repeated, or unlike in other columns) one stays, the same in every run; a null
    doc_id counts as larger than all; null and blank texts are one group.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; no document goes. A null text stays null; a null source is one owner."""
    return secrets.redact(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights.

    Texts without words are never taken; a null source is a source; repeated rows share their draws. Rows come out shard by
    shard, each shuffled locally.
    """
    return mixing.mixture(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's token ids and of what they decode to; a null text has no tokens."""
    rows = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_tokens", tokens),
]
#: XXH64, robust scatter and byte-pair merges are beyond DuckDB SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
