"""The opN queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, licenses, mixing, pii, quality, secrets, simhash, toxicity
from .common import table


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    any_ = F.size("places") > 0
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.when(any_, F.array_min("places")).cast("long").alias("first_word"), F.when(any_, F.array_max("places")).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.col("score").cast("double").alias("score"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "d2")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(b: pa.RecordBatch) -> pa.RecordBatch:
        """What the formatted conversations and their masks say, read back from them."""
        got = []
        for formatted, starts, ends, loss in zip(*[b.column(c) for c in ("formatted", "starts", "ends", "loss")], strict=True):
            formatted = formatted.as_py()
            turns = chat.read_back(formatted)
            offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], 1)
            under = chat.masked_text(formatted, offsets, loss.values.to_numpy(zero_copy_only=False))
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            got.append((len(turns), digest, len(under), hashlib.sha256(under.encode()).hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chat.format_chats(rows.unionByName(own), public_tokenizers.path("byte_bpe_50k.tiktoken"), then=digests, schema=schema)


def op2_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.range_join(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", shards)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"), "n_live", "n_example")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id"])
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_embedding_join": op2_embedding_join,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_quality_rules": op8_quality_rules,
}
#: What an escaped string is longer: a doubled backslash each, two characters for each control string broken.
_ESCAPED = r"""(length({0}) + length({0}) - length(replace({0}, chr(92), '')) + 2 * coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) + 2 * len(regexp_extract_all({0}, '</?turn>')))"""
#: DuckDB twins where SQL can say what the query returns.
ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
        WITH said AS (SELECT chr(92) || '### Assistant: </turn> ok' AS t),
        rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
                 UNION ALL SELECT -7, 0, 'user', t FROM said UNION ALL SELECT -7, 1, 'assistant', t FROM said)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
            CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(19 + {_ESCAPED.format("role")} + {_ESCAPED.format("t")}) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op2_embedding_join": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
