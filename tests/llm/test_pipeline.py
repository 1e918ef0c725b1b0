"""The pipeline against its stages' rules on the smallest table."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs, at = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert at[name].columns == columns
    good = {r.doc_id for r in quality.quality(start).where("kept").collect()}
    assert {r.doc_id for r in at["quality_rules"].collect()} == good
    heads = {r.component_id for r in simhash.groups(at["quality_rules"]).collect()}
    assert sorted(r.doc_id for r in at["simhash_near_dedup"].collect()) == sorted(heads)
    clean = {r.doc_id: r.text for r in at["secret_scan"].collect()}
    assert set(clean) == heads
    copies = {r.doc_id: r.copies for r in mixing.mix(at["secret_scan"]).collect()}
    mixed = Counter(r.doc_id for r in at["source_mix"].collect())
    assert mixed == Counter({k: v for k, v in copies.items() if v})
    ours = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    rows = at["bpe_tokens"].collect()
    assert Counter(r.doc_id for r in rows) == mixed
    for r in rows:
        ids = ours.encode_ordinary(clean[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
