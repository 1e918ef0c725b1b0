"""The pipeline on awkward rows, against the stages' plain versions one after the other."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from test_contracts import SCHEMA, components, fingerprint, stats, texts
from test_long_secrets import plain_spans, planted

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality, secrets


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "a"]), len(t or ""), "x", 1, "y", "z", 3, "t", 9) for i, t in enumerate(texts())]
    prose = [r[1] for r in rows[:25]]
    rows += [(100 + i, f"{rng.choice(prose)} {i}\n{planted(rng, i % 9)[0]}\n{rng.choice(prose)}", "en", rng.choice("abcd"), None, "x", 1, "y", "z", 3, "t", 9) for i in range(40)]
    rows += [rows[0], rows[0], (1, rows[1][1], "de", "other", 5, "x", 1, "y", "z", 3, "t", 9), (None, None, None, None, None, None, None, None, None, None, None, None), (None, rows[7][1], "en", "b", 3, "x", 1, "y", "z", 3, "t", 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    verdict = {(r.doc_id, r.lang, r.source): r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    good = []
    for r in rows:
        v = verdict[r[0], r[2], r[3]]
        assert v.base_failed == stats(r[1])[5]
        good += [r[:5]] if v.kept else []
    assert len(good) > 40
    fps = [fingerprint(r[1]) for r in good]
    comp = components(range(len(good)), [(a, b) for a, b in itertools.combinations(range(len(good)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    members = {}
    for i, r in enumerate(good):
        members.setdefault(comp[i], []).append(r)
    ids = [min((r[0] for r in own if r[0] is not None), default=None) for own in members.values()]
    single = []
    for head, own in zip(ids, members.values(), strict=True):
        single.append([r for r in own if r[0] == head])
    stage = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long"), "")
    kept = [tuple(r) for r in stage.collect()]
    assert len(kept) == len(single) and all(any(r in own for r in kept) for own in single)
    spans = dict(plain_spans([(i, r[1], r[3]) for i, r in enumerate(kept)]))
    clean = []
    for i, r in enumerate(kept):
        marks = [tuple(x.rsplit(":", 2)) for x in spans[i].split(",") if x]
        text = secrets.blank_out(r[1], [(int(a), int(b), k) for k, a, b in marks])
        clean.append((r[0], text, r[2], r[3], len(text)))
    df = spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
    redacted = [tuple(r) for r in corpus_pipeline.secret_scan(spark, spark.createDataFrame(kept, df.schema), "").collect()]
    assert sorted(redacted, key=repr) == sorted(clean, key=repr)
    ours = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.tokenizer(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    copies = {(r.doc_id, r.key): r.copies for r in mixing.mix(df.withColumn("key", df.text), keep=("doc_id", "key")).collect()}
    want = Counter()
    for i, text, *_ in clean:
        e = ours.encode_ordinary(text)
        row = (i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want[row] += copies[i, text]
    assert got == +want


def test_empty_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([(1, "one two three " * 40, "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df.selectExpr("*", "1 AS kept", "'x' AS shard", "2 AS grp", "3 AS r1", "4 AS th", "5 AS waits", "6 AS d2"), "")
        assert out.columns == df.columns, name
        out.collect()
