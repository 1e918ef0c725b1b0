"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits are dealt to the 15 non-zero vectors of F_2^4. Each non-zero vector of F_2^4 then gives a
mask: the bits whose vector has inner product 1 with it. Three differing bits span at most three dimensions, so some
mask is orthogonal to all of them: every pair within radius 3 agrees on all the bits of at least one mask and meets in
that table. Masks hold 32 to 36 bits, so unrelated fingerprints seldom meet.

Only distinct fingerprints are compared (copies of a text cost nothing). A table's bucket of up to BUCKET fingerprints
is searched in one task and yields a spanning forest of its links, not its pairs. A larger bucket is refined exactly:
the bits outside its mask are cut into four blocks, and as three differing bits leave one block untouched, the bucket
splits into four families of smaller buckets that lose no pair.

Edge cases: a null or blank text has fingerprint zero, which links like any other; a null doc_id counts as larger than
all others (a component of such rows only has component_id null); repeated rows give repeated rows; other columns are
ignored; a text of any length is counted whole, CHUNK shingles at a time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected

RADIUS = 3
SEED = 42
BUCKET = 2048
#: Shingles whose bits are counted at once; bounds the memory that a long text takes.
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks() -> list[int]:
    masks = []
    for v in range(1, 16):
        bits = [i for i in range(64) if ((i % 15 + 1) & v).bit_count() & 1]
        masks.append(_signed(sum(1 << i for i in bits)))
    return masks


def finer_masks(mask: int) -> list[int]:
    free = [i for i in range(64) if not (mask >> i) & 1]
    return [_signed((mask & (1 << 64) - 1) | sum(1 << i for i in free[b :: RADIUS + 1])) for b in range(RADIUS + 1)]


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else iter([b" ".join(words)])
    total = max(1, len(words) - 2)
    counts = np.zeros(64, np.int64)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        h = np.fromiter(map(xxhash.xxh64_intdigest, (next(shingles) for _ in range(n)) if total > CHUNK else shingles, repeat(SEED)), np.uint64, n)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row (two hashes of the whole row, equal for repeated rows only) and fp (64 bits in a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(x) for x in b.column("b").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("r1"), b.column("r2"), fp], ["doc_id", "r1", "r2", "fp"])

    rows = docs.select("doc_id", *[h.alias(f"r{k}") for k, h in enumerate(_row(docs), 1)], F.col("text").cast("binary").alias("b"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, r1 long, r2 long, fp long")


def _row(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row that together tell rows apart; which columns are null counts too."""
    plain = [c if "map" not in t else F.map_entries(c) for c, t in docs.dtypes]
    return [F.xxhash64(F.lit(k), *plain, *[F.col(c).isNull() for c in docs.columns]) for k in (1, 2)]


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """(larger, smaller) links that join the same values as all pairs within the radius do."""
    out = []
    if len(values) == 2:
        a, b = int(values[0]), int(values[1])
        return [(max(a, b), min(a, b))] if ((a ^ b) & (1 << 64) - 1).bit_count() <= RADIUS else []
    left = np.asarray(values, np.int64)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= RADIUS
            if near.any():
                hit = left[near]
                out += [(max(int(x), int(y)), min(int(x), int(y))) for y in hit]
                queue += list(hit)
                left = left[~near]
    return out


def _links(lists: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("fps")
            values, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            found = [e for i in range(len(col)) for e in forest(values[offsets[i] : offsets[i + 1]])]
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return lists.select("fps").mapInArrow(run, "u long, v long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """u, v: spanning links between the distinct fingerprints (column fp) within the radius."""
    masks = covering_masks()
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    out = None
    while masks:
        keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"))
        sizes = keyed.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = cut(sizes)
        fit = keyed.join(sizes.where(F.col("n") <= bucket), ["mask", "val"]).groupBy("mask", "val").agg(F.collect_list("fp").alias("fps"))
        found = _links(fit)
        out = found if out is None else out.unionByName(found)
        big = sizes.where(F.col("n") > bucket).select("mask", "val")
        masks = [r.mask for r in big.select("mask").distinct().collect()]  # 15 at most, then four for each before
        if masks:
            finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(y) for y in finer_masks(m)]))])
            keyed = cut(keyed.join(big, ["mask", "val"]).select("fp", F.explode(finer[F.col("mask")]).alias("mask")))
    return out


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, r1, r2, fp, component_id (smallest doc_id reachable by links), keep (r1 and r2 of the row kept)."""
    rows = cut(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.struct("r1", "r2").alias("row"))).alias("first")
    nodes = cut(rows.groupBy("fp").agg(first))
    roots = connected(links(nodes.select("fp"), bucket))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = nodes.groupBy("root").agg(F.min("first").alias("head"))
    label = nodes.join(heads, "root").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("keep"))
    return rows.join(label, "fp").select("doc_id", "r1", "r2", "fp", "component_id", "keep")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: of those with the smallest doc_id the one whose row hash is least.

    Who stays is decided on thin rows; texts move once, by the hash of their row, which both finds the kept rows and
    brings repeated rows together.
    """
    heads = groups(docs).select("keep.*").distinct().select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"))
    keyed = docs.withColumns({f"__k{k}": h for k, h in enumerate(_row(docs), 1)})
    kept = keyed.join(heads, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left_semi")
    return kept.dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
