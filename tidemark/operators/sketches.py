"""Bottom-k shingle sketches: exact candidates by shared sketch values, then similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .firms import checkpoint_dir, min_label

K, SHINGLE = 256, 5


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the smallest K hashes of the text's five-word shingles, ascending. Shorter texts have one shingle."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.select(key, words.alias("__w"))
    n = F.greatest(F.size("__w") - SHINGLE, F.lit(0))
    shingles = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.array_join(F.slice("__w", i + 1, SHINGLE), " ")))
    return df.select(key, F.slice(F.sort_array(F.array_distinct(shingles)), 1, K).alias("sketch"), F.size("__w").alias("n_words"))


def jaccard(s: str, t: str) -> Column:
    """Share of the K smallest values of two sketches' union that both hold; null if both are empty."""
    union = F.slice(F.array_sort(F.array_union(s, t)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(s, t))) / F.nullif(F.size(union), F.lit(0))


def sketch_pairs(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Pairs of different sketches with Jaccard similarity of at least `least`, by their smallest keys, and rows of each.

    Similarity is the share of the K smallest hashes of the union that both hold. Equal sketches are merged first, so
    copies make no pairs. Prefix filtering finds the candidates: the union's K smallest are no fewer than either sketch,
    so a pair shares least * n of the values of each, and, ordered by rarity, one of the first (1 - least) n + 1.
    """
    one = sketches(df, key, text).groupBy("sketch").agg(F.min(key).alias("a"), F.count(F.lit(1)).alias("rows"), F.max("n_words").alias("n_words")).where("n_words > 0").drop("n_words")
    keys = _prefixes(one.select("a", "sketch"), least)
    found = keys.join(keys.select("v", F.col("a").alias("b")), "v").where("a < b").select("a", "b").distinct()
    rows = one.select("a", F.col("rows").alias("rows_a"))
    both = _similar(found, one.select("a", "sketch"), least).join(rows, "a").join(rows.withColumnsRenamed({"a": "b", "rows_a": "rows_b"}), "b")
    return both.select("a", "b", "rows_a", "rows_b", F.round("similarity", 6).alias("similarity"))


def _prefixes(one: DataFrame, least: float) -> DataFrame:
    """v, a: the rarest values of each sketch, as many as prefix filtering needs; values of one sketch only are left out."""
    # the outer form: for the inner one a filter on the array's size is inferred and computes the sketch once more
    values = one.select("a", F.explode_outer("sketch").alias("v"))
    rare = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    prefix = F.size("o") - F.ceil(F.size("o") * least - 1e-9) + 1
    ordered = values.join(rare, "v").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("o"))
    return ordered.select("a", F.explode(F.slice("o", 1, prefix.cast("int"))).alias("x")).where("x.n > 1").select(F.col("x.v").alias("v"), "a")


def _similar(found: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of found that are similar, with their similarity."""
    both = found.join(one.select("a", F.col("sketch").alias("s")), "a").join(one.select(F.col("a").alias("b"), F.col("sketch").alias("t")), "b")
    return both.withColumn("similarity", jaccard("s", "t")).where(F.col("similarity") >= least).select("a", "b", "similarity")


def sketch_classes(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """key and class (the smallest key of its class) of every row: the classes that sketch_pairs' pairs and equal sketches link.

    A value's first sketch is compared with the others that have it; after that, only pairs of sketches that are not in
    one class yet. No pair that could join two classes is left out, and a large group of near copies is not squared.
    A text without words is a class of its own.
    """
    checkpoint_dir(df.sparkSession)
    every = sketches(df.select(F.col(key).alias("key"), text), "key", text).checkpoint()
    # equal sketches by a 256-bit hash: rows then find their sketch again without carrying it
    named = every.withColumn("h", F.when(F.col("n_words") > 0, F.sha2(F.array_join(F.col("sketch").cast("array<string>"), ","), 256)))
    one = named.where("h IS NOT NULL").groupBy("h").agg(F.first("sketch").alias("sketch")).withColumn("a", F.monotonically_increasing_id()).checkpoint()
    keys = _prefixes(one.select("a", "sketch"), least).checkpoint()
    nodes = one.select(F.col("a").alias("key"))
    star = keys.join(keys.groupBy("v").agg(F.min("a").alias("b")), "v").where("a > b").select("a", "b").distinct()
    linked = _similar(star, one, least).select(F.col("a").alias("u"), F.col("b").alias("v")).checkpoint()
    labels = min_label(nodes, linked)
    known = keys.join(labels.select(F.col("key").alias("a"), F.col("group").alias("g")), "a")
    mixed = known.groupBy("v").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("v")
    known = known.join(mixed, "v")
    apart = known.join(known.select("v", F.col("a").alias("b"), F.col("g").alias("k")), "v").where("a < b AND g != k").select("a", "b").distinct()
    more = _similar(apart, one, least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = min_label(nodes, linked.unionByName(more)).withColumnRenamed("key", "a")
    member = named.select("key", "h").join(one.select("h", "a").join(labels, "a").select("h", "group"), "h", "left")
    least_key = member.where("group IS NOT NULL").groupBy("group").agg(F.min("key").alias("class"))
    return member.join(least_key, "group", "left").select(F.col("key").alias(key), F.coalesce("class", "key").alias("class"))
