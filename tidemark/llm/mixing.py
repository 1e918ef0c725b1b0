"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, all in DataFrame functions.

Sizes (words) give each source a target. A source's documents are dealt by hash into blocks, and its blocks are put in
a pseudo-random order for each pass over the source. A target of t words out of S takes whole passes while they fit and
then the first blocks of one more pass; the block in which the target falls is resolved document by document.

The taken blocks are then dealt to output shards. The tree's root holds each source's count of taken blocks; a node
gives its left half of the shards a draw without replacement of half of its blocks, family of sources by family, then
source by source (each count hypergeometric given those before), and the rest to the right half. The leaves are exact quotas that add up to what was
taken; each shard draws the next unused blocks of each source's order, and orders its documents by hash.

All random choices are hashes of a seed and of what is chosen, so reruns and retried tasks agree. What is held in one
task is a window over one source's blocks (BLOCKS over the whole corpus, and one more for each source) or over the documents of one
block, never over a source's documents.

Edge cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, ordered last;
equal rows are told apart only by order, so their counts are interchangeable; an empty table gives an empty mix; a text
of any length counts whole, and one longer than what is left of a target is taken if more than half of it fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Blocks over the whole corpus; a source has its share of them by words, rounded up.
BLOCKS = 2048
#: Output shards, a power of two, and the slices of a shard that are placed and ordered on their own.
SHARDS, SLICES = 16, 256
SEED = 20240601
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def _unit(*cols: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11).cast("double") / float(1 << 53)


def n_words(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_RUN))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target, n_blocks. sizes: source, size (one row per document, or partial sums).

    Sharing by weight with a ceiling and resharing the excess until none is above ends where every source has the lesser
    of its ceiling and lambda times its weight, so lambda follows from prefix sums in the order of ceiling / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy()  # rows here are sources, not documents
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("ceiling", MOST * F.col("source_size"))
    order = everything.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last())
    total = SHARE * F.sum("source_size").over(everything)
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # if all from here on were below their ceilings, lambda would be this; the first for which that holds sets it
    per = per.withColumn("lam", (total - before) / weight_left).withColumn("free", F.col("lam") * F.col("w") <= F.col("ceiling"))
    lam = F.min(F.when(F.col("free"), F.struct(F.col("ceiling") / F.col("w"), F.col("lam")))).over(everything)["lam"]
    target = F.least(F.col("ceiling"), F.coalesce(lam * F.col("w"), F.col("ceiling")))
    share = F.col("source_size") / F.greatest(F.sum("source_size").over(everything), F.lit(1))
    return per.select("source", "source_size", target.cast("double").alias("target"), F.ceil(BLOCKS * share).alias("n_blocks"))


def _draw(need: Column, pools: str, *key: Column | str) -> Column:
    """Hits per pool (an array) when `need` blocks are drawn without replacement from pools, an array of (name, quota).

    Pool by pool, the count given those before is hypergeometric; it is drawn place by place, each by its own hash of
    the key, the pool's name and the place, so a draw costs its count of blocks.
    """
    everything = F.aggregate(pools, F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    zero = F.struct(need.alias("need"), everything.alias("left"), F.array().cast("array<bigint>").alias("got"))

    def one(acc: Column, x: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("hit"), acc["left"].alias("pool"))
        # of the places still to fill, each goes to this pool with the odds of the blocks that remain
        places = F.when(acc["need"] > 0, F.sequence(F.lit(1).cast("long"), acc["need"])).otherwise(F.array().cast("array<bigint>"))
        done = F.aggregate(
            places, start,
            lambda s, i: F.struct(
                (s["hit"] + F.when(_unit(*key, x["name"], i) * s["pool"] < x["quota"] - s["hit"], 1).otherwise(0)).alias("hit"),
                (s["pool"] - 1).alias("pool"),
            ),
        )
        return F.struct((acc["need"] - done["hit"]).alias("need"), (acc["left"] - x["quota"]).alias("left"), F.concat(acc["got"], F.array(done["hit"])).alias("got"))

    return F.aggregate(pools, zero, one)["got"]


def split_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard, quota: the blocks of each source that each shard draws. quotas: source, quota (blocks taken).

    State is one row for each node and source. At each level a node draws its left half in two stages: first how many
    blocks come from each family of sources (about as many families as a family has sources, dealt by hash), then, family
    by family, how many from each source. The two together have the law of one draw over all sources, and no row ever
    holds more than about the square root of the sources.
    """
    families = F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy()))))
    family = F.pmod(F.xxhash64(F.lit(SEED), F.lit("family"), "source", F.col("source").isNull()), families)
    state = quotas.where("quota > 0").select(F.lit(0).alias("shard"), family.alias("family"), "source", F.col("quota").cast("long").alias("quota"))
    size = shards
    while size > 1:
        size //= 2
        per = state.groupBy("shard", "family").agg(F.sum("quota").alias("quota"), F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("none"), F.col("source").alias("name"), "quota"))).alias("sources"))
        per = cut(per)
        node = per.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(F.col("family").alias("name"), "quota"))).alias("families"))
        every = F.aggregate("families", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        half = F.floor((every + F.pmod(F.xxhash64(F.lit(SEED), "shard", F.lit(size)), F.lit(2))) / 2)
        node = node.select("shard", F.explode(F.arrays_zip(F.transform("families", lambda x: x["name"]).alias("family"), _draw(half, "families", F.lit("family"), F.col("shard"), F.lit(size)).alias("need"))).alias("x"))
        drawn = per.drop("quota").join(node.select("shard", "x.family", "x.need"), ["shard", "family"])
        drawn = drawn.withColumn("got", _draw(F.col("need"), "sources", F.col("shard"), F.lit(size)))
        each = drawn.select("shard", "family", F.explode(F.transform("sources", lambda x, i: F.struct(x["name"].alias("source"), x["quota"].alias("quota"), F.get("got", i).alias("got")))).alias("x"))
        sides = F.array(F.struct(F.col("shard").alias("shard"), F.col("x.got").alias("quota")), F.struct((F.col("shard") + size).alias("shard"), (F.col("x.quota") - F.col("x.got")).alias("quota")))
        state = each.select("family", F.col("x.source").alias("source"), F.explode(sides).alias("y")).select("y.shard", "family", "source", "y.quota").where("quota > 0")
    return state.select("source", "shard", "quota")


def deal(blocks: DataFrame, shards: int) -> DataFrame:
    """source, block, shards: the shards that the tree gives a block's draws to, pass by pass.

    blocks: source, block, passes, part. A draw is one pass over one block. A source's draws, in their own order, go to
    the shards by the tree's quotas, the next unused ones to each.
    """
    own = blocks.withColumn("n", (F.col("passes") + F.when(F.col("part") != 0, 1).otherwise(0)).cast("long")).where("n > 0")
    quotas = split_tree(own.groupBy("source").agg(F.sum("n").alias("quota")), shards)
    ends = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    bounds = quotas.select(F.col("source").alias("__s"), "shard", "quota", ends.alias("upto")).where("quota > 0")
    draws = own.select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("pass_"))
    draws = draws.withColumn("draw", F.row_number().over(Window.partitionBy("source").orderBy("pass_", _unit(F.lit("draw"), "source", "block", "pass_"), "block")))
    dealt = draws.join(bounds, F.col("source").eqNullSafe(F.col("__s")) & (F.col("draw") <= F.col("upto")) & (F.col("draw") > F.col("upto") - F.col("quota")))
    in_order = F.array_sort(F.collect_list(F.struct("pass_", "shard")))  # three at most
    return dealt.groupBy("source", "block").agg(F.transform(in_order, lambda x: x["shard"]).alias("shards"))


def _place(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (source, h and `some`: whether there is a word) with their source's size and target and their block."""
    right = small_side(per.withColumnRenamed("source", "__s"))
    placed = rows.join(right, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return placed.withColumn("block", F.when(F.col("some"), F.floor(F.col("h") * F.col("n_blocks")))).drop("n_blocks")


def _with_blocks(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """placed rows with part and shards of their block."""
    right = small_side(blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "part", "shards"))
    return placed.join(right, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left").drop("__s", "__b")


def _plan(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and targets of the sources, and what is taken of each block.

    rows: source, size, h and more, thin. Blocks: source, block, part (the words that a last, partial pass takes of this
    block; -1 for all, 0 for none) and shards (one for each draw of the block, the partial one last).
    """
    per = cut(targets(rows))
    docs = _place(rows.withColumn("some", F.col("size") > 0), per)
    blocks = docs.where("block is not null").groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(_unit(F.lit("order"), "source", "block"), "block")
    passes = F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(int(MOST)))
    blocks = blocks.withColumn("passes", passes).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    blocks = blocks.withColumn("__room", F.col("rest") - (F.sum("words").over(order) - F.col("words")))
    part = F.when(F.col("__room") >= F.col("words"), -1.0).when(F.col("__room") > 0, F.col("__room")).otherwise(0.0)
    blocks = cut(blocks.withColumn("part", part).select("source", "block", "passes", "part"))
    dealt = deal(blocks, shards).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "shards")
    blocks = blocks.join(dealt, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    return per, cut(blocks.select("source", "block", "part", "shards"))


def _cut_off(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """rows of blocks in which a target falls, with `less`: 0 while more than half of a document fits, then 1."""
    within = Window.partitionBy("source", "block").orderBy("h", *[F.col(c) for c in keep], "size")
    some = rows.where("part > 0")
    return some.withColumn("less", F.when(F.sum("size").over(within) - F.col("size") / 2 <= F.col("part"), 0).otherwise(1))


def _shards(less: Column) -> Column:
    got = F.coalesce("shards", F.array().cast("array<int>"))
    return F.slice(got, 1, F.size(got) - less)


def _thin(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    return cut(docs.select(*keep, F.col("source"), n_words(F.col("text")).alias("size"), _unit("doc_id", "text").alias("h")))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), shards: int = SHARDS) -> DataFrame:
    """Per document: keep, source, size, source_size, target, copies, shards (one for each copy) and h."""
    rows = _thin(docs, keep)
    per, blocks = _plan(rows, shards)
    out = _with_blocks(_place(rows.withColumn("some", F.col("size") > 0), per), blocks)
    out = out.where("part <= 0 or part is null").withColumn("less", F.lit(0)).unionByName(_cut_off(out, keep))
    out = out.withColumn("shards", _shards(F.col("less")))
    return out.select(*keep, "source", "size", "source_size", "target", F.size("shards").cast("long").alias("copies"), "shards", "h")


def mixture(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs' rows as often as they are taken, plus shard and position (order within the shard), ready to be written.

    Rows are placed by shard and by a slice of positions, and shuffled locally: each slice lies in one partition, in the
    order of its positions. Columns of docs that are named shard or position give way. Rows with the same doc_id and text
    share their draws.
    """
    names = [c for c in docs.columns if c not in ("shard", "position")]
    key = F.xxhash64("doc_id", "text")
    rows = _thin(docs.withColumn("__key", key), ["doc_id", "__key"])
    per, blocks = _plan(rows, shards)
    # what is taken of a document follows from its block alone, but for the one block of a source in which its target
    # falls; so texts meet the small table of blocks, and those few rows the verdicts on them, and move once, to their shard
    own = docs.select(F.struct(*names).alias("__doc"), "source", key.alias("__key"), _unit("doc_id", "text").alias("h"), (F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) != "").alias("some"))
    dealt = _with_blocks(_place(own, per), blocks).where(F.size("shards") > 0)
    verdicts = _cut_off(_with_blocks(_place(rows.withColumn("some", F.col("size") > 0), per), blocks), ["doc_id", "__key"])
    verdicts = verdicts.groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__k")).agg(F.min("less").alias("less"))
    unsure = dealt.where("part > 0").join(small_side(verdicts), F.col("__doc.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k"))).drop("__id", "__k")
    taken = dealt.where("part <= 0").withColumn("less", F.lit(0)).unionByName(unsure)
    at = taken.select("__doc", "h", F.posexplode(_shards(F.col("less"))).alias("__copy", "shard"))
    placed = at.select("__doc", "shard", _unit(F.lit("position"), "h", "__copy").alias("position"))
    slices = placed.repartition("shard", F.floor(F.col("position") * SLICES)).sortWithinPartitions("shard", "position")
    return slices.select("__doc.*", "shard", "position")
