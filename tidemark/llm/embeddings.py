"""Exact metric range join of embeddings: which vectors of a label lie within a cosine of each other.

On unit vectors cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). Equal vectors are merged first. A label's
vectors are dealt to cells by their nearest pivot, about CELL to a cell. A vector within r of another whose nearest
pivot is p lies, by the triangle inequality, at most 2r farther from p than from its own nearest pivot, so it is
also sent (as a guest) to each such cell. Then every vector meets all its partners in its home cell, and cells are joined
independently: partners' distances to the pivot differ by at most r, so a band of distances is compared with itself and
its two neighbours only. A comparison counts its home vectors' links and emits a spanning forest of them, never its
pairs.

A cell with more than CELL home vectors is divided again by pivots of its own, guests included, as long as that helps.
What a cell holds then is cut into chunks by distance to the pivot; chunks of near enough distances are compared two
by two, so no task ever holds a cell, however many vectors crowd around one spot.

In d dimensions the 2r rule prunes well only where vectors cluster; vectors spread evenly in many dimensions have
almost equal distances to all pivots and are then sent to many cells. The result stays exact. A second bound of the
Euclidean metric, the distance to the plane half-way between two pivots, is used beside the first: it never loses a
partner either and sends fewer guests.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components, and rows without a label,
link with nothing and are kept as components of their own; vectors of different lengths do not link; repeated rows and
equal vectors are vectors of their own that link with each other; a null vec_id is never a component's id unless the
component holds no other; other columns are ignored; vectors may have any length; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side
from .components import connected

COSINE = 0.98
#: Home vectors that a cell aims at; pivots of one division; divisions at most; vectors of a chunk.
CELL, PIVOTS, LEVELS, CHUNK = 4096, 256, 4, 1024
#: Slack on distances, over what rounding can do (near cosine 1 the square root turns 1e-16 into 1e-8); it only sends a
#: few more guests.
SLACK = 1e-6
#: Chunks of a band that one task compares with each of the chunks near them.
DEAL = 8


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """rep (a name), label, vec, n (rows), vec_id (the smallest): one row per distinct vector that can link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.coalesce(usable, F.lit(False)))
    own = cut(rows.groupBy("label", F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n")))
    return own.withColumn("rep", F.monotonically_increasing_id())  # over checkpointed partitions: the same each time


def _deal(members: DataFrame, radius: float) -> DataFrame:
    """Each node's members dealt to the cells of its pivots: node, rep, n, vec, home, dist, whole (home vectors before)."""
    sizes = members.groupBy("node").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
    sizes = cut(sizes.withColumn("k", F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.ceil(F.col("homes") / CELL)))))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("deal"), "node", "rep"), 11) / float(1 << 53)
    keyed = members.join(sizes, "node").withColumn("u", u)
    # a thin random slice first, so that the window sorts a few times k rows, not a node
    slice_ = keyed.where("home").where(F.col("u") * F.col("homes") < 4 * F.col("k") + 40)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("u", "rep"))
    pivots = slice_.withColumn("r", rank).where("r <= k").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "vec")))["vec"].alias("pivots"))
    salt = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit("salt"), "rep"), 11) / float(1 << 53) * F.ceil(F.col("all") / CHUNK))
    parts = keyed.groupBy("node", salt.alias("salt"), "homes").agg(F.collect_list("rep").alias("reps"), F.collect_list("n").alias("ns"), F.collect_list("home").alias("homes_"), F.collect_list("vec").alias("vecs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(n)[i] for n in b.schema.names}
                vecs = row["vecs"].values
                x, p = _rows(vecs), _rows(row["pivots"].values)
                x, p = x / np.linalg.norm(x, axis=1, keepdims=True), p / np.linalg.norm(p, axis=1, keepdims=True)
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                near = d.argmin(1)
                least = d[np.arange(len(d)), near][:, None]
                home = np.array(row["homes_"].as_py(), bool)
                goes = (d <= least + 2 * radius + SLACK) & (d * d - least * least <= 2 * (radius + SLACK) * between[near] + SLACK)
                goes[np.arange(len(d)), near] = True
                who, cell = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{row['node'].as_py()}/{c}" for c in cell.tolist()], pa.string()), row["reps"].values.take(pa.array(who)), row["ns"].values.take(pa.array(who)), vecs.take(pa.array(who)),
                    pa.array(home[who] & (near[who] == cell)), pa.array(d[who, cell]), pa.array(np.full(len(who), row["homes"].as_py()), pa.int64()),
                ], ["node", "rep", "n", "vec", "home", "dist", "whole"])

    kind = members.schema["vec"].dataType.simpleString()
    return parts.join(pivots, "node").mapInArrow(run, f"node string, rep long, n long, vec {kind}, home boolean, dist double, whole long")


def _rows(vecs: pa.Array) -> np.ndarray:
    """A list<float> array whose lists have one length, as a matrix in double precision."""
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)


def cells(reps: DataFrame, radius: float) -> DataFrame:
    """Members of the final cells: node, rep, n, vec, home, dist."""
    node = F.concat_ws(":", F.col("label").cast("string"), F.size("vec").cast("string"))
    members, done = reps.select(node.alias("node"), "rep", "n", "vec", F.lit(True).alias("home")), None
    for level in range(LEVELS):
        dealt = cut(_deal(members, radius))
        big = dealt.groupBy("node", "whole").agg(F.sum(F.col("home").cast("long")).alias("homes")).where((F.col("homes") > CELL) & (F.col("homes") < 0.7 * F.col("whole"))).select("node")
        last = level + 1 == LEVELS or big.isEmpty()
        fits = dealt if last else dealt.join(big, "node", "left_anti")
        fits = fits.select("node", "rep", "n", "vec", "home", "dist")
        done = fits if done is None else done.unionByName(fits)
        if last:
            return done
        members = dealt.join(big, "node", "left_semi").select("node", "rep", "n", "vec", "home")


def spanning(mask: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that join the same rows and columns as all of mask does: rounds of one link per component."""
    rows, columns = mask.shape
    comp = np.arange(rows + columns)
    out: list[tuple[int, int]] = []
    left = mask.copy()
    while left.any():
        r = np.flatnonzero(left.any(1))
        c = left[r].argmax(1)
        for i, j in zip(r.tolist(), c.tolist(), strict=True):
            a, b = int(comp[i]), int(comp[rows + j])
            if a != b:
                comp[comp == b] = a
                out.append((i, j))
        left &= comp[:rows, None] != comp[None, rows:]
    return out


def links(members: DataFrame, cosine: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """(rep, deg: rows linked, itself excluded, per chunk pair) and (u, v: spanning links between reps, u > v)."""
    band = members.withColumn("band", F.floor(F.col("dist") / (radius + SLACK)))
    sizes = cut(band.groupBy("node", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("m")))
    sub = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit("sub"), "rep"), 11) / float(1 << 53) * F.col("m"))
    # dealt by chunk, not by band, so a band that holds many vectors spreads over tasks
    dealt = band.join(small_side(sizes), ["node", "band"]).withColumn("sub", sub).repartition("node", "band", "sub")
    chunks = dealt.groupBy("node", "band", "sub").agg(
        F.collect_list("rep").alias("rep"), F.collect_list("n").alias("n"), F.collect_list("home").alias("home"), F.collect_list("vec").alias("vec"))
    chunks = cut(chunks.withColumn("part", F.floor(F.col("sub") / DEAL)))
    left = chunks.where(F.array_contains("home", True)).select("node", *[F.col(c).alias(f"a_{c}") for c in ("band", "rep", "n", "home", "vec")])
    left = left.withColumn("band", F.explode(F.sequence(F.col("a_band") - 1, F.col("a_band") + 1)))
    # a chunk goes to each part of the bands near it; a part is DEAL chunks, so pairs of one hot band are dealt out too
    parts = sizes.select("node", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / DEAL))).alias("part"))
    pairs = left.join(small_side(parts), ["node", "band"]).join(chunks, ["node", "band", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "deg", "u", "v"]
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(n)[i] for n in b.schema.names}
                home = np.flatnonzero(np.array(row["a_home"].as_py(), bool))
                x, y = _rows(row["a_vec"].values)[home], _rows(row["vec"].values)
                rx, ry = (row[k].values.to_numpy() for k in ("a_rep", "rep"))
                rx, n = rx[home], row["n"].values.to_numpy()
                mask = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]) >= cosine
                mask &= rx[:, None] != ry[None]
                deg = mask @ n
                some = np.flatnonzero(deg)
                edges = [(int(rx[i]), int(ry[j])) for i, j in spanning(mask)]
                rep, value = [*rx[some].tolist(), *[None] * len(edges)], [*deg[some].tolist(), *[None] * len(edges)]
                u, v = ([None] * len(some) + [f(e) for e in edges] for f in (max, min))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rep, value, u, v)], names)

    found = cut(pairs.mapInArrow(run, "rep long, deg long, u long, v long"))
    return found.where("rep is not null").select("rep", "deg"), found.where("u is not null").select("u", "v")


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    radius = float(np.sqrt(2 - 2 * cosine))
    vectors = vectors.select("vec_id", "embedding", "label")
    reps = distinct_vectors(vectors)
    degrees, edges = links(cells(reps, radius), cosine, radius)
    roots = connected(edges)
    named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    heads = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    per = named.join(degrees.groupBy("rep").agg(F.sum("deg").alias("deg")), "rep", "left").join(heads, "root")
    per = per.select(F.col("label").alias("__l"), F.col("vec").alias("__v"), (F.coalesce("deg", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("__in"))
    out = vectors.join(per, (F.col("label") == F.col("__l")) & (F.col("embedding") == F.col("__v")), "left")
    component = F.when(F.col("__in"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
