"""A layered table catalog on Parquet: checked atomic writes, run parts, manifests, drift-tolerant reads."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From narrow to wide; a column that differs between parts is read as the widest of its types, else as string.
WIDENING = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


@dataclass
class Table:
    path: str
    keys: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    additive: bool = False


@dataclass
class Catalog:
    """Dotted names to tables under a root that Spark can write."""

    spark: SparkSession
    root: str
    tables: dict[str, Table] = field(default_factory=dict)

    def add(self, name: str, keys: Sequence[str] = (), partitions: Sequence[str] = (), additive: bool = False) -> None:
        self.tables[name] = Table(f"{self.root}/{name.replace('.', '/')}", tuple(keys), tuple(partitions), additive)

    def scan(self, name: str) -> DataFrame:
        self._recover(self.tables[name].path)
        return self.spark.read.parquet(self.tables[name].path)

    def _recover(self, path: str) -> None:
        """Puts the version before back where a writer died after setting it aside and before its own was in place."""
        (p, fs), (q, _) = self._fs(path), self._fs(f"{path}.previous")
        if not fs.exists(p) and fs.exists(q):
            self._move(f"{path}.previous", path)

    def view(self, name: str) -> str:
        """Registers the table as layer__name."""
        view = name.replace(".", "__")
        self.scan(name).createOrReplaceTempView(view)
        return view

    def write(self, name: str, df: DataFrame, builder: str = "") -> dict:
        """Sorted, key-checked, written beside the target and moved into place; returns and stores its manifest."""
        t = self.tables[name]
        if t.additive:
            raise PermissionError(f"{name} is append-only")
        staged = f"{t.path}.partial-{uuid.uuid4().hex}"
        order = [F.col(k).asc_nulls_last() for k in t.keys]
        out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        writer = out.write.option("compression", "zstd")
        (writer.partitionBy(*t.partitions) if t.partitions else writer).parquet(staged)
        done = self.spark.read.parquet(staged)
        twice = done.groupBy(*t.keys).count().where("count > 1").limit(1).collect() if t.keys else []
        if twice:
            self._delete(staged)
            raise ValueError(f"{name}: key {twice[0].asDict()} is not unique")
        manifest = {"table": name, "rows": done.count(), "columns": done.columns, "keys": list(t.keys), "keys_unique": True, "builder": builder, "built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        # at every moment the table or the version before it is there, and _recover finds the latter
        self._recover(t.path)
        self._delete(f"{t.path}.previous")
        p, fs = self._fs(t.path)
        if fs.exists(p):
            self._move(t.path, f"{t.path}.previous")
        self._move(staged, t.path)
        self._delete(f"{t.path}.previous")
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{t.path}.manifest")
        return manifest

    def manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.tables[name].path}.manifest").first().value)

    def append_run(self, name: str, df: DataFrame, run_id: str) -> None:
        """A run's rows under their own partition; writing the same run again replaces it."""
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.tables[name].path)

    def overwrite_partition(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.tables[name].partitions).parquet(self.tables[name].path)

    def pending(self, population: DataFrame, done: str, key: str) -> DataFrame:
        """Rows of the population whose key the table does not have yet."""
        return population.join(self.scan(done).select(key), key, "left_anti")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _move(self, a: str, b: str) -> None:
        p, fs = self._fs(a)
        q, _ = self._fs(b)
        if not fs.rename(p, q):
            raise OSError(f"could not move {a} to {b}")


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns are null, differing types are widened (beyond numbers: to string)."""
    kinds: dict[str, str] = {}
    for df in frames:
        for c, t in df.dtypes:
            old = kinds.get(c, t)
            if "void" in (old, t):
                kinds[c] = t if old == "void" else old
            elif old != t:
                kinds[c] = max(old, t, key=WIDENING.index) if {old, t} <= set(WIDENING) else "string"
            else:
                kinds[c] = t
    out = None
    for df in frames:
        one = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def with_row_index(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with source_file and source_row (from 0), for total orders over files."""
    df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def with_table_row(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with source_row, from 0 through the whole table: its files in byte order of their paths, rows as they lie in a file."""
    df = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    # paths come percent-encoded, which sorts unlike the names themselves; a plus sign stands for itself
    name = F.url_decode(F.replace("__file", F.lit("+"), F.lit("%2B")))
    earlier = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    files = df.groupBy(file.alias("__file")).agg(F.count(F.lit(1)).alias("__n"))
    starts = files.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))  # one row a file
    rows = df.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row")).join(F.broadcast(starts), "__file")
    return rows.select(*df.columns, (F.col("__start") + F.col("__row")).alias("source_row"))


def compare_snapshots(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, effect: float) -> DataFrame:
    """state of each key: added, dropped, flipped (sign), changed (over `effect`, relative) or same."""
    a, b = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("__a")), after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("__b"))
    both = a.join(b, list(keys), "full")
    x, y = F.col("before"), F.col("after")
    moved = F.when(x != 0, F.abs(y - x) / F.abs(F.when(x != 0, x)) > effect).otherwise(y != 0)
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "dropped").when(x * y < 0, "flipped").when(moved, "changed").otherwise("same")
    return both.select(*keys, "before", "after", state.alias("state"))
