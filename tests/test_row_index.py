"""Row numbers run through all files of a table, as its SQL counts them."""

import os

import duckdb
import pytest

from tidemark.plans import registry

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"
NAME = "scan_with_row_index"


def check(spark, folder, files):
    got = registry.QUERIES[NAME](spark, str(folder))
    assert got.dtypes == [("doc_id", "bigint"), ("source_file", "string"), ("source_row", "bigint")]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    want = c.execute(registry.ORACLES[NAME]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    return want


def write(path, where, order="doc_id", groups=122880):
    duckdb.execute(f"COPY (SELECT * FROM '{DOCUMENTS}' WHERE {where} ORDER BY {order}) TO '{path}' (FORMAT parquet, ROW_GROUP_SIZE {groups})")


@pytest.mark.parametrize("names", [["part-0000", "part-0001", "part-0002"], ["part-2", "part-10", "part-1"], ["a b", "a!", "a+b", "a%20", "a", "a.b", "B", "a#c"]])
def test_files(spark, tmp_path, names):
    os.mkdir(tmp_path / "documents.parquet")
    for i, n in enumerate(names):
        write(tmp_path / "documents.parquet" / f"{n}.parquet", f"doc_id % {len(names)} = {i}", "doc_id DESC")
    want = check(spark, tmp_path, tmp_path / "documents.parquet" / "*.parquet")
    assert sorted(r[2] for r in want) == list(range(200))


def test_files_without_rows(spark, tmp_path):
    os.mkdir(tmp_path / "documents.parquet")
    for n, where in [("a", "false"), ("b", "doc_id < 50"), ("c", "false"), ("d", "doc_id >= 50")]:
        write(tmp_path / "documents.parquet" / f"{n}.parquet", where)
    assert len(check(spark, tmp_path, tmp_path / "documents.parquet" / "*.parquet")) == 200


def test_no_rows(spark, tmp_path):
    write(tmp_path / "documents.parquet", "false")
    assert check(spark, tmp_path, tmp_path / "documents.parquet") == []


def test_files_read_in_splits(spark, tmp_path):
    os.mkdir(tmp_path / "documents.parquet")
    for i in range(2):
        duckdb.execute(f"COPY (SELECT d.* REPLACE (doc_id + 200 * range AS doc_id) FROM '{DOCUMENTS}' d, range(40) WHERE doc_id % 2 = {i} ORDER BY hash(doc_id, range)) TO '{tmp_path}/documents.parquet/{i}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        assert spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() > 2
        assert len(check(spark, tmp_path, tmp_path / "documents.parquet" / "*.parquet")) == 8000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
