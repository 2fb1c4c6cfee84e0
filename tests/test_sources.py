"""Readers of other formats, column discovery, and the scratch folder."""

import pytest
from pyspark.sql import functions as F

from quern.sources.scratch import discard, shared_dir, written
from quern.sources.tables import find_column, first_filled, read_csv, read_files, read_json


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "gb18030", "latin-1"])
def test_csv_in_any_encoding(spark, tmp_path, encoding):
    text = "名字,n\n高粱,1\nmais,2\n" if encoding != "latin-1" else "nom,n\nmaïs,1\nblé,2\n"
    (tmp_path / "a.csv").write_bytes((text + "too,many,fields\n").encode(encoding))
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns[0] in ("名字", "nom") and [r["n"] for r in got.orderBy("n").collect()] == ["1", "2"]


def test_csv_with_a_header_alone_is_an_empty_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "a.csv")).columns == ["a", "b"]


def test_json_and_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r["a"] for r in read_json(spark, str(tmp_path / "x" / "a.json")).collect()) == [1, 2]
    got = read_files(spark, str(tmp_path), "*.json").collect()
    assert len(got) == 1 and got[0]["length"] == 20 and len(got[0]["sha256"]) == 64


def test_columns_by_candidates(spark):
    df = spark.createDataFrame([(" ", "b", "nan"), (None, None, "c")], ["Source Title", "Kind", "Last"])
    assert find_column(df.columns, ["x", "SourceTitle"]) == "Source Title" and find_column(df.columns, ["x"]) is None and find_column(df.columns, ["x"], last=True) == "Last"
    assert [r["v"] for r in df.select(first_filled(df.columns, ["Last", "SourceTitle", "Kind"], "-").alias("v")).collect()] == ["b", "c"]


def test_scratch_tables(spark):
    t = written(spark.range(5))
    assert t.count() == 5
    discard(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        t.agg(F.sum("id")).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_a_folder_of_several_encodings(spark, tmp_path):
    from quern.sources.tables import read_mixed_csv

    (tmp_path / "a.csv").write_bytes("名字,n\n高粱,1\n\"two\nlines\",2\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes("n,名字,more\n3,maïs,x\n4,too,many,fields\n5,few\n".encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes("n\né\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes(b"")
    rows, bad = read_mixed_csv(spark, str(tmp_path))
    got = sorted((r["_file"][-5:], r["_encoding"], r["n"], r["名字"], r["more"]) for r in rows.collect())
    assert got == [("a.csv", "gb18030", "1", "高粱", None), ("a.csv", "gb18030", "2", "two\nlines", None), ("b.csv", "utf-8-sig", "3", "maïs", "x"), ("c.csv", "latin-1", "é", None, None)]
    assert sorted((r["_file"][-5:], r["line"], r["text"]) for r in bad.collect()) == [("b.csv", 3, "4,too,many,fields"), ("b.csv", 4, "5,few")]
