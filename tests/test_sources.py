import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.session import materialize, small_side
from plumbline.sources import fingerprint, readers, writers


def test_read_table_and_any(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.read_table(spark, f"{tmp_path}/t.csv").dtypes == [("a", "int"), ("b", "string")]
    assert readers.read_any(spark, f"{tmp_path}/t.csv", "a long, b string").dtypes[0] == ("a", "bigint")
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_table(spark, f"{tmp_path}/empty.csv")
    with pytest.raises(Exception):
        readers.read_table(spark, f"{tmp_path}/absent.csv")
    with pytest.raises(ValueError, match="no reader"):
        readers.read_any(spark, f"{tmp_path}/t.xlsx")


def test_discovery_order(spark, tmp_path):
    for p in ("raw/dataset.csv", "raw/deep/dataset.csv", "processed/x.csv", "reports/dataset.csv", "other/note.txt"):
        f = tmp_path / "w" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("a\n1\n")
    got = [r.path.split("/w/")[1] for r in readers.discover_datasets(spark, f"{tmp_path}/w").orderBy("rank").collect()]
    assert got == ["raw/dataset.csv", "raw/deep/dataset.csv", "processed/x.csv"]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    want = hashlib.sha256(b"a,b\n1,x\n").hexdigest()
    assert fingerprint.file_fingerprint(spark, f"{tmp_path}/t.csv", want).first().matches
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "x int, y int")
    h = lambda df: fingerprint.content_fingerprint(df).first().content_hash
    assert h(a) == h(a.orderBy(F.desc("x")))
    assert h(a) != h(spark.createDataFrame([(1, None), (1, None), (2, 2)], "x int, y int"))
    assert h(a) != h(a.select("x", F.col("y").cast("long").alias("y")))
    assert h(a) != h(a.unionByName(a))


def test_json_report(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], {"k": float("-inf")})],
                               "i int, x double, a array<double>, m map<string,double>").withColumn("s", F.struct("x", "i"))
    assert json.loads(writers.to_json_rows(df).first().json) == {"i": 1, "x": None, "a": [1.0, None], "m": {"k": None}, "s": {"x": None, "i": 1}}
    writers.write_report_json(df, f"{tmp_path}/r.json")
    assert spark.read.json(f"{tmp_path}/r.json").first().x is None
    writers.write_report_table(df.select("i", "x"), f"{tmp_path}/t", partition_by=["i"])
    assert (tmp_path / "t" / "i=1").is_dir()


def test_evidence(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "good.json").write_text('{"a": {"ece": 0.1}}')
    tables, status = readers.load_evidence(spark, {n: f"{tmp_path}/{n}" for n in ("good.csv", "bad.json", "good.json", "gone.csv")}, ["good.csv"])
    assert {r.name: r.available for r in status.collect()} == {"good.csv": True, "bad.json": False, "good.json": True, "gone.csv": False}
    assert sorted(tables) == ["good.csv", "good.json"]


def test_json_find(spark):
    docs = ['{"a": {"ECE": {"x": 1}, "b": [{"ece": 0.5}]}, "ece": 9}', '{"ece": null, "z": {"brier": true}}', "{broken", None, '{"q": 1}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r.v for r in df.orderBy("i").select(readers.json_find("d", ["ece", "brier"]).alias("v")).collect()]
    assert got == ["0.5", "true", None, None, None]


def test_materialize_and_small_side(spark):
    df = spark.range(10)
    assert materialize(df).count() == 10
    big = small_side(df, limit=3)
    assert "BroadcastHint" not in str(big._jdf.queryExecution().logical()) and "ResolvedHint" not in str(big._jdf.queryExecution().analyzed())
    assert "ResolvedHint" in str(small_side(df, limit=100)._jdf.queryExecution().analyzed())
