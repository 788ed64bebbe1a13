import types

import pytest

from farelode.tables import clean_id, durable, shared_folder, stored


def session(master, conf=None, context_conf=None, chosen=None, warehouse="/w"):
    """What ``shared_folder`` asks of a session."""
    option = types.SimpleNamespace(isDefined=lambda: chosen is not None, get=lambda: chosen)
    context = types.SimpleNamespace(master=master, getConf=lambda: types.SimpleNamespace(get=lambda k: (context_conf or {}).get(k)), _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: option)))
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: {"spark.sql.warehouse.dir": warehouse, **(conf or {})}.get(k, d)))


def test_the_shared_folder_is_the_clusters():
    assert shared_folder(session("spark://h:7077", {"spark.checkpoint.dir": "hdfs://x"}), "a") == "hdfs://x/a"
    assert shared_folder(session("yarn", context_conf={"spark.checkpoint.dir": "s3://y"}), "a") == "s3://y/a"
    assert shared_folder(session("yarn", chosen="hdfs://z/id"), "a") == "hdfs://z/id/a"
    assert shared_folder(session("local[4]"), "a") == "/w/checkpoints/a" and shared_folder(session("local"), "a") == "/w/checkpoints/a"
    for master in ("yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(ValueError):
            shared_folder(session(master), "a")


def test_cut_lineage_keeps_the_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.5], {"k": 1}), (2, None, None, None)], "n bigint, `odd name` string, v array<double>, m map<string,int>")
    for cut in (durable, stored):
        assert sorted(map(str, cut(df).collect())) == sorted(map(str, df.collect())) and cut(df).schema == df.schema
        assert cut(df.limit(0)).count() == 0


def test_clean_ids(spark):
    rows = spark.createDataFrame([(" A\t",), ("\u200b\ufeffb\xa0",), ("  ",), ("",), (None,), ("x y",), (" " * 50_000 + "Z",)], "v string")
    assert [r[0] for r in rows.select(clean_id(rows["v"])).collect()] == ["a", "b", None, None, None, "x y", "z"]
