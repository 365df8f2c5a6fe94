"""Where intermediate results go."""

from types import SimpleNamespace

from panelweave import session


def fake(master, named=None, ready=None):
    asked = []
    sc = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: ready,
        setCheckpointDir=asked.append,
        getConf=lambda: SimpleNamespace(get=lambda k: named),
    )
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: named)), asked


def test_named_folder_is_used():
    spark, asked = fake("spark://cluster", "hdfs:///shared/tmp")
    assert session._checkpoint_ready(spark) and asked == ["hdfs:///shared/tmp"]


def test_folder_already_set_is_left_alone():
    spark, asked = fake("spark://cluster", ready="hdfs:///x")
    assert session._checkpoint_ready(spark) and asked == []


def test_cluster_without_folder_gets_no_local_one():
    spark, asked = fake("yarn")
    assert not session._checkpoint_ready(spark) and asked == []


def test_local_master_gets_a_private_folder():
    spark, asked = fake("local[2]")
    assert session._checkpoint_ready(spark) and "panelweave-" in asked[0]


def test_materialised_frame_has_short_lineage(spark):
    df = session.materialise(spark.range(10).selectExpr("id", "id % 3 AS k").groupBy("k").count())
    assert sorted(r["count"] for r in df.collect()) == [3, 3, 4]
    assert "RDDScan" in df._jdf.queryExecution().toString() or "ExistingRDD" in df._jdf.queryExecution().toString()
