from __future__ import annotations

import pytest

import os

from echoline.llm import base


def test_tables_live_in_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = base.persist(spark.range(5), "t")
    assert df.count() == 5
    assert base.work_dir(spark).startswith(shared)
    assert all(f.startswith(f"file:{shared}") or f.startswith(f"file://{shared}") for f in df.inputFiles())


def test_volume_counts_bytes(spark):
    docs = spark.createDataFrame([("é",), (None,), ("ab",)], "text string")
    assert base.text_volume(docs) == (3, 4)
    assert base.text_volume(docs.limit(0)) == (0, 0)


def test_map_rows_of_an_empty_table(spark):
    out = base.map_rows(spark.range(0).selectExpr("id"), lambda: lambda i: (i,), "id long")
    assert out.count() == 0


def test_sweep(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(base, "work_dir", lambda s: str(tmp_path / "w"))
    base.persist(spark.range(3), "x")
    base.sweep(spark)
    assert not os.path.exists(tmp_path / "w")


def test_scratch_goes_when_it_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base, "work_dir", lambda s: str(tmp_path / "w"))
    outside = base.persist(spark.range(4), "x")
    with base.scratch(spark):
        inside = base.persist(spark.range(3), "x")
        inside.write.parquet(str(tmp_path / "kept"))
    assert [f for f in os.listdir(tmp_path / "w") if f.startswith("scratch")] == []
    assert (outside.count(), spark.read.parquet(str(tmp_path / "kept")).count()) == (4, 3)


def test_one_folder_where_none_is_set(monkeypatch):
    class Context:
        applicationId, master = "app-1", "local[2]"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    made = []
    monkeypatch.setattr(base.tempfile, "mkdtemp", lambda prefix: made.append(prefix) or f"/tmp/{prefix}{len(made)}")
    monkeypatch.setattr(base, "_own", {})
    assert base.work_dir(Session()) == base.work_dir(Session()) == "/tmp/echoline-1/echoline-app-1"
    assert len(made) == 1


def test_smaller_batches_of_the_caller_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "17")
        base.bound_batches(spark)
        assert spark.conf.get(name) == "17"
        spark.conf.set(name, "1000000")
        base.bound_batches(spark)
        assert spark.conf.get(name) == str(base.BATCH_ROWS)
    finally:
        spark.conf.set(name, before)


def test_clusters_need_a_shared_folder():
    """Without the setting a local folder serves local masters only."""
    from types import SimpleNamespace as Some

    from echoline.llm import base

    def session(master):
        context = Some(applicationId=f"app-{master}", master=master, getConf=lambda: {})
        return Some(sparkContext=context, conf=Some(get=lambda key, default=None: default))

    assert base.work_dir(session("local[2]")).endswith("echoline-app-local[2]")
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            base.work_dir(session(master))
