from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from echoline.operators import cache


def rows(spark, items, namespace="n", version=cache.SCHEMA_VERSION):
    return spark.createDataFrame([(k, version, v, namespace) for k, v in items], cache.MEMO)


def known(spark, path, namespace="n"):
    return dict(map(tuple, cache.usable(cache.read(spark, path), namespace).collect()))


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/memo"
    assert known(spark, path) == {} and cache.manifest(spark, path) == (0, [])
    assert cache.write(rows(spark, [("a", "2"), ("b", "x")]), path)
    assert cache.write(rows(spark, [("a", "1"), ("c", None)]), path)
    assert cache.write(rows(spark, [("a", "other")], "m"), path)
    assert cache.write(rows(spark, [("b", "0")], version=0), path)
    assert known(spark, path) == {"a": "1", "b": "x"} and known(spark, path, "m") == {"a": "other"}
    assert cache.manifest(spark, path)[0] == 4
    assert cache.read(spark, path, version=1).count() == 2
    assert cache.compact(spark, path) == 5
    assert known(spark, path) == {"a": "1", "b": "x"} and known(spark, path, "m") == {"a": "other"}
    assert cache.read(spark, path).count() == 3 and len(cache.manifest(spark, path)[1]) == 1
    assert cache.read(spark, path, version=4).count() == 6  # still there for who reads it
    assert cache.vacuum(spark, path) == 4 and known(spark, path) == {"a": "1", "b": "x"}


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "memo")
    with ThreadPoolExecutor(6) as pool:
        assert all(pool.map(lambda w: cache.write(rows(spark, [(f"own-{w}", str(w)), ("shared", str(w))]), path), range(8)))
    assert known(spark, path) == {f"own-{w}": str(w) for w in range(8)} | {"shared": "0"}
    assert cache.manifest(spark, path)[0] == 8


def test_a_writer_beside_a_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "memo")
    cache.write(rows(spark, [("a", "1")]), path)
    real = cache.commit

    def late(*args):  # another writer is done between the reading and the commit
        monkeypatch.setattr(cache, "commit", real)
        cache.write(rows(spark, [("b", "2")]), path)
        return real(*args)

    monkeypatch.setattr(cache, "commit", late)
    cache.compact(spark, path)
    assert known(spark, path) == {"a": "1", "b": "2"}


def test_a_memo_that_cannot_be_written_is_told(spark, tmp_path, capsys):
    (tmp_path / "file").write_text("x")
    assert not cache.write(rows(spark, [("a", "1")]), str(tmp_path / "file" / "memo"))
    assert "memo not written" in capsys.readouterr().out


def test_computed_once(spark, tmp_path):
    path = str(tmp_path / "memo")
    asked = spark.createDataFrame([(str(k),) for k in range(10)], "key string")
    first = cache.memoised(asked.where("key < '5'"), "key", "n", path, lambda r: r.select("key", F.concat(F.lit("old "), "key").alias("value")))
    assert first.count() == 5
    again = dict(map(tuple, cache.memoised(asked, "key", "n", path, lambda r: r.select("key", F.concat(F.lit("new "), "key").alias("value"))).collect()))
    assert again == {str(k): f"{'old' if k < 5 else 'new'} {k}" for k in range(10)}
