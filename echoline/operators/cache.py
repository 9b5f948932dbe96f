"""Memo tables: results of costly stages by content digest. A row of another schema version counts as a miss.

A memo is a folder of data folders, which never change, and of numbered manifests, each of which lists the data folders that
count from then on. A writer adds its folder by creating the next manifest; where another was faster, it reads that
one and tries the number after it, so that concurrent writers lose nothing. Readers go by the newest manifest, whole;
of several values of a key the least counts, for all readers and before and after `compact`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.tables import materialize

SCHEMA_VERSION = 1
MANIFESTS, MEMO = "manifests", "key string, schema_version int, value string, namespace string"


def digest(*parts: Column) -> Column:
    """One key of an identity and a content: the parts joined by a bar, then SHA-256."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def identity(model: str, packages: dict[str, str], compute_type: str, language: str | None, mode: str) -> str:
    return "|".join([model, *(f"{k}={v}" for k, v in sorted(packages.items())), compute_type, language or "auto", mode])


def envelope(results: DataFrame, key: str, value_columns: list[str], namespace: str) -> DataFrame:
    """(namespace, key, schema_version, value) rows to append to a memo table."""
    return results.select(F.lit(namespace).alias("namespace"), F.col(key).alias("key"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.to_json(F.struct(*value_columns)).alias("value"))


def usable(memo: DataFrame, namespace: str) -> DataFrame:
    """(key, value): of several values of a key, which concurrent writers may leave, the least, so that all readers see the same."""
    rows = memo.where((F.col("namespace") == namespace) & (F.col("schema_version") == SCHEMA_VERSION) & F.col("value").isNotNull())
    return rows.groupBy("key").agg(F.min("value").alias("value"))


def hits_and_misses(requests: DataFrame, memo: DataFrame, key: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(requests with `value`, requests without one)."""
    known = usable(memo, namespace).withColumnRenamed("key", key)
    return requests.join(known, key), requests.join(known.select(key), key, "left_anti")


def memoised(requests: DataFrame, key: str, namespace: str, path: str | None, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """requests with `value`: known results from the memo at path, the others by compute(requests without one), which
    gives (key, value) and is added to the memo. Without a path everything is computed."""
    spark = requests.sparkSession
    if path is None:
        return requests.join(compute(requests), key)
    hits, misses = hits_and_misses(requests, read(spark, path), key, namespace)
    misses = materialize(misses, "memo-misses")
    new = materialize(misses.join(compute(misses), key), "memo-new")
    write(new.select(F.lit(namespace).alias("namespace"), F.col(key).alias("key"), F.lit(SCHEMA_VERSION).alias("schema_version"), "value"), path)
    return hits.unionByName(new)


def _files(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, its Path class)."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    return Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), Path


def manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, data folders) of the newest manifest; (0, []) of a memo that is not there yet."""
    files, Path = _files(spark, path)
    folder = Path(f"{path}/{MANIFESTS}")
    if not files.exists(folder):
        return 0, []
    last = max((int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()), default=0)
    return (last, [r["value"] for r in spark.read.text(f"{path}/{MANIFESTS}/{last:012d}").collect() if r["value"]]) if last else (0, [])


def _created(spark: SparkSession, path: str, lines: list[str]) -> bool:
    """Whether the file was created with these lines; false if it is there already."""
    files, Path = _files(spark, path)
    data = "".join(f"{line}\n" for line in lines)
    if files.getScheme() == "file":  # Hadoop's local files have no exclusive creation that is atomic; a link has
        name = Path(path).toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        part = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(part, "w", encoding="utf-8") as f:
            f.write(data)
        try:
            os.link(part, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True
    try:
        stream = files.create(Path(path), False)
    except Py4JJavaError as fault:
        if "exist" in str(fault.java_exception).lower():
            return False
        raise
    stream.write(bytearray(data.encode("utf-8")))
    stream.close()
    return True


def commit(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> int:
    """Number of the manifest whose folders are change(those of the manifest before)."""
    while True:
        last, folders = manifest(spark, path)
        if _created(spark, f"{path}/{MANIFESTS}/{last + 1:012d}", change(folders)):
            return last + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(key, schema_version, value, namespace) of a memo, or of one of its earlier versions."""
    folders = manifest(spark, path)[1] if version is None else [r["value"] for r in spark.read.text(f"{path}/{MANIFESTS}/{version:012d}").collect() if r["value"]]
    out = spark.createDataFrame([], MEMO)
    for name in folders:
        out = out.unionByName(spark.read.schema(MEMO).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}"))
    return out


def write(rows: DataFrame, path: str) -> bool:
    """Add rows to a memo, partitioned by namespace; a failure is told and not fatal."""
    name = f"data-{uuid.uuid4().hex}"
    try:
        rows.select("key", "schema_version", "value", "namespace").write.partitionBy("namespace").parquet(f"{path}/{name}")
        commit(rows.sparkSession, path, lambda folders: [*folders, name])
    except Exception as fault:  # a memo is a convenience: the results stand without it
        print(f"memo not written: {fault}")
        return False
    return True


def compact(spark: SparkSession, path: str) -> int:
    """One data folder in place of all, with one value a key and without what counts as a miss; folders that are added meanwhile
    stay. Gives the new manifest's number; the old folders stay for those who are reading them (see `vacuum`)."""
    _, folders = manifest(spark, path)
    rows = read(spark, path).where((F.col("schema_version") == SCHEMA_VERSION) & F.col("value").isNotNull()).groupBy("namespace", "key", "schema_version").agg(F.min("value").alias("value"))
    name = f"data-{uuid.uuid4().hex}"
    rows.select("key", "schema_version", "value", "namespace").repartition("namespace", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("namespace", "key").write.partitionBy("namespace").parquet(f"{path}/{name}")
    return commit(spark, path, lambda now: [name, *[f for f in now if f not in folders]])


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete data folders that the newest manifest doesn't list; not while others write or read older versions. Gives their number."""
    files, Path = _files(spark, path)
    known, gone = set(manifest(spark, path)[1]), 0
    for s in files.listStatus(Path(path)):
        if s.getPath().getName().startswith("data-") and s.getPath().getName() not in known:
            gone += bool(files.delete(s.getPath(), True))
    return gone
