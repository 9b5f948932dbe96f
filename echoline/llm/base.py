"""Shared plumbing of the corpus operators: tables, shared work folder, Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker; long documents stay bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
CHECKPOINT = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep what one Python worker holds at a time small, whatever the length of the texts. The session keeps these two
    settings, since plans are run after the operator has returned; smaller values of the caller stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


_own: dict[str, str] = {}
_scratch: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the one that the driver and all executors share; a local one only where none is
    set (tests)."""
    context = spark.sparkContext
    found = spark.conf.get(CHECKPOINT, None) or context.getConf().get(CHECKPOINT)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="echoline-")
        found = _own[context.applicationId]
    return f"{found.rstrip('/')}/echoline-{context.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still depend on them can't be read afterwards."""
    delete(spark, work_dir(spark))


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage. Shuffles and broadcasts of earlier steps are freed, on executors too, only when
    the driver's collector finds them unreachable, and the driver gives memory back only then."""
    spark._jvm.java.lang.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that are written inside go when it ends; what is to outlast it has to be written elsewhere."""
    name = f"scratch-{uuid.uuid4().hex}"
    token = _scratch.set(f"{name}/")
    try:
        yield
    finally:
        _scratch.reset(token)
        delete(spark, f"{work_dir(spark)}/{name}")


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{_scratch.get()}{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def binary_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the text's UTF-8 bytes; all other columns are left behind, so none can clash."""
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("binary").alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Row-wise Arrow map. make() runs once a task and returns f(*values) -> tuple of output values."""
    bound_batches(df.sparkSession)
    fields = spark_to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = [f(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def spark_to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def text_volume(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes) of all texts; sizes partitions by the input instead of by a constant."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0
