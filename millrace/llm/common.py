"""What the operators of this subpackage share: reading a table, and cutting lineage.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; driver and executors see it alike, and a table there
outlives any executor.  Only where that setting is empty and the master is local
(tests, a notebook) a folder of this machine is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import importable
from millrace.sources.tables import spread

#: Rows and bytes of one Arrow batch on its way to Python; what bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: Paths of the tables that this process has written and not dropped.
_WRITTEN: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Where none is named, a local master gets a folder of this machine; another
    master's executors would not see it, so that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def python_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and let the workers import this library."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def write_table(spark: SparkSession, df: DataFrame, tag: str) -> str:
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.add(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs a reread."""
    schema = df.schema
    path = write_table(spark, df, tag)
    made = spark.read.schema(schema).parquet(path)
    made.table_path = path
    return made


def drop_table(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a table of materialize() that no later step reads."""
    path = df_or_path if isinstance(df_or_path, str) else df_or_path.table_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def written() -> frozenset[str]:
    """The intermediate tables of this process that are there."""
    return frozenset(_WRITTEN)


def clear(spark: SparkSession, before: frozenset[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the intermediate tables of this process, but those that were there before, and keep's own.  For when the
    results that read them are written."""
    for path in list(_WRITTEN - before - ({keep.table_path} if keep is not None else set())):
        drop_table(spark, path)


def ranges(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending split points of a long column for about equal parts; reads that column alone."""
    if parts < 2:
        return []
    steps = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, steps, 10_000)).first()[0]
    return sorted(set(got or []))


def range_id(key: str, splits: list[int]):
    """Which of the ranges a key falls in: 0 .. len(splits); nulls with the smallest."""
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(int(s)).cast("long") for s in splits])
    passed = F.size(F.filter(points, lambda p: p <= F.col(key)))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(passed)
