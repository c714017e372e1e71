"""Tables of a data folder, with the columns that the queries rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables whose rows are long texts, and the size up to which one that lies in few files is dealt out first.
TEXT_TABLES, SMALL_BYTES = {"documents", "pages", "conversations"}, 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores; any other as it is.

    A file of one row group is one task however many cores wait.  The plan's own statistics give the
    size, so that no large table is ever shuffled for this, and no list of files comes to the driver."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local folder only where none is set and the master is local: another
    master's executors would not see it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the cluster's checkpoint folder, where its lineage ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables for spark.sql."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Columns that a file may lack, with a default; a column that is there keeps its values but for nulls."""
    have = set(df.columns)
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
