"""Sources and sinks beside plain tables: paged rows, tolerant JSON lines, caches, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedRows(DataSource):
    """Rows of a paged service, a page a task: spark.read.format("paged_rows").

    Options: rows, page (at most 100), fail_first (attempts of each page that fail, to try the
    retries).  fetch() stands for the service; a subclass overrides it."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row long, value string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    TRIES, MOST = 3, 100

    def __init__(self, options):
        self.rows, self.page = int(options.get("rows", 0)), min(self.MOST, int(options.get("page", self.MOST)))
        self.fail_first = int(options.get("fail_first", 0))

    def partitions(self):
        return [InputPartition(at) for at in range(0, self.rows, self.page)] or [InputPartition(0)]

    def fetch(self, offset: int, length: int, attempt: int):
        if attempt < self.fail_first:
            raise ConnectionError("page not served")
        return [(i, f"row {i}") for i in range(offset, min(self.rows, offset + length))]

    def read(self, partition):
        import time

        for attempt in range(self.TRIES):
            try:
                yield from self.fetch(partition.value, self.page, attempt)
                return
            except ConnectionError:
                if attempt == self.TRIES - 1:
                    raise
                time.sleep(0.01 * (attempt + 1))


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  tolerant drops corrupt lines instead of failing."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, corrupt_ string").option("columnNameOfCorruptRecord", "corrupt_").json(path).cache()
    return rows.where("corrupt_ IS NULL").drop("corrupt_")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Fields in the order of their names, so that runs compare."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def whole_json(spark: SparkSession, path: str, schema: str, default: list | None = None) -> DataFrame:
    """One JSON document; a file that isn't there gives the default's rows."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame(default or [], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def within_budget(df: DataFrame, size: str, order: str, budget: int) -> DataFrame:
    """Rows in order until their sizes reach the budget, the row that crosses it included.

    Running sums go by ranges of the order, so that no task sees all rows."""
    parts = df.withColumn("part_", F.floor(F.col(order) / 1024))
    before = parts.groupBy("part_").agg(F.sum(size).alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(before.drop("n_"), "part_").withColumn("at_", F.col("before_") + F.coalesce(F.sum(size).over(run), F.lit(0)))
    return placed.where(F.col("at_") < budget).drop("part_", "before_", "at_")


def stage_cache(spark: SparkSession, folder: str, name: str, version: int, make) -> DataFrame:
    """The table of a stage: made once for each version, then read."""
    path = f"{folder}/{name}/v{version}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def digest(df: DataFrame, *columns: str) -> str:
    """A digest of rows whatever their order: what a sidecar records and a reader recomputes."""
    one = df.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    got = one.agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("x"), F.bit_xor(F.conv(F.substring("h", 16, 15), 16, 10).cast("long")).alias("y")).first()
    return json.dumps([got["n"], got["x"], got["y"]])


def markdown(df: DataFrame) -> DataFrame:
    """A small result as a markdown table, one row of one string."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    rows = df.select(line.alias("l")).agg(F.array_sort(F.collect_list("l")).alias("a"))
    return rows.select(F.concat(F.lit(head + "\n"), F.array_join("a", "\n")).alias("report"))
