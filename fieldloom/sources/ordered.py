"""Tables written in an order that can be read again without another sort.

Rows are dealt by ranges of the order, sorted within each task and written with their place; a small table beside them tells
how many rows each task holds, from which every row's ordinal follows. The rows are written before they are counted, so a lost
task cannot shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a place that number rows within a task; the task's number, tasks being in order, stands above.
TASK_BITS = 33


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_ordered(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """Write the rows to a new folder in the given order; ties come in any order. No column may be named `_place`."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    _sorted(df, columns).withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    spark = df.sparkSession
    tasks = spark.read.parquet(f"{path}/rows").groupBy(F.shiftright("_place", TASK_BITS).alias("task")).agg(F.count("*").alias("rows"))
    # One row per task.
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{path}/tasks")


def read_ordered(spark: SparkSession, path: str, first: int | None = None, past: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The written rows with their ordinal from 0, of all or of ordinals from `first` up to `past`.

    A range is a range of places, which reaches the file scan, so that other rows are not read.
    """
    rows, tasks = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/tasks")
    if first is not None or past is not None:
        # One row is read per bound.
        for bound, holds in ((first, rows["_place"].__ge__), (past, rows["_place"].__lt__)):
            if bound is not None:
                at = tasks.where(F.col("first") <= bound).orderBy(F.desc("first"), F.desc("task")).limit(1).collect()
                rows = rows.where(holds(F.lit((at[0]["task"] << TASK_BITS) + max(0, bound) - at[0]["first"] if at else 0)))
    count = F.col("_place").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    joined = rows.join(F.broadcast(tasks), F.shiftright("_place", TASK_BITS) == F.col("task"))
    return joined.select(*[c for c in rows.columns if c != "_place"], (F.col("first") + count).alias(ordinal))


def write_ordered_report(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """A report as CSV with header whose files, by name, follow the order."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    _sorted(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
