"""Columns of the platforms' tables as a relation."""

from __future__ import annotations

import logging
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions.text import stable_id
from fieldloom.operators.intake import new_columns
from fieldloom.session import materialize
from fieldloom.settings import Platform

log = logging.getLogger(__name__)


def discover_columns(spark: SparkSession, tables: dict[tuple[Platform, str], DataFrame]) -> DataFrame:
    """(platform_id, source_table, column_name, data_type) of tables at hand; only schemas are read."""
    rows = []
    for (platform, name), df in tables.items():
        try:
            rows += [(str(platform.id), name, f.name, f.dataType.simpleString()) for f in df.schema.fields]
        except PySparkException as exc:
            log.warning("skipping %s of %s: %s", name, platform.id, exc)
    return spark.createDataFrame(rows, "platform_id string, source_table string, column_name string, data_type string")


#: Tables whose figures one plan works out.
TABLES_PER_PLAN = 40
#: What a job that reads a broken table raises.
FAILURES = (PySparkException, Py4JJavaError)


def _value(name: str, kind: str) -> Column:
    """A value to count by: short ones as they are, texts, bytes and nested ones by their SHA-256."""
    column = F.col("`" + name.replace("`", "``") + "`")
    if kind.startswith(("array", "struct", "map", "variant")):
        column = F.when(column.isNotNull(), F.to_json(F.struct(column.alias("v"))))
    elif kind != "binary":
        column = column.cast("string")
    return F.unhex(F.sha2(column.cast("binary"), 256)) if kind in ("string", "binary") or kind.startswith(("array", "struct", "map", "variant")) else column.cast("binary")


def _figures(platform: Platform, name: str, df: DataFrame) -> DataFrame:
    """One row per column of a table from a single scan: its columns become rows, counted by value before the shuffle."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    listed = df.sparkSession.createDataFrame(fields, "_i int, column_name string, data_type string")
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), _value(n, t).alias("v")) for i, n, t in fields])
    values = df.select(F.explode(cells).alias("c")).groupBy("c._i", "c.v").agg(F.count("*").alias("n"))
    counts = values.groupBy(F.col("_i").alias("_c")).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"), F.count("v").alias("distinct_values")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return listed.join(counts, F.col("_i") == F.col("_c"), "left").select(
        F.lit(str(platform.id)).alias("platform_id"), F.lit(name).alias("source_table"), "column_name", "data_type",
        zero("rows"), zero("nulls"), zero("distinct_values"),
    )


def profile_columns(spark: SparkSession, tables: dict[tuple[Platform, str], DataFrame]) -> DataFrame:
    """The discovered columns with their rows, nulls and distinct values, counted exactly and written table group by group.

    Each table is scanned once. A table that cannot be read is logged and skipped; the others of its group are counted.
    """
    empty = "platform_id string, source_table string, column_name string, data_type string, rows bigint, nulls bigint, distinct_values bigint"
    done, items = [], list(tables.items())
    for at in range(0, len(items), TABLES_PER_PLAN):
        group = items[at : at + TABLES_PER_PLAN]
        try:
            done.append(materialize(reduce(DataFrame.unionByName, [_figures(p, n, df) for (p, n), df in group]), "columns"))
        except FAILURES:
            for (platform, name), df in group:
                try:
                    done.append(materialize(_figures(platform, name, df), "columns"))
                except FAILURES as exc:
                    log.warning("skipping %s of %s: %s", name, platform.id, str(exc).partition("\n")[0])
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], empty)


def discover_catalog(spark: SparkSession, platforms: list[Platform], default_catalog: str = "spark_catalog") -> DataFrame:
    """The same from the session catalog: every table in each platform's schema. Unreadable platforms are skipped."""
    rows = []
    for p in platforms:
        catalog, schema = p.catalog or default_catalog, p.schema or p.id
        try:
            for table in spark.catalog.listTables(f"{catalog}.{schema}"):
                name = f"{catalog}.{schema}.{table.name}"
                rows += [(str(p.id), name, c.name, c.dataType) for c in spark.catalog.listColumns(name)]
        except PySparkException as exc:
            log.warning("skipping %s: %s", p.id, exc)
    return spark.createDataFrame(rows, "platform_id string, source_table string, column_name string, data_type string")


def register_columns(discovered: DataFrame, known: DataFrame, batch_id: str) -> DataFrame:
    """Rows for the source column table, one per column not yet known."""
    fresh = new_columns(discovered, known)
    return fresh.select(
        stable_id("platform_id", "source_table", "column_name").alias("column_id"),
        "platform_id", "source_table", "column_name", F.coalesce("data_type", F.lit("STRING")).alias("data_type"),
        F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("detected_at"),
    ).select(*schemas.SOURCE_COLUMNS.fieldNames())
