"""Reading and writing the metadata tables, reports and published tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom import schemas
from fieldloom.functions.display import details_json
from fieldloom.operators.conform import Conformed, quoted
from fieldloom.operators.review import audit_events


def create_tables(spark: SparkSession, schema: str) -> None:
    """Create the metadata tables that do not exist."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    for name, columns in schemas.TABLES.items():
        if not spark.catalog.tableExists(f"{schema}.{name}"):
            spark.createDataFrame([], columns).write.saveAsTable(f"{schema}.{name}")


def load_table(
    spark: SparkSession, name: str, schema: StructType, order: list[tuple[str, bool]] = (), limit: int | None = None
) -> DataFrame:
    """A table in its fixed order; a missing table or column gives an empty result, other errors are raised."""
    empty = spark.createDataFrame([], schema)
    if not spark.catalog.tableExists(name):
        return empty
    try:
        df = spark.table(name).select(*schema.fieldNames())
        if order:
            df = df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order])
        return df.limit(limit) if limit is not None else df
    except AnalysisException as exc:
        if exc.getCondition() and exc.getCondition().startswith(("UNRESOLVED_COLUMN", "TABLE_OR_VIEW_NOT_FOUND")):
            return empty
        raise


def load_metadata(spark: SparkSession, schema: str, name: str, limit: int | None = None) -> DataFrame:
    return load_table(spark, f"{schema}.{name}", schemas.TABLES[name], schemas.READ_ORDER[name], limit)


def append(df: DataFrame, table: str) -> None:
    """Add rows to a table in one distributed write; columns are matched by name, and one the table lacks is an error."""
    target = df.sparkSession.table(table).columns
    unknown = [c for c in df.columns if c not in target]
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(unknown)}")
    missing = [F.lit(None).alias(c) for c in target if c not in df.columns]
    df.select("*", *missing).select(*target).write.mode("append").insertInto(table)


def replace(df: DataFrame, table: str) -> None:
    """Replace a table, schema included."""
    df.write.mode("overwrite").option("overwriteSchema", True).saveAsTable(table)


def reset(spark: SparkSession, schema: str) -> None:
    """Empty the tables a run fills."""
    for name in schemas.RUN_TABLES:
        replace(spark.createDataFrame([], schemas.TABLES[name]), f"{schema}.{name}")


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with header."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def publish(
    spark: SparkSession, conformed: Iterable[Conformed], owners: dict[str, object], gold: str | None = None
) -> tuple[int, dict[str, str]]:
    """Publish conformed tables as views `<platform>__<table>`: in schema `gold` over the catalog's own
    tables, or as temporary views of the frames without one. No rows are copied.

    Returns how many were published and the error of every table that failed.
    """
    if gold:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {gold}")
    done, errors = 0, {}
    for item in conformed:
        name = f"{owners[item.source_table]}__{item.source_table.split('.')[-1]}"
        try:
            if item.error:
                raise ValueError(item.error)
            if gold:
                columns = ", ".join(f"{quoted(c)} AS {quoted(n)}" for c, n in item.renames)
                table = ".".join(quoted(part) for part in item.source_table.split("."))
                spark.sql(f"CREATE OR REPLACE VIEW {gold}.{quoted(name)} AS SELECT {columns} FROM {table}")
            else:
                item.frame.createOrReplaceTempView(name)
            done += 1
        except (PySparkException, ValueError) as exc:
            errors[item.source_table] = str(exc)
    return done, errors


def publication_event(spark: SparkSession, published: int, actor: str) -> DataFrame:
    """The audit row of a publication, to append to the log; no row where nothing was published."""
    counted = spark.range(min(published, 1)).select(F.lit(published).alias("n"), F.current_timestamp().alias("at"))
    return audit_events(counted, "gold_views", F.lit("batch"), "created", actor, details_json(count=F.col("n")), F.col("at"))
