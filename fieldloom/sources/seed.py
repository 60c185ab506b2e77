"""Seed files: vocabulary, rules and one table per platform."""

from __future__ import annotations

import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldloom import schemas
from fieldloom.settings import Platform

log = logging.getLogger(__name__)


def read_seed(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with header and quoted commas; the schema is inferred only when none is given."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("enforceSchema", False)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def prepare_fields(seed: DataFrame) -> DataFrame:
    """Vocabulary rows for the registry: the lock flag is the active flag, both times are now."""
    now = F.current_timestamp()
    return (
        seed.withColumnRenamed("is_locked", "is_active").withColumn("created_at", now).withColumn("updated_at", now)
    )


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return prepare_fields(read_seed(spark, path, schemas.SEED_FIELDS))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_seed(spark, path, schemas.SEED_RULES)


def read_platforms(
    spark: SparkSession, platforms: list[Platform], folder: str, table_schemas: dict[object, StructType | str] | None = None,
    default_catalog: str = "harmonised",
) -> dict[tuple[Platform, str], DataFrame]:
    """One table per platform from its CSV or Parquet file, keyed by platform and full table name.

    A platform without seed file or table, or whose file cannot be read, is skipped.
    """
    tables = {}
    for p in platforms:
        if not p.seed_file or not p.seed_table:
            log.info("skipping %s: no seed file or table", p.id)
            continue
        path = os.path.join(folder, p.seed_file)
        name = f"{p.catalog or default_catalog}.{p.schema or p.id}.{p.seed_table}"
        try:
            if path.endswith(".parquet"):
                tables[(p, name)] = spark.read.parquet(path)
            else:
                tables[(p, name)] = read_seed(spark, path, (table_schemas or {}).get(p.id))
        except AnalysisException as exc:
            log.warning("skipping %s: %s", p.id, exc)
    return tables
