"""Reading the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ordering import latest

READ_LIMIT = 500


def audit_latest(log: DataFrame, n: int = READ_LIMIT) -> DataFrame:
    """The latest events, newest first."""
    return latest(log, "created_at", n, "event_id")


def filter_audit(log: DataFrame, entity_type: str | None = None, action: str | None = None, actor: str | None = None) -> DataFrame:
    for column, value in (("entity_type", entity_type), ("action", action), ("actor", actor)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    return log


def audit_metrics(log: DataFrame) -> DataFrame:
    """Events, distinct actors and distinct entity types."""
    return log.agg(
        F.count("*").alias("events"), F.countDistinct("actor").alias("actors"), F.countDistinct("entity_type").alias("entity_types")
    )


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct filled values of each column, sorted."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
        .filter(F.coalesce("value", F.lit("")) != "")
        .distinct()
        .orderBy("facet", "value")
    )
