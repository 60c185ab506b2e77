"""Which columns are new, unmapped or already mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMN_KEY = ["platform_id", "source_table", "column_name"]
OPEN_STATUSES = ("pending_review", "approved")


def one_per_key(discovered: DataFrame) -> DataFrame:
    """Discovered columns, each once with the least of its other values."""
    rest = [c for c in discovered.columns if c not in COLUMN_KEY]
    if not rest:
        return discovered.distinct()
    return discovered.groupBy(*COLUMN_KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*COLUMN_KEY, "_r.*")


def new_columns(discovered: DataFrame, known: DataFrame) -> DataFrame:
    """Discovered columns not yet known, each once. `key_filter.new_columns_filtered` gives the same against a huge registry."""
    once = one_per_key(discovered)
    condition = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in COLUMN_KEY]
    return once.alias("n").join(known.select(*COLUMN_KEY).alias("k"), condition, "left_anti").select(*discovered.columns)


def unmapped(source: DataFrame, approved: DataFrame, proposals: DataFrame) -> DataFrame:
    """Columns neither approved nor under an open proposal; rejected and flagged ones come again."""
    taken = approved.select("column_id").unionByName(
        proposals.filter(F.col("status").isin(*OPEN_STATUSES)).select("column_id")
    )
    return source.join(taken, "column_id", "left_anti")


def mapped_columns(source: DataFrame, approved: DataFrame) -> DataFrame:
    """Columns with an approved mapping."""
    return source.join(approved.select("column_id"), "column_id", "left_semi")
