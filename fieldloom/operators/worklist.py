"""The stewards' worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.display import contains_text, leaf_name, title_words
from fieldloom.functions.text import text
from fieldloom.operators.coverage import with_label
from fieldloom.operators.ordering import PAGE_SIZE
from fieldloom.operators.retrieval import one_per_column, one_per_field, platform_lists
from fieldloom.settings import Platform


def joined_proposals(proposals: DataFrame, source: DataFrame, fields: DataFrame) -> DataFrame:
    """Proposals with their column and suggested field, one row per proposal."""
    names = one_per_field(fields).withColumnRenamed("canonical_id", "suggested_canonical_id")
    return proposals.join(one_per_column(source), "column_id", "left").join(names, "suggested_canonical_id", "left")


def filter_worklist(joined: DataFrame, status: str | None = None, platform=None, search: str = "") -> DataFrame:
    """Proposals by status, platform, and text in header, table, field name or reasoning."""
    if status is not None:
        joined = joined.filter(F.col("status") == status)
    if platform is not None:
        joined = joined.filter(F.col("platform_id") == platform)
    if search:
        joined = joined.filter(contains_text(search, "column_name", "source_table", "canonical_name", "reasoning"))
    return joined


def platform_cells(approved: DataFrame, source: DataFrame, platforms: list[Platform], page_size: int = PAGE_SIZE) -> DataFrame:
    """Per field and page, one text cell per platform."""
    return (
        platform_lists(approved, source, page_size)
        .withColumn("cell", F.array_join("names", ", "))
        .groupBy("canonical_id", "page")
        .pivot("platform_id", [p.id for p in platforms])
        .agg(F.first("cell"))
        .select("canonical_id", "page", *[text(F.col(f"`{p.id}`")).alias(p.name) for p in platforms])
    )


def worklist(joined: DataFrame, cells: DataFrame, platform_labels: DataFrame, platforms: list[Platform]) -> DataFrame:
    """Display rows: what is proposed, and what every platform already calls the suggested field.

    A proposal has one row per page of its field's cells, numbered by `page` from 0; without cells it has page 0 only.
    """
    named = cells.withColumnRenamed("canonical_id", "_cid").withColumnRenamed("page", "_page")
    rows = with_label(joined, platform_labels).join(named, F.col("suggested_canonical_id") == F.col("_cid"), "left")
    return rows.select(
        "proposal_id",
        text(F.coalesce("canonical_name", "suggested_canonical_name")).alias("suggested_match"),
        title_words("confidence_level").alias("confidence"),
        text("column_name").alias("header"),
        text("platform").alias("platform"),
        leaf_name("source_table").alias("source_table"),
        title_words("status").alias("status"),
        *[text(F.col(f"`{p.name}`")).alias(p.name) for p in platforms],
        F.coalesce("_page", F.lit(0)).alias("page"),
    )
