"""Match standardised headers to the vocabulary by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import match_rationale, squash
from fieldloom.operators.ordering import first_match


def vocabulary_by_name(fields: DataFrame, order: str = "canonical_id") -> DataFrame:
    """One row per name: the last field of that name, at the place of the first."""
    return (
        fields.filter(F.col("canonical_name").isNotNull())
        .groupBy("canonical_name")
        .agg(F.max_by("canonical_id", order).alias("canonical_id"), F.min(order).alias("place"))
    )


def exact_match(headers: DataFrame, fields: DataFrame, order: str = "canonical_id", std: str = "standardized") -> DataFrame:
    """Headers whose standardised name is a vocabulary name."""
    names = vocabulary_by_name(fields, order).drop("place")
    return headers.join(names, F.col(std) == F.col("canonical_name"))


def near_match(headers: DataFrame, fields: DataFrame, order: str = "canonical_id", std: str = "standardized") -> DataFrame:
    """Headers equal to a vocabulary name once underscores are removed; the first such name counts."""
    names = first_match(
        vocabulary_by_name(fields, order).withColumn("_squashed", squash("canonical_name")), ["_squashed"], ["place"]
    ).drop("place")
    return headers.join(names, squash(std) == F.col("_squashed")).drop("_squashed")


def fast_match(
    headers: DataFrame,
    fields: DataFrame,
    order: str = "canonical_id",
    std: str = "standardized",
    header: str = "column_name",
    exact_confidence: int = 95,
    near_confidence: int = 90,
) -> DataFrame:
    """Every header with its exact or, failing that, near match; `match_kind` is null without one."""
    by_name = vocabulary_by_name(fields, order)
    exact = by_name.select(F.col("canonical_name").alias("_e_name"), F.col("canonical_id").alias("_e_id"))
    near = first_match(by_name.withColumn("_squashed", squash("canonical_name")), ["_squashed"], ["place"]).select(
        "_squashed", F.col("canonical_name").alias("_n_name"), F.col("canonical_id").alias("_n_id")
    )
    joined = headers.join(exact, F.col(std) == F.col("_e_name"), "left").join(
        near, squash(std) == F.col("_squashed"), "left"
    )
    kind = F.when(F.col("_e_name").isNotNull(), "exact").when(F.col("_n_name").isNotNull(), "near")
    matched = joined.withColumn("match_kind", kind).withColumns(
        {
            "canonical_id": F.coalesce("_e_id", "_n_id"),
            "canonical_name": F.coalesce("_e_name", "_n_name"),
            "confidence": F.when(F.col("match_kind") == "exact", exact_confidence).when(
                F.col("match_kind") == "near", near_confidence
            ),
        }
    )
    return matched.withColumn(
        "rationale", F.when(F.col("match_kind").isNotNull(), match_rationale(header, std, "canonical_name", "match_kind"))
    ).drop("_e_name", "_e_id", "_squashed", "_n_name", "_n_id")
