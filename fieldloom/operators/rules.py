"""Abbreviation rules and header standardisation over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators.ordering import last_wins

# Rule sets up to this size travel as a literal inside the plan; larger ones are joined.
LITERAL_RULES = 1000


def active_abbreviations(rules: DataFrame, order: str = "rule_id") -> DataFrame:
    """Pattern and replacement of the active abbreviation rules; of equal patterns the last wins."""
    active = rules.filter(
        (F.col("rule_type") == "abbreviation") & (F.lower(F.col("is_active").cast("string")) == "true")
    )
    return last_wins(active.select("pattern", "replacement", order), ["pattern"], [order]).select("pattern", "replacement")


def abbreviation_map(abbreviations: DataFrame, limit: int | None = LITERAL_RULES) -> dict[str, str] | None:
    """The abbreviations as a mapping, or None when there are more than `limit`; without a limit all of them."""
    query = _one_per_pattern(abbreviations)
    rows = (query if limit is None else query.limit(limit + 1)).collect()
    return None if limit is not None and len(rows) > limit else {r.pattern: r.replacement for r in rows}


def _one_per_pattern(abbreviations: DataFrame) -> DataFrame:
    """Of rules that repeat a pattern the greatest replacement counts, however many rules there are."""
    return abbreviations.filter("pattern is not null").groupBy("pattern").agg(F.max("replacement").alias("replacement"))


def standardize_headers(
    df: DataFrame, header: str, abbreviations: DataFrame | None = None, out: str = "standardized", limit: int = LITERAL_RULES
) -> DataFrame:
    """Add the standardised name of every header.

    With few rules this is a projection without a shuffle. With many, the tokens of the distinct
    headers are joined to the rules.
    """
    table = abbreviation_map(abbreviations, limit) if abbreviations is not None else {}
    if table is not None:
        return df.withColumn(out, T.standardize(header, table))
    stems = df.select(F.col(header).alias("_header")).distinct().withColumn("_stem", T.header_stem("_header"))
    tokens = stems.select("_header", F.posexplode(F.split("_stem", "_")).alias("_pos", "_token"))
    rules = _one_per_pattern(abbreviations).select(F.col("pattern").alias("_token"), F.col("replacement").alias("_replacement"))
    expanded = (
        tokens.join(rules, "_token", "left")
        .groupBy("_header")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_replacement", "_token").alias("t")))).alias("_parts"))
        .select("_header", T.tidy(F.array_join(F.transform("_parts", lambda p: p.t), "_")).alias("_expanded"))
    )
    names = expanded.select("_header", T.finish_name(F.col("_expanded"), F.col("_header")).alias(out))
    return df.join(names, F.col(header).eqNullSafe(F.col("_header")), "left").drop("_header")
