"""Vocabulary names similar to new names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.display import format_half_even
from fieldloom.functions.similarity import letter_counts, name_tokens, overlap_share, sequence_ratio, shared_letters, similarity_bound
from fieldloom.operators.ordering import top_k
from fieldloom.session import materialize

SLACK = 1e-9
# Names sharing one token that a task joins; more are split over several.
NAMES_PER_TASK = 20_000
# Tokens whose parts are sent to every task; more are joined.
SPLIT_TOKENS = 100_000


def _distinct_names(df: DataFrame, name: str, prefix: str) -> DataFrame:
    named = df.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(F.col(name).alias(prefix)).agg(
        F.count("*").alias(f"{prefix}_rows")
    )
    return named.withColumn(f"{prefix}_tokens", name_tokens(prefix)).withColumn(
        f"{prefix}_length", F.length(F.lower(prefix))
    )


def _exploded(names: DataFrame, prefix: str) -> DataFrame:
    return names.withColumn("token", F.explode(f"{prefix}_tokens"))


def _grid(left: DataFrame, right: DataFrame, limit: int) -> DataFrame | None:
    """Tokens so common on a side that their pairs are spread over several tasks; None when there are none."""
    sizes = (
        left.groupBy("token").agg(F.count("*").alias("n")).withColumn("side", F.lit(0))
        .unionByName(right.groupBy("token").agg(F.count("*").alias("n")).withColumn("side", F.lit(1)))
    )
    parts = (
        sizes.filter(F.col("n") > limit)
        .groupBy("token")
        .agg(
            F.coalesce(F.max(F.when(F.col("side") == 0, F.ceil(F.col("n") / limit))), F.lit(1)).cast("int").alias("left_parts"),
            F.coalesce(F.max(F.when(F.col("side") == 1, F.ceil(F.col("n") / limit))), F.lit(1)).cast("int").alias("right_parts"),
        )
    )
    parts = materialize(parts, "similar-split")
    tokens = parts.count()
    return (F.broadcast(parts) if tokens <= SPLIT_TOKENS else parts) if tokens else None


def candidate_pairs(
    names: DataFrame, fields: DataFrame, threshold: float, name: str = "name", field: str = "canonical_name", limit: int = NAMES_PER_TASK,
    letters: bool = False,
) -> DataFrame:
    """Distinct name pairs that share a token and may reach the threshold, each once.

    Without a shared token the score is at most 0.5, so the join on tokens loses nothing above that.
    A pair comes up at its first shared token only and is checked against its bound inside the join: by tokens and lengths,
    and with `letters` also by the letters the two have in common, which leaves far fewer pairs to the sequence ratio.
    """
    if threshold <= 0.5:
        raise ValueError("the threshold must exceed 0.5")
    left, right = _distinct_names(names, name, "a"), _distinct_names(fields, field, "b")
    if letters:
        left, right = left.withColumn("a_letters", letter_counts("a")), right.withColumn("b_letters", letter_counts("b"))
    left, right = _exploded(left, "a"), _exploded(right, "b")
    keys = ["token"]
    grid = _grid(left, right, limit)
    if grid is not None:
        l_parts, r_parts = F.coalesce("left_parts", F.lit(1)), F.coalesce("right_parts", F.lit(1))
        left = (
            left.join(grid, "token", "left")
            .withColumn("_l", F.pmod(F.hash("a"), l_parts))
            .withColumn("_r", F.explode(F.sequence(F.lit(0), r_parts - 1)))
            .drop("left_parts", "right_parts")
        )
        right = (
            right.join(grid, "token", "left")
            .withColumn("_r", F.pmod(F.hash("b"), r_parts))
            .withColumn("_l", F.explode(F.sequence(F.lit(0), l_parts - 1)))
            .drop("left_parts", "right_parts")
        )
        keys += ["_l", "_r"]
    condition = (F.get(F.array_intersect("a_tokens", "b_tokens"), F.lit(0)) == F.col("l.token")) & (
        similarity_bound(F.col("a_tokens"), F.col("b_tokens"), F.col("a_length"), F.col("b_length")) >= threshold - SLACK
    )
    if letters:
        shared = shared_letters(F.col("a_letters"), F.col("b_letters")) / (F.col("a_length") + F.col("b_length"))
        condition = condition & (overlap_share(F.col("a_tokens"), F.col("b_tokens")) * 0.5 + shared >= threshold - SLACK)
    for key in keys:
        condition = condition & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    return left.alias("l").join(right.alias("r"), condition).select(
        "a", "a_rows", "b", "b_rows", overlap_share(F.col("a_tokens"), F.col("b_tokens")).alias("overlap")
    )


def similar_fields(
    names: DataFrame, fields: DataFrame, threshold: float = 0.6, name: str = "name", field: str = "canonical_name"
) -> DataFrame:
    """(name, canonical name, score, fields): similar distinct names, best first, and how many fields bear the name."""
    scored = candidate_pairs(names, fields, threshold, name, field, letters=True).withColumn(
        "_score", F.col("overlap") * 0.5 + sequence_ratio("a", "b") * 0.5
    )
    found = scored.filter(F.col("_score") >= threshold).select(
        F.col("a").alias(name), F.col("b").alias(field), format_half_even("_score", "0.00").cast("double").alias("score"), F.col("b_rows").alias("fields")
    )
    return found.orderBy(name, F.desc("score"), field)


def best_similar(similar: DataFrame, k: int = 5, name: str = "name", field: str = "canonical_name") -> DataFrame:
    """The k best similar names of every name with their rank; equal scores in order of the field's name."""
    return top_k(similar, [name], [F.desc("score"), F.asc(field)], k)
