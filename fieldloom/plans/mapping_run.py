"""A mapping run over all unmapped columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.answers import parse_answers
from fieldloom.functions.display import confidence_band, details_json
from fieldloom.functions.text import stable_id, text
from fieldloom.operators.intake import unmapped
from fieldloom.operators.match import fast_match
from fieldloom.operators.review import audit_events
from fieldloom.operators.rules import active_abbreviations, standardize_headers
from fieldloom.plans.model_calls import answer
from fieldloom.plans.prompts import SearchIndexes, build_prompts
from fieldloom.session import drop_written, materialize, recorded
from fieldloom.settings import Settings

MATCH = ["column_id", "column_name", "canonical_id", "canonical_name", "confidence", "rationale", "agent_model"]


@dataclass(frozen=True)
class Run:
    proposals: DataFrame
    audit: DataFrame
    prompts: DataFrame | None = None
    written: tuple[str, ...] = ()

    def drop(self) -> None:
        """Remove what the run wrote to the shared folder, once its frames are stored elsewhere."""
        drop_written(self.proposals.sparkSession, self.written)


def join_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers back to their prompts; answers to unknown columns are skipped, of several to one column the greatest text counts."""
    return prompts.join(responses.groupBy("column_id").agg(F.max("raw_text").alias("raw_text")), "column_id")


def to_proposals(matches: DataFrame, batch_id: str, settings: Settings = Settings()) -> DataFrame:
    """Proposal rows with confidence band, shortened rationale and open status."""
    return matches.select(
        stable_id(F.lit(batch_id), "column_id").alias("proposal_id"),
        "column_id",
        F.col("canonical_id").alias("suggested_canonical_id"),
        F.col("canonical_name").alias("suggested_canonical_name"),
        F.col("confidence").cast("double").alias("confidence"),
        confidence_band("confidence", settings.high_min, settings.medium_min).alias("confidence_level"),
        F.substring(text("rationale"), 1, settings.rationale_length).alias("reasoning"),
        "agent_model",
        F.lit(batch_id).alias("batch_id"),
        F.lit("pending_review").alias("status"),
        F.lit(None).cast("string").alias("assigned_to"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
        F.lit(None).cast("string").alias("reviewed_by"),
    )


def proposal_audit(matches: DataFrame, batch_id: str) -> DataFrame:
    details = details_json(column=F.col("column_name"), confidence=F.col("confidence"))
    return audit_events(matches, "proposal", stable_id(F.lit(batch_id), "column_id"), "created", "agent_batch", details)


def typed_answers(answers: DataFrame, id_type) -> DataFrame:
    """Answers with the field id in the vocabulary's type; an id that is none of that type is the row's error."""
    raw, cast = F.col("recommended_canonical_id"), F.col("recommended_canonical_id").try_cast(id_type)
    bad = (text(raw) != "") & cast.isNull()
    error = F.coalesce("error", F.when(bad, F.concat(F.lit("field id is not of type "), F.lit(id_type.simpleString()), F.lit(": "), raw)))
    return answers.withColumns(
        {"error": error, "confidence": F.when(bad, 0).otherwise(F.col("confidence")), "recommended_canonical_id": cast}
    )


def answer_matches(answers: DataFrame, settings: Settings, keep_errors: bool) -> DataFrame:
    """Parsed answers as matches; rows in error are left for the next run, or kept at confidence 0."""
    if not keep_errors:
        answers = answers.filter(F.col("error").isNull())
    return answers.select(
        "column_id", "column_name",
        F.col("recommended_canonical_id").alias("canonical_id"), F.col("recommended_canonical_name").alias("canonical_name"),
        "confidence", "rationale", F.lit(settings.model).alias("agent_model"),
    )


def fast_path(pending: DataFrame, fields: DataFrame, abbreviations: DataFrame | None, settings: Settings, order: str) -> DataFrame:
    """Every pending column with its name match, if any."""
    named = standardize_headers(pending, "column_name", abbreviations)
    return fast_match(
        named, fields, order, exact_confidence=settings.exact_confidence, near_confidence=settings.near_confidence
    )


def run_mapping(
    source: DataFrame, approved: DataFrame, fields: DataFrame, rules: DataFrame | None, proposals: DataFrame, platforms: DataFrame,
    batch_id: str, responses: DataFrame | None = None, complete: Callable[[pd.Series], pd.Series] | None = None,
    settings: Settings = Settings(), use_fast_path: bool = True, keep_errors: bool = False, order: str = "canonical_id",
    indexes: SearchIndexes | None = None, k: int = 5, kept: str | None = None,
) -> Run:
    """Propose a field for every unmapped column: by name where possible, else from the model's answer.

    Answers come as a table `responses` (column_id, raw_text) or from `complete`, which maps a series
    of prompts to a series of texts. With a table at hand no prompts are built. With neither, the run
    proposes the name matches and returns the prompts. A column without answer stays unmapped. `kept` names a folder of
    the model's finished answers: those are not asked for again.
    """
    with recorded() as written:
        run = _mapped(
            source, approved, fields, rules, proposals, platforms, batch_id, responses, complete, settings, use_fast_path,
            keep_errors, order, indexes, k, kept,
        )
    return replace(run, written=tuple(written))


def _mapped(
    source, approved, fields, rules, proposals, platforms, batch_id, responses, complete, settings, use_fast_path, keep_errors,
    order, indexes, k, kept,
) -> Run:
    abbreviations = active_abbreviations(rules) if rules is not None else None
    pending = unmapped(source, approved, proposals)
    matches = None
    if use_fast_path:
        tried = materialize(fast_path(pending, fields, abbreviations, settings, order), "fast-path")
        named = tried.filter(F.col("match_kind").isNotNull())
        matches = named.withColumn("agent_model", F.lit("deterministic")).select(*MATCH)
        open_columns = tried.filter(F.col("match_kind").isNull()).select(*source.columns)
    else:
        open_columns = materialize(pending, "pending")
    prompts = None
    if responses is None:
        prompts = build_prompts(open_columns, source, approved, fields, abbreviations, platforms, k, indexes)
        if complete is not None:
            prompts = materialize(prompts, "prompts")
            # Written once: a model is neither free nor sure to answer the same twice.
            responses = materialize(answer(prompts, complete, kept, settings.max_calls, settings.attempts), "responses")
    if responses is not None:
        answers = parse_answers(join_responses(open_columns.select("column_id", "column_name"), responses))
        found = answer_matches(typed_answers(answers, fields.schema["canonical_id"].dataType), settings, keep_errors)
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        matches = open_columns.limit(0).select(
            "column_id", "column_name", F.lit(None).cast(fields.schema["canonical_id"].dataType).alias("canonical_id"),
            *[F.lit(None).cast(t).alias(n) for n, t in
              (("canonical_name", "string"), ("confidence", "bigint"), ("rationale", "string"), ("agent_model", "string"))],
        )
    return Run(to_proposals(matches, batch_id, settings), proposal_audit(matches, batch_id), prompts)
