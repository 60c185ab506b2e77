"""Steward decisions, new fields and rules, and their audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.display import details_json
from fieldloom.functions.text import stable_id
from fieldloom.operators.similar import best_similar, similar_fields


def audit_events(df: DataFrame, entity_type, entity_id, action, actor, details: Column | None = None, at: Column | None = None) -> DataFrame:
    """One audit row per input row. A given time is part of the id: the same event at another time is another one."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    details = F.lit(None).cast("string") if details is None else details
    rows = df.select(
        as_column(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"), as_column(action).alias("action"),
        as_column(actor).alias("actor"), details.alias("details"), (F.current_timestamp() if at is None else at).alias("created_at"),
    )
    dated = [] if at is None else ["created_at"]
    return rows.select(
        stable_id("entity_type", "entity_id", "action", "actor", "details", *dated).alias("event_id"), *rows.columns
    )


def effective_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision that counts for each proposal, with the field it approves.

    The latest wins, ties by decision id. Approving a proposal without suggestion, or reassigning
    without naming a field, changes nothing and so does not count.
    """
    suggestion = F.col("suggested_canonical_id")
    at = F.struct("decided_at", "decision_id")
    row = F.struct("decision_id", "action", "actor", "decided_at", "canonical_id")
    usable = F.col("action").isin("flag", "reject") | ((F.col("action") == "reassign") & F.col("canonical_id").isNotNull())
    # Two candidates per proposal, both combined before the shuffle: the latest approval and the latest other decision.
    per_proposal = decisions.groupBy("proposal_id").agg(
        F.max_by(F.when(F.col("action") == "approve", row), F.when(F.col("action") == "approve", at)).alias("approval"),
        F.max_by(F.when(usable, row), F.when(usable, at)).alias("other"),
    )
    joined = per_proposal.join(
        proposals.select("proposal_id", "column_id", "suggested_canonical_id"), "proposal_id"
    ).withColumn("approval", F.when(suggestion.isNotNull() & (suggestion.cast("string") != ""), F.col("approval")))
    later = F.coalesce(
        F.struct("approval.decided_at", "approval.decision_id") > F.struct("other.decided_at", "other.decision_id"), F.lit(False)
    )
    chosen = F.when(F.col("other").isNull() | (F.col("approval").isNotNull() & later), F.col("approval")).otherwise(F.col("other"))
    return (
        joined.withColumn("_d", chosen)
        .filter(F.col("_d").isNotNull())
        .select("proposal_id", "column_id", suggestion.alias("suggested"), "_d.decision_id", "_d.action", "_d.actor", "_d.decided_at",
                F.when(F.col("_d.action") == "approve", suggestion).when(F.col("_d.action") == "reassign", F.col("_d.canonical_id")).alias("canonical_id"))
        .withColumn("mapping_id", F.when(F.col("canonical_id").isNotNull(), stable_id("proposal_id", "decision_id")))
    )


def apply_decisions(proposals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals after the decisions, new approved mappings, audit rows). Applying them again gives the same rows."""
    chosen = effective_decisions(proposals, decisions)
    marks = chosen.select(
        "proposal_id", F.col("action").alias("_action"), F.col("actor").alias("_actor"), F.col("decided_at").alias("_at")
    )
    status = (
        F.when(F.col("_action").isin("approve", "reassign"), "approved")
        .when(F.col("_action") == "flag", "flagged")
        .when(F.col("_action") == "reject", "rejected")
        .otherwise(F.col("status"))
    )
    # Flagging is no review: it leaves reviewer and time alone.
    reviewed = F.col("_action").isin("approve", "reassign", "reject")
    after = proposals.join(marks, "proposal_id", "left").withColumns(
        {
            "status": status,
            "reviewed_at": F.when(reviewed, F.col("_at")).otherwise(F.col("reviewed_at")),
            "reviewed_by": F.when(reviewed, F.col("_actor")).otherwise(F.col("reviewed_by")),
        }
    ).select(*proposals.columns)
    mapped = F.col("mapping_id").isNotNull()
    approved = chosen.filter(mapped).select(
        "mapping_id", "column_id", "canonical_id", "proposal_id", F.col("actor").alias("approved_by"), F.col("decided_at").alias("approved_at")
    )
    details = F.when(
        F.col("action") == "approve",
        details_json(canonical_id=F.col("canonical_id"), column_id=F.col("column_id")),
    ).when(
        F.col("action") == "reassign",
        details_json(canonical_id=F.col("canonical_id"), reassigned=~F.col("canonical_id").eqNullSafe(F.col("suggested"))),
    )
    words = F.when(mapped, "approved").when(F.col("action") == "flag", "flagged").otherwise("rejected")
    audit = audit_events(
        chosen,
        F.when(mapped, "mapping").otherwise("proposal"),
        F.coalesce("mapping_id", F.col("proposal_id").cast("string")),
        words, F.col("actor"), details, F.col("decided_at"),
    )
    return after, approved, audit


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of every row, equal rows told apart by `_copy`, so that each gets an id of its own."""
    copies = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    return copies.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))


def register_fields(new: DataFrame, fields: DataFrame, actor: str, threshold: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new vocabulary rows, the five most similar existing names as warnings, audit rows). Similar names only warn."""
    named = _numbered(
        new.filter(F.coalesce(F.col("canonical_name"), F.lit("")) != ""),
        ["canonical_name", "data_type", "business_definition", "domain_category"],
    )
    created = named.select(
        stable_id("canonical_name", "data_type", "business_definition", "domain_category", "_copy").alias("canonical_id"),
        "canonical_name", "data_type", "business_definition", "domain_category",
        F.lit(True).alias("is_active"), F.lit(actor).alias("created_by"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    found = similar_fields(named.select(F.col("canonical_name").alias("new_name")), fields, threshold, "new_name")
    warnings = best_similar(found, 5, "new_name")
    audit = audit_events(created, "canonical", F.col("canonical_id"), "created", actor, details_json(name=F.col("canonical_name")))
    return created, warnings, audit


def register_rules(new: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """(new abbreviation rules, audit rows); pattern and replacement must be filled."""
    filled = (F.coalesce(F.col("pattern"), F.lit("")) != "") & (F.coalesce(F.col("replacement"), F.lit("")) != "")
    created = _numbered(new.filter(filled), ["pattern", "replacement", "description"]).select(
        stable_id(F.lit("abbreviation"), "pattern", "replacement", "description", "_copy").alias("rule_id"),
        F.lit("abbreviation").alias("rule_type"), "pattern", "replacement", "description", F.lit(True).alias("is_active"),
    )
    details = details_json(pattern=F.col("pattern"), replacement=F.col("replacement"))
    return created, audit_events(created, "rule", F.col("rule_id"), "created", actor, details)
