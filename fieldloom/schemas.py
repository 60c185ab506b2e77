"""Schemas of the metadata tables."""

from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampType

_TYPES = {"boolean": BooleanType(), "double": DoubleType(), "timestamp": TimestampType()}


def _schema(text: str) -> StructType:
    fields = []
    for part in text.split():
        name, _, kind = part.partition(":")
        fields.append(StructField(name, _TYPES.get(kind, StringType())))
    return StructType(fields)


CANONICAL_FIELDS = _schema(
    "canonical_id canonical_name data_type business_definition domain_category "
    "is_active:boolean created_by created_at:timestamp updated_at:timestamp"
)
SOURCE_COLUMNS = _schema(
    "column_id platform_id source_table column_name data_type batch_id detected_at:timestamp"
)
MAPPING_PROPOSALS = _schema(
    "proposal_id column_id suggested_canonical_id suggested_canonical_name confidence:double "
    "confidence_level reasoning agent_model batch_id status assigned_to "
    "created_at:timestamp reviewed_at:timestamp reviewed_by"
)
APPROVED_MAPPINGS = _schema("mapping_id column_id canonical_id proposal_id approved_by approved_at:timestamp")
AUDIT_LOG = _schema("event_id entity_type entity_id action actor details created_at:timestamp")
STANDARDIZATION_RULES = _schema("rule_id rule_type pattern replacement description is_active:boolean")

TABLES = {
    "canonical_fields": CANONICAL_FIELDS,
    "source_columns": SOURCE_COLUMNS,
    "mapping_proposals": MAPPING_PROPOSALS,
    "approved_mappings": APPROVED_MAPPINGS,
    "audit_log": AUDIT_LOG,
    "standardization_rules": STANDARDIZATION_RULES,
}

# Tables a run fills, emptied on reset.
RUN_TABLES = ("source_columns", "mapping_proposals", "approved_mappings", "audit_log")

# Fixed read order of each table: (column, descending).
READ_ORDER = {
    "canonical_fields": [("canonical_name", False)],
    "source_columns": [("platform_id", False), ("source_table", False), ("column_name", False)],
    "mapping_proposals": [("confidence", True)],
    "approved_mappings": [("approved_at", True)],
    "audit_log": [("created_at", True)],
    "standardization_rules": [("rule_type", False), ("pattern", False)],
}

# Seed file layouts: the lock flag becomes the active flag on load.
SEED_FIELDS = _schema(
    "canonical_id canonical_name data_type business_definition domain_category is_locked:boolean created_by"
)
SEED_RULES = STANDARDIZATION_RULES
