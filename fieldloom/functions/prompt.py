"""Prompt text as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.display import format_half_even
from fieldloom.functions.text import text

# The wording of the prompt.
INTRODUCTION = [
    "You are a data standardization expert at a financial services firm.",
    "",
    "TASK: Given a source column, recommend the best canonical field.",
    "Use all the context below to make your decision.",
    "",
]
RULES_TITLE = "ACTIVE ABBREVIATION RULES:"
SIMILAR_TITLE = "SIMILAR APPROVED MAPPINGS (from other platforms):"
CANDIDATES_TITLE = "CANDIDATE CANONICAL FIELDS:"
CONTEXT_TITLE = "CROSS-PLATFORM CONTEXT FOR TOP CANDIDATES:"
INSTRUCTIONS = """
INSTRUCTIONS:
- Pick the best canonical field from the candidates above.
- If no candidate is appropriate, set recommended_canonical_id to null.
- Provide a clear rationale citing the evidence.
- Suggest a standardized_name, data_type, business_definition, domain_category.
- List up to 3 alternative canonical matches with reasons.

Output ONLY valid JSON:
{
  "recommended_canonical_id": "cf_xxx" or null,
  "recommended_canonical_name": "field_name" or null,
  "confidence": 0-100,
  "rationale": "...",
  "standardized_name": "snake_case_name",
  "data_type": "string|integer|decimal|date|timestamp|boolean",
  "business_definition": "1-2 sentence definition",
  "domain_category": "Fund|Valuation|Investor|Capital|Fees|Transaction|Security|Position|Reporting|Operations",
  "alternatives": [
    {"canonical_id": "...", "canonical_name": "...", "confidence": 0-100, "reason": "..."}
  ]
}"""


def _score(c) -> Column:
    return format_half_even(c, "0.0")


def _section(title: str, lines: Column) -> Column:
    """A titled block after a blank line; null, and so left out, when there are no lines."""
    return F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(""), F.lit(title), lines))


def rules_section(abbreviations: dict[str, str] | None) -> Column:
    if not abbreviations:
        return F.lit(None).cast("string")
    return F.lit("\n".join(["", RULES_TITLE, *[f"  {p} -> {r}" for p, r in sorted(abbreviations.items())]]))


def similar_section(hits: Column) -> Column:
    """`hits`: array of (rank, column_name, platform_id, canonical_name, score) in rank order."""
    line = lambda h: F.concat(
        F.lit("  "), h.rank.cast("string"), F.lit('. "'), text(h.column_name), F.lit('" ('), text(h.platform_id),
        F.lit(") -> canonical: "), text(h.canonical_name), F.lit(" [score: "), _score(h.score), F.lit("]"),
    )
    return _section(SIMILAR_TITLE, F.transform(hits, line))


def candidates_section(hits: Column) -> Column:
    """`hits`: array of (rank, canonical_name, data_type, domain_category, business_definition, score) in rank order."""
    line = lambda h: F.concat(
        F.lit("  "), h.rank.cast("string"), F.lit(". "), text(h.canonical_name), F.lit(" ("), text(h.data_type), F.lit(", "),
        text(h.domain_category), F.lit(') - "'), text(h.business_definition), F.lit('" [score: '), _score(h.score), F.lit("]"),
    )
    return _section(CANDIDATES_TITLE, F.transform(hits, line))


def context_line(platform_id, column_name) -> Column:
    """What one platform calls a field, as a line of its own."""
    return F.concat(F.lit("\n    - "), text(platform_id), F.lit(': "'), text(column_name), F.lit('"'))


def context_name(canonical_name) -> Column:
    return F.concat(F.lit("\n  "), text(canonical_name), F.lit(":"))


def opening(column_name, platform_name, standardized, rules, similar, candidates, has_context) -> Column:
    """The prompt up to the lines of the cross-platform context; sections that are null are left out."""
    head = [F.lit(line) for line in INTRODUCTION]
    return F.concat_ws(
        "\n",
        *head,
        F.concat(F.lit("PLATFORM: "), text(platform_name)),
        F.concat(F.lit('SOURCE COLUMN: "'), text(column_name), F.lit('"')),
        F.concat(F.lit('RULE-STANDARDIZED: "'), text(standardized), F.lit('"')),
        rules, similar, candidates, F.when(has_context, F.lit("\n" + CONTEXT_TITLE)),
    )


#: What ends every prompt.
CLOSING = "\n" + INSTRUCTIONS
