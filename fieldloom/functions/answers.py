"""Model answers: find the JSON object in free text and read it into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FIELDS = ("rationale", "standardized_name", "data_type", "business_definition", "domain_category")


def extract_json(c) -> Column:
    """The span from the first `{` to the last `}`; '' when there is none."""
    return F.regexp_extract(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?s)\{.*\}", 0)


def _field(name: str) -> Column:
    return F.try_variant_get("_doc", f"$[0].{name}", "variant")


def _whole_number(raw: Column) -> Column:
    """Integers and decimals cut toward zero, integer text accepted, booleans as 1 and 0."""
    kind = F.schema_of_variant(raw)
    as_text = F.trim(F.try_variant_get(raw, "$", "string"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("bigint"))
        .when(kind == "BIGINT", F.try_variant_get(raw, "$", "bigint"))
        .when(kind == "STRING", F.when(as_text.rlike(r"^[+-]?[0-9]+\z"), as_text.try_cast("bigint")))
        .otherwise(F.try_variant_get(raw, "$", "double").try_cast("bigint"))
    )


def parse_answers(df, raw: str = "raw_text", fallback: str | None = None):
    """Add the typed answer columns and `error` to every row.

    Defaults apply to missing keys only; an explicit null stays null. A row whose text holds no
    valid JSON object, or whose confidence is no number, keeps the fallback name and gets an error.
    """
    fall = F.col(fallback) if fallback else F.lit("")
    keep = df.columns
    found = df.withColumn("_json", extract_json(raw))
    # In brackets, so that anything after the first object makes the text invalid or a longer array; once more before
    # an end mark, as the parser stops where the brackets close and would overlook what follows.
    found = found.withColumn("_doc", F.try_parse_json(F.concat(F.lit("["), "_json", F.lit("]"))))
    marked = F.try_parse_json(F.concat(F.lit('{"d":'), "_json", F.lit(',"end":0}')))
    found = found.withColumn("_end", F.try_variant_get(marked, "$.end", "bigint")).withColumn(
        "_ok", (F.col("_json") != "") & F.col("_end").isNotNull() & F.col("_doc").isNotNull() & F.try_variant_get("_doc", "$[1]", "variant").isNull()
    ).withColumn("_conf", _field("confidence"))
    found = found.withColumn(
        "confidence", F.when(F.col("_conf").isNull(), F.lit(0).cast("bigint")).otherwise(_whole_number(F.col("_conf")))
    )
    found = found.withColumn(
        "error",
        F.when(F.col("_json") == "", F.concat(F.lit("Failed to parse LLM response: No JSON object found in response: "),
                                              F.substring(F.coalesce(F.col(raw), F.lit("")), 1, 200)))
        .when(~F.col("_ok"), F.lit("Failed to parse LLM response: invalid JSON"))
        .when(F.col("confidence").isNull(), F.lit("confidence is not a whole number")),
    )
    good = F.col("error").isNull()

    def text_value(name, default):
        value = _field(name)
        return F.when(good, F.when(value.isNull(), default).otherwise(F.try_variant_get(value, "$", "string"))).otherwise(
            default
        )

    options = F.try_variant_get("_doc", "$[0].alternatives", "array<variant>")
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    alternatives = F.transform(
        F.when(good, F.coalesce(options, F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>")),
        lambda v: F.struct(*[part(v, n) for n in ("canonical_id", "canonical_name", "confidence", "reason")]),
    )
    columns = [
        F.when(good, F.try_variant_get("_doc", f"$[0].{n}", "string")).alias(n)
        for n in ("recommended_canonical_id", "recommended_canonical_name")
    ]
    columns.append(F.when(good, F.col("confidence")).otherwise(F.lit(0)).alias("confidence"))
    columns += [text_value(n, fall if n == "standardized_name" else F.lit("")).alias(n) for n in TEXT_FIELDS]
    return found.select(*keep, *columns, alternatives.alias("alternatives"), "error")
