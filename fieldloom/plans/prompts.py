"""Retrieval and prompt for every header of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import prompt as P
from fieldloom.functions.text import query_text
from fieldloom.operators.bm25 import Index, build_index
from fieldloom.operators.coverage import with_label
from fieldloom.operators.ordering import PAGE_SIZE, ordered_list
from fieldloom.operators.retrieval import (
    approved_index,
    context_pieces,
    context_sizes,
    field_documents,
    links,
    merge_ranked,
    retrieval_context,
    search_approved,
    search_fields,
)
from fieldloom.operators.rules import abbreviation_map, standardize_headers
from fieldloom.session import materialize

#: Characters of context that start in one part of a prompt; a context is kept in pieces of a sixteenth of that.
PART_CHARS = 1 << 16


@dataclass(frozen=True)
class SearchIndexes:
    """Indexes of the approved mappings and the vocabulary, built once for many runs."""

    approved: Index
    fields: Index


def prepare_indexes(source: DataFrame, approved: DataFrame, fields: DataFrame) -> SearchIndexes:
    return _indexes(source, approved, approved, fields)


def _indexes(source: DataFrame, mappings: DataFrame, approved: DataFrame, fields: DataFrame, *kept: str) -> SearchIndexes:
    # Of the vocabulary only mapped fields are texts of mappings.
    mapped = fields.join(materialize(approved.select("canonical_id").distinct(), "mapped"), "canonical_id", "left_semi")
    return SearchIndexes(
        approved_index(source, mappings, mapped, *kept),
        build_index(field_documents(fields), "canonical_id", "search_text"),
    )


@dataclass(frozen=True)
class Retrieval:
    headers: DataFrame  # header, standardized, query_text: each distinct header once
    similar: DataFrame
    candidates: DataFrame
    merged: DataFrame
    pieces: DataFrame  # canonical_id, start, text, columns
    sizes: DataFrame  # canonical_id, columns, chars


def retrieve(
    headers: DataFrame, source: DataFrame, approved: DataFrame, fields: DataFrame, abbreviations: DataFrame | None = None,
    k: int = 5, indexes: SearchIndexes | None = None, piece_chars: int = PART_CHARS // 16,
) -> Retrieval:
    """Search both indexes once per distinct header and gather what other platforms call the best fields."""
    distinct = headers.select(F.coalesce("column_name", F.lit("")).alias("header")).distinct()
    named = standardize_headers(distinct, "header", abbreviations)
    asked = materialize(named.withColumn("query_text", query_text("header", "standardized")), "headers")
    # Index, hits and context read the mappings' links as they are written once.
    linked = links(approved, source).drop("source_table")
    if indexes:
        linked = materialize(linked, "linked")
    else:
        indexes = _indexes(source, linked, approved, fields, "platform_id", "column_name")
        linked = indexes.approved.documents.withColumnRenamed("doc_id", "mapping_id")
    similar = materialize(
        search_approved(asked, "header", "query_text", source, linked, fields, k, indexes.approved), "similar"
    )
    candidates = materialize(search_fields(asked, "header", "query_text", fields, k, indexes.fields), "candidates")
    merged = materialize(merge_ranked(similar, candidates, "header"), "merged")
    # Each field's context is cut once, however many headers show it.
    pieces = materialize(context_pieces(merged, approved, source, piece_chars, linked=linked), "context")
    return Retrieval(asked, similar, candidates, merged, pieces, materialize(context_sizes(pieces), "context-sizes"))


def _listed(df: DataFrame, key: str, order: str, columns: list[str], out: str) -> DataFrame:
    """At most k rows per header as an array in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias(out))


def context_parts(found: Retrieval, shown: DataFrame, part_chars: int) -> DataFrame:
    """(header, part, body): the prompt of every header after its opening, in parts of bounded length.

    Offsets need no sum over a prompt's pieces: a piece starts at its place in the field's context plus the lengths of the
    few fields shown before. A piece belongs to the part in which it starts.
    """
    name = P.context_name("canonical_name")
    sized = shown.withColumn("name", name).withColumn("_chars", F.length("name") + F.col("chars"))
    before = W.partitionBy("header").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("_at", F.coalesce(F.sum("_chars").over(before), F.lit(0)))
    names = placed.select("header", F.col("_at").alias("start"), F.col("name").alias("text"))
    lines = placed.join(found.pieces.withColumnRenamed("start", "_of"), "canonical_id").select(
        "header", (F.col("_at") + F.length("name") + F.col("_of")).alias("start"), "text"
    )
    total = found.headers.join(sized.groupBy("header").agg(F.sum("_chars").alias("_all")), "header", "left").select(
        "header", F.coalesce("_all", F.lit(0)).alias("start")
    )
    first, last = total.select("header", F.lit(0).cast("long").alias("start"), F.lit("").alias("text")), total.withColumn("text", F.lit(P.CLOSING))
    pieces = names.unionByName(lines).unionByName(first).unionByName(last)
    return pieces.groupBy("header", F.floor(F.col("start") / part_chars).cast("long").alias("part")).agg(
        F.array_join(ordered_list("text", "start"), "").alias("body")
    )


def build_prompts(
    headers: DataFrame, source: DataFrame, approved: DataFrame, fields: DataFrame, rules: DataFrame | None, platforms: DataFrame,
    k: int = 5, indexes: SearchIndexes | None = None, page_size: int = PAGE_SIZE, part_chars: int = PART_CHARS,
) -> DataFrame:
    """The prompt of every header row (column_id, column_name, platform_id) in numbered parts, `part` from 0.

    `rules` are (pattern, replacement). Parts joined in order are the prompt (`whole_prompts`). Part 0 has the opening, whose
    length follows k and the rules; context is cut at lines, `part_chars` characters and at most a piece more to a part, so
    no row grows with the mappings of a field. Only a line longer than a part leaves out a number. `context_pages` tells how
    many pages of `page_size` lines the longest context among the found fields has.
    """
    found = retrieve(headers, source, approved, fields, rules, k, indexes, max(1, part_chars // 16))
    shown = materialize(retrieval_context(found.merged, found.sizes, "header"), "shown")
    pages = found.merged.join(found.sizes, "canonical_id").groupBy("header").agg(F.ceil(F.max("columns") / page_size).cast("int").alias("context_pages"))
    # Every prompt holds all active rules: a set that fits a prompt fits the driver.
    table = abbreviation_map(rules, None) if rules is not None else {}
    per_header = (
        found.headers
        .join(_listed(found.similar, "header", "rank", ["column_name", "platform_id", "canonical_name", "score"], "similar"), "header", "left")
        .join(_listed(found.candidates, "header", "rank", ["canonical_name", "data_type", "domain_category", "business_definition", "score"], "candidates"), "header", "left")
        .join(pages, "header", "left")
        .join(shown.select("header").distinct().withColumn("_shown", F.lit(True)), "header", "left")
        .select(
            "header", "standardized", F.coalesce("context_pages", F.lit(0)).alias("context_pages"),
            P.similar_section(F.col("similar")).alias("similar"),
            P.candidates_section(F.col("candidates")).alias("candidates"),
            F.coalesce("_shown", F.lit(False)).alias("_shown"),
        )
    )
    rows = with_label(headers.withColumn("header", F.coalesce("column_name", F.lit(""))), platforms, out="platform_name")
    opening = P.opening(
        "column_name", "platform_name", "standardized", P.rules_section(table), F.col("similar"), F.col("candidates"), F.col("_shown")
    )
    # Only part 0 carries the opening's texts to the rows.
    parts = context_parts(found, shown, part_chars).join(per_header, "header")
    prompt = F.when(F.col("part") == 0, F.concat(opening, "body")).otherwise(F.col("body"))
    return rows.join(parts, "header").select(
        "column_id", "column_name", "platform_id", "platform_name", "standardized", "context_pages", "part", prompt.alias("prompt")
    )


def whole_prompts(prompts: DataFrame) -> DataFrame:
    """(column_id, prompt): each prompt in one text, for a model that takes it so."""
    return prompts.groupBy("column_id").agg(F.array_join(ordered_list("prompt", "part"), "").alias("prompt"))
