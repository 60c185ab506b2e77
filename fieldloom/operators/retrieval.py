"""Search over approved mappings and the vocabulary, and what other platforms call a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.prompt import context_line
from fieldloom.functions.text import search_text, text
from fieldloom.operators.bm25 import Index, bm25_search, build_index, build_pair_index
from fieldloom.operators.ordering import HOT_FLOOR, HOT_SHARE, PAGE_SIZE, Load, last_wins, load, ordered_list, ordered_pages, running_sum
from fieldloom.session import materialize

#: Fields up to this many are sent to every task.
BROADCAST_FIELDS = 100_000

FIELD_COLUMNS = ["canonical_name", "data_type", "business_definition", "domain_category"]


def one_per_column(source: DataFrame) -> DataFrame:
    """Platform, name and table of every column id; of a repeated id the last in the column table's order counts."""
    return source.groupBy("column_id").agg(F.max(F.struct("platform_id", "source_table", "column_name")).alias("_c")).select("column_id", "_c.*")


def one_per_field(fields: DataFrame, *columns: str) -> DataFrame:
    """The given columns of every field id; of a repeated id the one with the last name counts."""
    row = F.struct("canonical_name", *[c for c in columns if c != "canonical_name"])
    return fields.groupBy("canonical_id").agg(F.max(row).alias("_f")).select("canonical_id", "_f.*")


def approved_documents(source: DataFrame, approved: DataFrame, fields: DataFrame, doc_id: str = "mapping_id") -> DataFrame:
    """Approved mappings with their column and field; a mapping without column is dropped, a missing field is blank."""
    docs = _described(approved.select(F.col(doc_id).alias("doc_id"), "column_id", "canonical_id"), source, fields, "doc_id")
    return docs.withColumn("search_text", search_text("column_name", "canonical_name", "business_definition"))


def _described(rows: DataFrame, source: DataFrame, fields: DataFrame, *kept: str) -> DataFrame:
    """Rows that name a column and a field, with both; a row without column is dropped, a missing field is blank."""
    columns = one_per_column(source).select("column_id", *[text(c).alias(c) for c in ("platform_id", "column_name", "source_table")])
    canon = one_per_field(fields, *FIELD_COLUMNS)
    # The vocabulary may be large: where a join would send it to every task, it passes through the driver.
    return rows.join(columns, "column_id").join(canon.hint("merge"), "canonical_id", "left").select(
        *kept, "column_id", "platform_id", "column_name", "source_table", "canonical_id",
        *[text(c).alias(c) for c in FIELD_COLUMNS],
    )


def approved_index(source: DataFrame, approved: DataFrame, fields: DataFrame, *kept: str) -> Index:
    """Index of `approved_documents`: a document is the text of a column and that of a field, each cut into tokens once.

    The mappings are written with their ids and the columns `kept`.
    """
    columns = one_per_column(source).select("column_id", search_text("column_name").alias("text"))
    canon = one_per_field(fields, *FIELD_COLUMNS).select("canonical_id", search_text("canonical_name", "business_definition").alias("text"))
    docs = approved.select("mapping_id", "column_id", "canonical_id", *kept)
    return build_pair_index(docs, "mapping_id", "column_id", "canonical_id", columns, canon)


def field_documents(fields: DataFrame) -> DataFrame:
    return fields.select(
        "canonical_id",
        *[text(c).alias(c) for c in FIELD_COLUMNS],
        search_text("canonical_name", "business_definition", "domain_category").alias("search_text"),
    )


def search_approved(
    queries: DataFrame, query_id: str, query_col: str, source: DataFrame, approved: DataFrame, fields: DataFrame,
    k: int = 5, prebuilt: Index | None = None,
) -> DataFrame:
    """The k best approved mappings for every query, with their columns."""
    if not prebuilt:
        # The hits name their columns and fields, so the mappings need not be read again.
        index = approved_index(source, approved, fields)
        hits = materialize(bm25_search(queries, query_id, query_col, index, k, kept=("column_id", "canonical_id")), "hits")
        index.drop()
        return _described(hits, source, fields, "doc_id", query_id, "score", "rank").withColumnRenamed("doc_id", "mapping_id")
    hits = materialize(bm25_search(queries, query_id, query_col, prebuilt, k), "hits")
    # Only mappings that were hit are joined to their columns and fields again.
    found = approved.join(hits.select(F.col("doc_id").alias("mapping_id")).distinct(), "mapping_id", "left_semi")
    docs = approved_documents(source, found, fields)
    return hits.join(docs.drop("search_text"), "doc_id").withColumnRenamed("doc_id", "mapping_id")


def search_fields(
    queries: DataFrame, query_id: str, query_col: str, fields: DataFrame, k: int = 5, prebuilt: Index | None = None
) -> DataFrame:
    """The k best vocabulary fields for every query."""
    docs = field_documents(fields)
    index = prebuilt or build_index(docs, "canonical_id", "search_text")
    hits = bm25_search(queries, query_id, query_col, index, k).withColumnRenamed("doc_id", "canonical_id")
    # As above, the vocabulary is not sent to every task.
    return hits.join(docs.drop("search_text").hint("merge"), "canonical_id")


def links(approved: DataFrame, source: DataFrame, order=("mapping_id",)) -> DataFrame:
    """Approved mappings joined to their columns, one row per mapping."""
    return approved.select("canonical_id", "column_id", *order).join(one_per_column(source), "column_id")


def wanted_links(
    ids: DataFrame, approved: DataFrame, source: DataFrame, order=("mapping_id",), floor: int = HOT_FLOOR, share: int = HOT_SHARE,
    linked: DataFrame | None = None,
) -> tuple[DataFrame, Load]:
    """The links of the wanted fields, and the load of the mappings by field.

    The fields are joined last, by an inner join on distinct ids, so that what groups by field next finds the rows there
    already. Where a field may have very many mappings its rows must not meet in one task: then the wanted fields that have
    mappings are counted, and sent to every task if they are few. `linked` may hold the links, if they are written already.
    """
    approved = approved if linked is None else linked
    wanted = ids.select("canonical_id").distinct()
    found = load(approved.select("canonical_id"), None, floor, share)
    if found.hot:
        wanted = materialize(approved.select("canonical_id").distinct().join(wanted, "canonical_id"), "wanted")
        if wanted.count() <= BROADCAST_FIELDS:
            wanted = F.broadcast(wanted)
    return (links(approved, source, order) if linked is None else linked).join(wanted, "canonical_id"), found


def mapping_order(approved: DataFrame) -> list[Column]:
    """Newest approval first, unknown times last, then the mapping id."""
    oldest = F.lit((1 << 63) - 1)
    newest = [F.coalesce(-F.unix_micros(F.col("approved_at").cast("timestamp")), oldest)] if "approved_at" in approved.columns else []
    return [*newest, F.col("mapping_id")]


def cross_platform(
    ids: DataFrame, approved: DataFrame, source: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """For each canonical id, the columns approved for it as ordered pages of (platform, column, table)."""
    linked, sizes = wanted_links(ids, approved, source)
    entry = F.struct(*[text(c).alias(c) for c in ("platform_id", "column_name", "source_table")])
    return ordered_pages(linked, ["canonical_id"], ["mapping_id"], entry, page_size, "context", sizes=sizes)


def platform_lists(
    approved: DataFrame, source: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """(canonical_id, platform_id, page, names): column names per field and platform, newest approval first."""
    order = ["approved_at", "mapping_id"] if "approved_at" in approved.columns else ["mapping_id"]
    named = links(approved, source, order).filter(
        F.col("platform_id").isNotNull() & (text("platform_id") != "") & (text("column_name") != "")
    )
    return ordered_pages(
        named, ["canonical_id", "platform_id"], mapping_order(approved), "column_name", page_size, "names",
        sizes=approved.select("canonical_id"),
    )


def cross_platform_map(approved: DataFrame, source: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(canonical_id, page, names): platform to column names of each field."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("platform_id").cast("string").alias("p"), "names")))
    return (
        platform_lists(approved, source, page_size)
        .groupBy("canonical_id", "page")
        .agg(F.map_from_entries(pairs).alias("names"))
    )


def merge_ranked(similar: DataFrame, candidates: DataFrame, query_id: str, top: int = 3) -> DataFrame:
    """Field ids among the first `top` of both ranked lists in order of first occurrence, approved mappings first.

    Columns: query id, canonical_id, canonical_name, place.
    """
    columns = [query_id, "canonical_id", "canonical_name", "rank"]
    tagged = (
        similar.select(*columns).withColumn("_list", F.lit(1))
        .unionByName(candidates.select(*columns).withColumn("_list", F.lit(2)))
        .filter((F.col("rank") <= top) & (text("canonical_id") != ""))
    )
    first = tagged.groupBy(query_id, "canonical_id").agg(
        F.min_by("canonical_name", F.struct("_list", "rank")).alias("canonical_name"), F.min(F.struct("_list", "rank")).alias("_at")
    )
    place = F.row_number().over(W.partitionBy(query_id).orderBy("_at"))
    return first.withColumn("place", place).drop("_at")


def context_pieces(
    ids: DataFrame, approved: DataFrame, source: DataFrame, piece_chars: int, floor: int = HOT_FLOOR, share: int = HOT_SHARE,
    linked: DataFrame | None = None,
) -> DataFrame:
    """(canonical_id, start, text, columns): what all platforms call each wanted field, one line per mapping, in pieces.

    A line belongs to the piece that its first character falls into, so a piece has `piece_chars` characters and the rest
    of its last line at most. `start` counts the field's characters before the piece.
    """
    linked, sizes = wanted_links(ids, approved, source, floor=floor, share=share, linked=linked)
    lines = linked.select("canonical_id", "mapping_id", context_line("platform_id", "column_name").alias("line"))
    sized = lines.withColumn("chars", F.length("line").cast("long"))
    summed = running_sum(sized, ["canonical_id"], ["mapping_id"], "chars", "_end", floor, share, sizes, ["canonical_id", "line", "chars"])
    placed = summed.withColumn("_start", F.col("_end") - F.col("chars"))
    return placed.groupBy("canonical_id", F.floor(F.col("_start") / piece_chars).alias("_piece")).agg(
        F.min("_start").alias("start"), F.array_join(ordered_list("line", "_start"), "").alias("text"), F.count("*").alias("columns")
    ).drop("_piece")


def context_sizes(pieces: DataFrame) -> DataFrame:
    """(canonical_id, columns, chars) of every field that has context."""
    return pieces.groupBy("canonical_id").agg(F.sum("columns").alias("columns"), F.sum(F.length("text")).alias("chars"))


def retrieval_context(merged: DataFrame, sizes: DataFrame, query_id: str) -> DataFrame:
    """The merged ids that have context, with its size; of equal names the last wins at the place of the first."""
    found = merged.join(sizes, "canonical_id")
    place = F.min("place").over(W.partitionBy(query_id, "canonical_name"))
    kept = last_wins(found.withColumn("_first", place), [query_id, "canonical_name"], ["place"])
    return kept.drop("place").withColumnRenamed("_first", "place")
