"""Reports in long form: one header row per key, and one frame of numbered entries, whatever a key's size.

A cell that lists names has one entry row per name, numbered from 1 in the order the cell shows them, so no row grows with
the data, figures stand once, and any number of platforms fits without a pivot. `cell_pages` makes texts of entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.display import contains_text, leaf_name, title_words
from fieldloom.functions.text import text
from fieldloom.operators.coverage import matrix_links, with_label
from fieldloom.operators.ordering import PAGE_SIZE, ordered_list, rank_in_group
from fieldloom.operators.retrieval import links, mapping_order, one_per_column, one_per_field, wanted_links
from fieldloom.session import materialize


@dataclass(frozen=True)
class Report:
    headers: DataFrame
    listed: DataFrame  # what the entries list, before it is ranked
    ranked: Callable[[], DataFrame]

    @cached_property
    def entries(self) -> DataFrame:
        """The numbered entries; they are counted and ranked when first asked for."""
        return self.ranked()


def _cell_entries(linked: DataFrame, approved: DataFrame, platforms: DataFrame, sizes) -> DataFrame:
    """(canonical_id, platform_id, platform, entry, column_name): the names of every cell, newest approval first."""
    cell = ["canonical_id", "platform_id"]
    ranked = rank_in_group(linked, cell, mapping_order(approved), "entry", sizes=sizes, kept=[*cell, "column_name"])
    return with_label(ranked, platforms).select("canonical_id", "platform_id", "platform", "entry", text("column_name").alias("column_name"))


def matrix_report(approved: DataFrame, source: DataFrame, fields: DataFrame, platforms: DataFrame) -> Report:
    """Fields with their platforms and mappings counted; entries are the columns mapped to a field on a platform."""
    linked = matrix_links(approved, source)
    per_field = (
        linked.groupBy("canonical_id", "platform_id").agg(F.count("*").alias("n"))
        .groupBy("canonical_id").agg(F.count("*").alias("covered"), F.sum("n").alias("links"))
    )
    names = one_per_field(fields, "domain_category", "data_type")
    headers = per_field.join(names, "canonical_id", "left").select(
        "canonical_id", F.coalesce("canonical_name", F.col("canonical_id").cast("string")).alias("canonical_field"),
        text("domain_category").alias("domain"), text("data_type").alias("type"), "covered", "links",
        F.concat("covered", F.lit(f"/{platforms.count()}")).alias("coverage"), text("canonical_name").alias("sort_name"),
    )
    return Report(headers, linked, lambda: _cell_entries(linked, approved, platforms, approved.select("canonical_id")))


def worklist_report(joined: DataFrame, approved: DataFrame, source: DataFrame, platforms: DataFrame) -> Report:
    """One row per proposal; the entries of the suggested fields stand once, however many proposals suggest a field.

    `joined` are proposals with column and field (`worklist.joined_proposals`), filtered or not; `names` counts the entries
    of the suggested field.
    """
    wanted = joined.select(F.col("suggested_canonical_id").alias("canonical_id"))
    order = [c for c in ("approved_at", "mapping_id") if c in approved.columns]
    filled = (text("platform_id") != "") & (text("column_name") != "")
    named = links(approved, source, order).filter(filled)

    def entries() -> DataFrame:
        linked, sizes = wanted_links(wanted, approved, source, order)
        return _cell_entries(linked.filter(filled), approved, platforms, sizes)

    # Fields that nobody suggests are counted too, which is less than finding them out before.
    counts = named.groupBy(F.col("canonical_id").alias("_cid")).agg(F.count("*").alias("_names"))
    rows = with_label(joined, platforms).join(counts, F.col("suggested_canonical_id") == F.col("_cid"), "left")
    headers = rows.select(
        "proposal_id", "suggested_canonical_id", text(F.coalesce("canonical_name", "suggested_canonical_name")).alias("suggested_match"),
        title_words("confidence_level").alias("confidence"), text("column_name").alias("header"), text("platform").alias("platform"),
        leaf_name("source_table").alias("source_table"), title_words("status").alias("status"), F.coalesce("_names", F.lit(0)).alias("names"),
    )
    return Report(headers, named.join(wanted.distinct(), "canonical_id"), entries)


def profile_report(platforms: DataFrame, source: DataFrame, proposals: DataFrame, approved: DataFrame) -> Report:
    """Platforms with their tables, columns, proposals and approvals counted once; entries are their tables by name."""
    owner = one_per_column(source).select("column_id", "platform_id")
    per_column = (
        proposals.groupBy("column_id").agg(F.count("*").alias("proposals"), F.lit(0).cast("bigint").alias("approved"))
        .unionByName(approved.groupBy("column_id").agg(F.lit(0).cast("bigint").alias("proposals"), F.count("*").alias("approved")))
    )
    counts = per_column.join(owner, "column_id").groupBy("platform_id").agg(F.sum("proposals").alias("proposals"), F.sum("approved").alias("approved"))
    # Columns per table first, so that both the count of tables and their list come from few rows.
    tables = materialize(source.groupBy("platform_id", leaf_name("source_table").alias("table")).agg(F.count("*").alias("n")), "tables")
    sizes = tables.groupBy("platform_id").agg(F.count(F.when(F.col("table") != "", 1)).alias("tables"), F.sum("n").alias("columns"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    headers = platforms.join(sizes, "platform_id", "left").join(counts, "platform_id", "left").select(
        "platform_id", F.col("name").alias("platform"), "description", "location", zero("tables"), zero("columns"), zero("proposals"), zero("approved")
    )
    listed = tables.filter("table != ''").join(platforms.select("platform_id"), "platform_id", "left_semi")
    ranked = lambda: rank_in_group(listed, ["platform_id"], ["table"], "entry").select("platform_id", "entry", "table", F.col("n").alias("columns"))
    return Report(headers, listed, ranked)


def filter_matrix_report(report: Report, search: str = "", platform_id=None) -> Report:
    """Fields that hold the text in their name or any entry, and have an entry on one platform; with all their entries."""
    found = contains_text(search, "column_name") if search else F.lit(False)
    filled = (F.col("platform_id") == platform_id) & (text("column_name") != "") if platform_id is not None else F.lit(False)
    # Both are asked of the names in one go; neither needs their ranks.
    hits = report.listed.filter(found | filled).groupBy(F.col("canonical_id").alias("_hit")).agg(F.max(found).alias("_found"), F.max(filled).alias("_filled"))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = (contains_text(search, "canonical_field") | true("_found") if search else F.lit(True)) & (true("_filled") if platform_id is not None else F.lit(True))
    headers = report.headers.join(hits, F.col("canonical_id") == F.col("_hit"), "left").filter(kept).select(*report.headers.columns)
    fields = headers.select("canonical_id")
    return Report(headers, report.listed.join(fields, "canonical_id", "left_semi"), lambda: report.entries.join(fields, "canonical_id", "left_semi"))


def cell_pages(entries: DataFrame, keys: list[str], value: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """(keys, page, names, cell): the entries of every key as texts of at most `page_size` values, page 0 first."""
    page = F.floor((F.col("entry") - 1) / page_size).cast("bigint")
    return entries.groupBy(*keys, page.alias("page")).agg(
        F.count("*").alias("names"), F.array_join(ordered_list(value, "entry"), ", ").alias("cell")
    )
