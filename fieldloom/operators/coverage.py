"""Coverage reports: matrix, totals, platforms, registry, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.display import contains_text, leaf_name, percent, preview, title_words
from fieldloom.functions.text import text
from fieldloom.operators.ordering import PAGE_SIZE, ordered_pages
from fieldloom.operators.retrieval import links, mapping_order, one_per_column, one_per_field
from fieldloom.settings import Platform


def active_fields(fields: DataFrame) -> DataFrame:
    """Fields flagged active, or not flagged at all."""
    return fields.filter(F.coalesce(F.col("is_active"), F.lit(True)))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def with_label(df: DataFrame, platforms: DataFrame, id_col: str = "platform_id", out: str = "platform") -> DataFrame:
    """Add the platform's display name, falling back to its id."""
    labels = platforms.select(F.col("platform_id").alias("_pid"), F.col("name").alias("_pname"))
    return (
        df.join(labels, F.col(id_col) == F.col("_pid"), "left")
        .withColumn(out, F.coalesce("_pname", F.col(id_col).cast("string")))
        .drop("_pid", "_pname")
    )


def run_kpis(source: DataFrame, proposals: DataFrame) -> DataFrame:
    """Columns, columns without any proposal, pending and approved proposals."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    # One row per column id from either side, so each table is read once.
    columns = source.groupBy("column_id").agg(F.count("*").alias("columns"))
    asked = proposals.groupBy(F.col("column_id").alias("_asked")).agg(
        F.count("*").alias("proposals"), status("pending_review").alias("pending"), status("approved").alias("done")
    )
    return columns.join(asked, F.col("column_id") == F.col("_asked"), "full").agg(
        count("columns").alias("source_columns"),
        count(F.when(F.col("proposals").isNull(), F.col("columns"))).alias("unmapped"),
        count("pending").alias("pending_review"),
        count("done").alias("approved"),
    )


def platform_profile(
    platforms: DataFrame, source: DataFrame, proposals: DataFrame, approved: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Per configured platform its tables, columns, proposals and approvals.

    A platform of over `page_size` tables goes on over further pages; its counts stand on page 0 only, so sums are right.
    """
    owner = one_per_column(source).select("column_id", "platform_id")
    columns = source.groupBy("platform_id").agg(F.count("*").alias("columns"))
    # Pre-aggregated per column, so a column with very many rows is one row in the join.
    per_column = (
        proposals.groupBy("column_id").agg(F.count("*").alias("proposals"), F.lit(0).cast("bigint").alias("approved"))
        .unionByName(
            approved.groupBy("column_id").agg(F.lit(0).cast("bigint").alias("proposals"), F.count("*").alias("approved"))
        )
    )
    counts = (
        per_column.join(owner, "column_id")
        .groupBy("platform_id")
        .agg(F.sum("proposals").alias("proposals"), F.sum("approved").alias("approved"))
    )
    leaves = source.select("platform_id", leaf_name("source_table").alias("leaf")).filter("leaf != ''").distinct()
    tables = ordered_pages(leaves, ["platform_id"], ["leaf"], "leaf", page_size, "tables")
    zero = lambda c: F.when(F.coalesce("page", F.lit(0)) == 0, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c)
    return (
        platforms.join(columns, "platform_id", "left").join(counts, "platform_id", "left").join(tables, "platform_id", "left")
        .select(
            "platform_id", F.col("name").alias("platform"), "description", "location",
            F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce(F.array_join("tables", ", "), F.lit("--")).alias("tables"),
            zero("columns"), zero("proposals"), zero("approved"),
        )
    )


def batch_summary(source: DataFrame, approved: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per platform the distinct columns, approved columns and columns pending review."""
    columns = source.select("platform_id", "column_id").distinct()
    done = approved.select("column_id").distinct().withColumn("_mapped", F.lit(1))
    pending = proposals.filter(F.col("status") == "pending_review").select("column_id").distinct().withColumn("_pending", F.lit(1))
    return (
        columns.join(done, "column_id", "left").join(pending, "column_id", "left")
        .groupBy("platform_id")
        .agg(
            F.count("column_id").alias("total_columns"),
            F.count("_mapped").alias("mapped_columns"),
            F.count("_pending").alias("pending_proposals"),
        )
    )


def matrix_links(approved: DataFrame, source: DataFrame) -> DataFrame:
    """The mappings that name a field, with their columns."""
    order = [c for c in ("approved_at", "mapping_id") if c in approved.columns]
    known = approved.filter(text("canonical_id") != "")
    return links(known, source, order)


def coverage_matrix(
    approved: DataFrame, source: DataFrame, fields: DataFrame, platforms: list[Platform], page_size: int = PAGE_SIZE
) -> DataFrame:
    """Fields against platforms; a cell lists the mapped column names, newest approval first.

    A cell of over `page_size` names continues on the field's next page; the coverage stands on page 0 only.
    `reports.matrix_report` gives one row per field.
    """
    linked = matrix_links(approved, source)
    pages = ordered_pages(
        linked, ["canonical_id", "platform_id"], mapping_order(approved), text("column_name"), page_size, "names",
        sizes=approved.select("canonical_id"),
    )
    # Every platform of a field has a page 0, so the cells of that page are the platforms covered.
    cells = (
        pages.withColumn("cell", F.array_join("names", ", "))
        .groupBy("canonical_id", "page")
        .agg(
            *[F.first(F.when(F.col("platform_id") == p.id, F.col("cell")), ignorenulls=True).alias(f"{p.id}") for p in platforms],
            F.count("*").alias("_covered"),
        )
    )
    names = one_per_field(fields, "domain_category", "data_type")
    return (
        cells.join(names, "canonical_id", "left")
        .select(
            "canonical_id",
            F.coalesce("canonical_name", F.col("canonical_id").cast("string")).alias("canonical_field"),
            text("domain_category").alias("domain"),
            text("data_type").alias("type"),
            "page",
            *[text(F.col(f"`{p.id}`")).alias(p.name) for p in platforms],
            F.when(F.col("page") == 0, F.concat("_covered", F.lit(f"/{len(platforms)}"))).otherwise("").alias("coverage"),
            text("canonical_name").alias("sort_name"),
        )
    )


def sort_matrix(matrix: DataFrame) -> DataFrame:
    """Rows by field name, unknown fields first."""
    return matrix.orderBy("sort_name", "canonical_id", "page").drop("sort_name")


def filter_matrix(matrix: DataFrame, platforms: list[Platform], search: str = "", platform: str | None = None) -> DataFrame:
    """All pages of the fields that hold the text in their name or any cell, and have a filled cell of one platform."""
    found = contains_text(search, "canonical_field", *[F.col(f"`{p.name}`") for p in platforms]) if search else F.lit(True)
    filled = F.col(f"`{platform}`") != "" if platform else F.lit(True)
    fields = matrix.groupBy(F.col("canonical_id").alias("_field")).agg(F.max(found).alias("_found"), F.max(filled).alias("_filled"))
    return matrix.join(fields.where("_found and _filled"), F.col("canonical_id").eqNullSafe(F.col("_field")), "left_semi")


def matrix_totals(approved: DataFrame, source: DataFrame, platforms: DataFrame) -> DataFrame:
    """Mapped fields, links, platforms, and the platform covering most fields (the first listed on ties)."""
    linked = matrix_links(approved, source).groupBy("canonical_id", "platform_id").agg(F.count("*").alias("n"))
    # A field counts where its first platform does, so one pass over the pairs gives all figures.
    first = F.row_number().over(W.partitionBy("canonical_id").orderBy("platform_id")) == 1
    per_platform = linked.withColumn("_first", first).groupBy(F.col("platform_id").alias("_linked")).agg(
        F.count("*").alias("_covered"), F.sum("n").alias("_links"), F.count_if("_first").alias("_fields")
    )
    listed = platforms.select("platform_id", "name", "ord", F.lit(True).alias("_listed"))
    both = listed.join(per_platform, F.col("platform_id") == F.col("_linked"), "full")
    covered = F.coalesce("_covered", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    best = F.max_by(F.struct("name", covered.alias("covered")), F.when(F.col("_listed"), F.struct(covered, -F.col("ord"))))
    return both.agg(total("_fields"), total("_links"), F.count("_listed").alias("platforms"), best.alias("_best")).select(
        F.col("_fields").alias("mapped_fields"), F.col("_links").alias("total_links"), "platforms",
        F.col("_best.name").alias("best_platform"), F.col("_best.covered").alias("best_covered"),
    )


def platform_coverage(approved: DataFrame, source: DataFrame, platforms: DataFrame) -> DataFrame:
    """Per platform the fields covered, its columns, approved mappings and their percentage."""
    # One row per platform and field before anything is gathered per platform.
    pairs = (
        links(approved, source, ()).groupBy("platform_id", "canonical_id").agg(F.count("*").alias("n"))
        .groupBy("platform_id")
        .agg(F.count(F.when(text("canonical_id") != "", 1)).alias("covered"), F.sum("n").alias("approved"))
    )
    totals = source.groupBy("platform_id").agg(F.count("*").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        platforms.join(pairs, "platform_id", "left").join(totals, "platform_id", "left")
        .select(
            "platform_id", F.col("name").alias("platform"),
            zero("covered").alias("fields_covered"), zero("total").alias("source_columns"),
            zero("approved").alias("approved_columns"), percent(zero("approved"), zero("total")).alias("column_coverage"),
        )
    )


def registry_kpis(fields: DataFrame, approved: DataFrame, source: DataFrame) -> DataFrame:
    """Fields, mappings, unmapped columns and coverage of the registry."""
    columns = source.groupBy("column_id").agg(F.count("*").alias("columns"))
    mapped = approved.groupBy(F.col("column_id").alias("_mapped")).agg(F.count("*").alias("mappings"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    # One row per column id from either side, so each table is read once.
    counts = columns.join(mapped, F.col("column_id") == F.col("_mapped"), "full").agg(
        total("mappings").alias("mappings"), total("columns").alias("total"),
        total(F.when(F.col("mappings").isNotNull(), F.col("columns"))).alias("mapped"),
    )
    # Both sides are one row.
    return counts.unionByName(_count(fields).withColumnRenamed("n", "fields"), allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("fields", "mappings", "mapped", "total")]
    ).select(
        "fields", "mappings", (F.col("total") - F.col("mapped")).alias("unmapped"),
        percent(F.col("mapped"), F.col("total"), "0.0").alias("coverage"),
    )


def _field_platforms(approved: DataFrame, source: DataFrame) -> DataFrame:
    return links(approved, source, ()).groupBy("canonical_id", "platform_id").agg(F.count("*").alias("n"))


def field_coverage(fields: DataFrame, approved: DataFrame, source: DataFrame, platforms: DataFrame) -> DataFrame:
    """Registry rows with `Platform(n)` coverage in configured order and the mapped header count."""
    labels = platforms.select("platform_id", "ord", "name")
    per_field = (
        _field_platforms(approved, source).join(labels, "platform_id", "left")
        .groupBy("canonical_id")
        .agg(
            F.sum("n").alias("mapped"),
            F.sort_array(
                F.collect_list(F.when(F.col("name").isNotNull(), F.struct("ord", F.concat("name", F.lit("("), "n", F.lit(")")).alias("t"))))
            ).alias("parts"),
        )
        .select("canonical_id", "mapped", F.array_join(F.transform("parts", lambda p: p.t), ", ").alias("text"))
    )
    return fields.join(per_field, "canonical_id", "left").select(
        "canonical_id", text("canonical_name").alias("name"), preview("business_definition").alias("definition"),
        F.coalesce("text", F.lit("--")).alias("platform_coverage"), F.coalesce("mapped", F.lit(0)).alias("mapped_headers"),
        text("domain_category").alias("domain"), text("data_type").alias("type"),
    )


def registry_report(fields: DataFrame, approved: DataFrame, source: DataFrame) -> DataFrame:
    """Per field the platforms covered and total mappings, zeros kept."""
    per_field = _field_platforms(approved, source).groupBy("canonical_id").agg(
        F.count("*").alias("platforms_covered"), F.sum("n").alias("total_mappings")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return fields.join(per_field, "canonical_id", "left").select(
        "canonical_id", text("canonical_name").alias("canonical_name"), text("data_type").alias("data_type"),
        text("domain_category").alias("domain"), text("business_definition").alias("definition"),
        zero("platforms_covered"), zero("total_mappings"),
    )


def filter_registry(fields: DataFrame, search: str = "", domain: str | None = None) -> DataFrame:
    """Fields whose name or definition holds the text, of one domain."""
    if search:
        fields = fields.filter(contains_text(search, "canonical_name", "business_definition"))
    return fields.filter(F.col("domain_category") == domain) if domain else fields


def field_status(
    fields: DataFrame, approved: DataFrame, source: DataFrame, proposals: DataFrame, platforms: DataFrame
) -> DataFrame:
    """Per field its platforms out of all, mappings, and linked and pending counts in words."""
    per_field = _field_platforms(approved, source).groupBy("canonical_id").agg(
        F.count("*").alias("covered"), F.sum("n").alias("total_mappings")
    )
    linked = approved.groupBy("canonical_id").agg(F.count("*").alias("linked"))
    pending = (
        proposals.filter(F.col("status") == "pending_review")
        .groupBy(F.col("suggested_canonical_id").alias("canonical_id"))
        .agg(F.count("*").alias("pending"))
    )
    n_platforms = platforms.count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    words = F.concat_ws(
        ", ",
        F.when(zero("linked") > 0, F.concat("linked", F.lit(" Linked"))),
        F.when(zero("pending") > 0, F.concat("pending", F.lit(" Pending"))),
    )
    return (
        fields.join(per_field, "canonical_id", "left").join(linked, "canonical_id", "left").join(pending, "canonical_id", "left")
        .select(
            "canonical_id", text("canonical_name").alias("canonical_name"),
            F.concat(zero("covered").cast("string"), F.lit(f"/{n_platforms}")).alias("platform_coverage"),
            zero("total_mappings").alias("total_mappings"), zero("linked").alias("linked"), zero("pending").alias("pending"),
            F.when(words == "", "No mappings").otherwise(words).alias("status"),
        )
    )


def field_detail(approved: DataFrame, proposals: DataFrame, source: DataFrame, platforms: DataFrame) -> DataFrame:
    """Per field the linked columns, then the pending ones on platforms that have a link already."""
    linked = links(approved, source, ("mapping_id", "approved_by"))
    pairs = linked.select("canonical_id", "platform_id").distinct()
    pending = (
        proposals.filter(F.col("status") == "pending_review")
        .select(F.col("suggested_canonical_id").alias("canonical_id"), "column_id", "proposal_id", "confidence_level")
        .join(one_per_column(source), "column_id")
        .join(pairs, ["canonical_id", "platform_id"], "left_semi")
    )
    shared = ["canonical_id", "platform_id", text("column_name").alias("column_name"), leaf_name("source_table").alias("source_table")]
    rows = linked.select(
        *shared, F.lit("Linked").alias("kind"), F.col("mapping_id").cast("string").alias("row_id"),
        F.col("approved_by"), F.lit(None).cast("string").alias("match_confidence"),
    ).unionByName(
        pending.select(
            *shared, F.lit("Pending").alias("kind"), F.col("proposal_id").cast("string").alias("row_id"),
            F.lit(None).cast("string").alias("approved_by"), title_words("confidence_level").alias("match_confidence"),
        )
    )
    return with_label(rows, platforms)
