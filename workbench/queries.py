"""The registered queries: every operator over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.functions.answers import parse_answers as read_answers
from fieldloom.functions.display import confidence_band
from fieldloom.functions.text import query_text, tokenize
from fieldloom.operators import audit, bm25, conform, coverage, intake, key_filter, match, reports, retrieval, review, rules, segments, similar, worklist
from fieldloom.plans import mapping_run, prompts
from fieldloom.session import shared_folder
from fieldloom.settings import Platform
from fieldloom.sources import discovery, ordered, seed, tables
from workbench.roles import TABLES, platform_list, role, table

QUERIES = {}


def query(fn):
    """Register under the function's name; integers widen so that both engines give one type."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = fn(spark, folder)
        return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f"`{f.name}`") for f in df.schema])

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def _roles(spark, folder, *names):
    return [role(spark, folder, n) for n in names]


def _abbreviations(spark, folder):
    return rules.active_abbreviations(role(spark, folder, "rules"))


# ---- text ----


@query
def standardize_headers(spark, folder):
    """Standardised names of whole texts, addresses and names."""
    named = rules.standardize_headers(role(spark, folder, "headers"), "header", _abbreviations(spark, folder))
    return named.select("header_id", "standardized")


@query
def active_abbreviations(spark, folder):
    """P2, W3."""
    return _abbreviations(spark, folder)


@query
def tokenize_terms(spark, folder):
    """How often each token occurs, and in how many documents."""
    tokens = table(spark, folder, "documents").select("doc_id", F.explode(tokenize("text")).alias("term"))
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


# ---- intake and name match ----


@query
def fast_match(spark, folder):
    """F2, F3, F12, J4, J5, W2, W3, P3."""
    columns, fields = _roles(spark, folder, "intake_columns", "canonical_fields")
    named = rules.standardize_headers(columns, "column_name", _abbreviations(spark, folder))
    return match.fast_match(named, fields).select(
        "column_id", "column_name", "standardized", "match_kind", "canonical_id", "canonical_name", "confidence", "rationale",
        F.when(F.col("confidence").isNotNull(), confidence_band("confidence")).alias("band"),
    )


@query
def exact_matches(spark, folder):
    """J4."""
    columns, fields = _roles(spark, folder, "intake_columns", "canonical_fields")
    return match.exact_match(rules.standardize_headers(columns, "column_name"), fields).select("column_id", "canonical_id", "canonical_name")


@query
def near_matches(spark, folder):
    """J5, W2."""
    columns, fields = _roles(spark, folder, "intake_columns", "canonical_fields")
    return match.near_match(rules.standardize_headers(columns, "column_name"), fields).select("column_id", "canonical_id", "canonical_name")


@query
def discover_columns(spark, folder):
    """S3: the columns of all test tables as rows, with figures from their data."""
    given = Platform("given", "Given tables")
    return discovery.profile_columns(spark, {(given, t): spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES})


@query
def discover_new_columns(spark, folder):
    """All columns of two systems against those registered so far."""
    columns, source, approved = _roles(spark, folder, "intake_columns", "source_columns", "intake_approved")
    found = columns.unionByName(source).drop("column_id")
    return intake.new_columns(found, columns.join(approved.select("column_id"), "column_id", "left_semi"))


@query
def new_columns_filtered(spark, folder):
    """J2 with filters of the keys on both sides: columns of three systems against the columns of two."""
    columns, source, repeated = _roles(spark, folder, "intake_columns", "source_columns", "repeated_columns")
    found = columns.unionByName(repeated).drop("column_id")
    return key_filter.new_columns_filtered(found, source.unionByName(columns.filter("data_type = 'STRING' and source_table like '%SMALL'")))


@query
def unmapped_columns(spark, folder):
    """J3."""
    frames = _roles(spark, folder, "intake_columns", "intake_approved", "intake_proposals")
    return intake.unmapped(*frames).select("column_id", "platform_id", "column_name")


@query
def mapped_columns(spark, folder):
    """J13."""
    return intake.mapped_columns(*_roles(spark, folder, "intake_columns", "intake_approved")).select("column_id", "column_name")


# ---- retrieval ----


@query
def bm25_documents(spark, folder):
    """Whole documents searched for whole passages."""
    index = bm25.build_index(table(spark, folder, "documents"), "doc_id", "text")
    return bm25.bm25_search(table(spark, folder, "benchmark"), "item_id", "text", index)


@query
def bm25_segments(spark, folder):
    """The same documents, indexed in two goes."""
    docs = table(spark, folder, "documents")
    growing = segments.GrowingIndex(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for some in (docs.where(english), docs.where(~english)):
        growing.add(some, "doc_id", "text")
    return bm25.bm25_search(table(spark, folder, "benchmark"), "item_id", "text", growing.index())


def _asked(spark, folder, name):
    named = rules.standardize_headers(role(spark, folder, name), "column_name", _abbreviations(spark, folder))
    return named.select("column_id", query_text("column_name", "standardized").alias("query_text"))


@query
def bm25_fields(spark, folder):
    """Vocabulary searched for every intake header."""
    hits = retrieval.search_fields(_asked(spark, folder, "intake_columns"), "column_id", "query_text", role(spark, folder, "canonical_fields"))
    return hits.select("column_id", "canonical_id", "canonical_name", "score", "rank")


@query
def bm25_approved(spark, folder):
    """Approved mappings searched for every customer header."""
    source, approved, fields = _roles(spark, folder, "source_columns", "approved_mappings", "canonical_fields")
    asked = _asked(spark, folder, "source_columns").withColumnRenamed("column_id", "asked_id")
    hits = retrieval.search_approved(asked, "asked_id", "query_text", source, approved, fields)
    return hits.select("asked_id", "mapping_id", "column_name", "platform_id", "canonical_name", "score", "rank")


@query
def cross_platform_context(spark, folder):
    """Columns approved for every suggested field, in pages."""
    source, approved, proposals = _roles(spark, folder, "source_columns", "approved_mappings", "mapping_proposals")
    ids = proposals.select(F.col("suggested_canonical_id").alias("canonical_id"))
    line = F.transform("context", lambda c: F.concat_ws("|", c.platform_id, c.column_name, c.source_table))
    return retrieval.cross_platform(ids, approved, source).select("canonical_id", "page", F.array_join(line, "; ").alias("context"))


@query
def cross_platform_names(spark, folder):
    """Column names by platform of every field."""
    source, approved = _roles(spark, folder, "source_columns", "approved_mappings")
    named = retrieval.cross_platform_map(approved, source)
    return named.select("canonical_id", "page", F.explode("names").alias("platform", "n")).select(
        "canonical_id", "page", "platform", F.array_join("n", ", ").alias("names")
    )


@query
def repeated_documents(spark, folder):
    """The documents of approved mappings whose column ids repeat."""
    source, approved, fields = _roles(spark, folder, "repeated_columns", "approved_mappings", "canonical_fields")
    docs = retrieval.approved_documents(source, approved, fields)
    return docs.select("doc_id", "column_id", "platform_id", "column_name", "source_table", "canonical_id", "canonical_name")


@query
def busy_context(spark, folder):
    """Fields of very many mappings, over columns whose ids repeat."""
    source, approved, fields = _roles(spark, folder, "repeated_columns", "busy_mappings", "canonical_fields")
    line = F.transform("context", lambda c: F.concat_ws("|", c.platform_id, c.column_name, c.source_table))
    return retrieval.cross_platform(fields, approved, source).select("canonical_id", "page", F.array_join(line, "; ").alias("context"))


def _retrieved(spark, folder):
    source, approved, fields = _roles(spark, folder, "intake_columns", "intake_approved", "canonical_fields")
    return prompts.retrieve(source, source, approved, fields, _abbreviations(spark, folder))


@query
def retrieval_context(spark, folder):
    """Merged top fields of both searches that have context, per distinct header."""
    found = _retrieved(spark, folder)
    shown = retrieval.retrieval_context(found.merged, found.sizes, "header")
    return shown.select("header", "canonical_id", "canonical_name", "place", "columns", "chars")


@query
def build_prompts(spark, folder):
    """The prompt of every unmapped intake column."""
    source, approved, proposals, fields, platforms = _roles(
        spark, folder, "intake_columns", "intake_approved", "intake_proposals", "canonical_fields", "platforms"
    )
    pending = intake.unmapped(source, approved, proposals)
    built = prompts.build_prompts(pending, source, approved, fields, _abbreviations(spark, folder), platforms)
    return built.select("column_id", "platform_name", "standardized", "part", "prompt")


@query
def busy_prompts(spark, folder):
    """Prompts of fields with very many mappings, in parts of 4,096 characters and a little more."""
    columns, source, approved, fields, platforms = _roles(spark, folder, "class_columns", "repeated_columns", "busy_mappings", "canonical_fields", "platforms")
    built = prompts.build_prompts(columns, source, approved, fields, None, platforms, part_chars=4096)
    return built.select("column_id", "platform_name", "standardized", "context_pages", "part", "prompt")


@query
def parse_answers(spark, folder):
    """F8, F9."""
    parsed = read_answers(role(spark, folder, "responses"))
    return parsed.select(
        "column_id", "recommended_canonical_id", "recommended_canonical_name", "confidence", "rationale", "data_type",
        F.size("alternatives").alias("alternatives"), F.get("alternatives", F.lit(0)).reason.alias("first_reason"),
        F.col("error").isNotNull().alias("failed"),
    )


def _batch(spark, folder, **options):
    source, approved, fields, rule_rows, proposals, platforms, responses = _roles(
        spark, folder, "intake_columns", "intake_approved", "canonical_fields", "rules", "intake_proposals", "platforms", "responses"
    )
    run = mapping_run.run_mapping(
        source, approved, fields, rule_rows, proposals, platforms, "b1", responses=responses, **options
    )
    return run


PROPOSAL = ["proposal_id", "column_id", "suggested_canonical_id", "suggested_canonical_name", "confidence", "confidence_level", "reasoning",
            "agent_model", "batch_id", "status"]


@query
def batch_proposals(spark, folder):
    """Name matches and parsed answers as proposals."""
    return _batch(spark, folder).proposals.select(*PROPOSAL)


@query
def batch_proposals_with_errors(spark, folder):
    """No name match, failed answers kept."""
    return _batch(spark, folder, use_fast_path=False, keep_errors=True).proposals.select(*PROPOSAL)


def counting_model(asked):
    """A stand-in for a model: its confidence is the length of the prompt, its rationale the name of the column."""
    named = asked.str.extract(r'SOURCE COLUMN: "(.*)"', expand=False).str.replace('"', "'")
    return '{"confidence": ' + (asked.str.len() % 101).astype(str) + ', "rationale": "' + named + '"}'


@query
def model_proposals(spark, folder):
    """Prompts of all unmapped columns answered by a caller's function, as proposals."""
    source, approved, fields, rule_rows, proposals, platforms = _roles(
        spark, folder, "intake_columns", "intake_approved", "canonical_fields", "rules", "intake_proposals", "platforms"
    )
    run = mapping_run.run_mapping(source, approved, fields, rule_rows, proposals, platforms, "b1", complete=counting_model, use_fast_path=False)
    return run.proposals.select("column_id", "confidence", "confidence_level", "reasoning", "agent_model", "status")


@query
def batch_audit(spark, folder):
    """The audit rows of a run."""
    rows = _batch(spark, folder).audit
    return rows.select("entity_type", "action", "actor", "details")


# ---- similar names ----


def _new_fields(spark, folder):
    return role(spark, folder, "canonical_fields").select(
        F.concat("canonical_name", F.lit("_"), F.lower("domain_category")).alias("canonical_name"), "data_type",
        "business_definition", "domain_category",
    )


@query
def similar_names(spark, folder):
    """Vocabulary names similar to the new names."""
    names = _new_fields(spark, folder).select(F.col("canonical_name").alias("name"))
    return similar.similar_fields(names, role(spark, folder, "canonical_fields"), 0.6)


@query
def name_overlap(spark, folder):
    """Token overlap of the pairs that come in question."""
    names = _new_fields(spark, folder).select(F.col("canonical_name").alias("name"))
    pairs = similar.candidate_pairs(names, role(spark, folder, "canonical_fields"), 0.6)
    return pairs.select(F.col("a").alias("name"), F.col("b").alias("canonical_name"), F.round("overlap", 6).alias("overlap"))


@query
def register_fields(spark, folder):
    """New vocabulary rows."""
    created, _, _ = review.register_fields(_new_fields(spark, folder), role(spark, folder, "canonical_fields"), "steward")
    return created.select("canonical_id", "canonical_name", "data_type", "business_definition", "domain_category", "is_active", "created_by")


@query
def register_fields_warnings(spark, folder):
    """Similar names already there."""
    return review.register_fields(_new_fields(spark, folder), role(spark, folder, "canonical_fields"), "steward")[1]


@query
def register_rules(spark, folder):
    """One rule per part, its brand standing for its type."""
    new = table(spark, folder, "part").select(
        F.lower("p_brand").alias("pattern"), F.lower("p_type").alias("replacement"), F.col("p_name").alias("description")
    )
    created, log = review.register_rules(new, "steward")
    return created.join(
        log.groupBy("details").agg(F.count("*").alias("audit_rows")),
        F.to_json(F.struct("pattern", "replacement")) == F.col("details"),
    )


# ---- review ----


def _worklist_rows(spark, folder):
    proposals, source, fields = _roles(spark, folder, "mapping_proposals", "source_columns", "canonical_fields")
    return worklist.joined_proposals(proposals, source, coverage.active_fields(fields))


def _shown(spark, folder, rows):
    approved, source, labels = _roles(spark, folder, "approved_mappings", "source_columns", "platforms")
    platforms = platform_list(spark, folder)
    return worklist.worklist(rows, worklist.platform_cells(approved, source, platforms), labels, platforms)


@query
def worklist_all(spark, folder):
    """J8, J12, P9."""
    return _shown(spark, folder, _worklist_rows(spark, folder))


@query
def worklist_filtered(spark, folder):
    """P5 on J8."""
    return _shown(spark, folder, worklist.filter_worklist(_worklist_rows(spark, folder), "pending_review", 3, "Ring"))


def _decided(spark, folder):
    return review.apply_decisions(*_roles(spark, folder, "mapping_proposals", "decisions"))


@query
def apply_decisions(spark, folder):
    """Proposals after the decisions."""
    return _decided(spark, folder)[0].select("proposal_id", "status", "reviewed_at", "reviewed_by")


@query
def decided_mappings(spark, folder):
    """Mappings the decisions approve."""
    return _decided(spark, folder)[1]


@query
def decision_audit(spark, folder):
    """Audit rows of the decisions."""
    return _decided(spark, folder)[2].select("entity_type", "entity_id", "action", "actor", "details", "created_at")


# ---- coverage ----


@query
def run_kpis(spark, folder):
    """A1."""
    return coverage.run_kpis(*_roles(spark, folder, "source_columns", "mapping_proposals"))


@query
def platform_profile(spark, folder):
    """A2."""
    return coverage.platform_profile(*_roles(spark, folder, "platforms", "source_columns", "mapping_proposals", "approved_mappings"))


@query
def batch_summary(spark, folder):
    """A3, J11."""
    return coverage.batch_summary(*_roles(spark, folder, "source_columns", "approved_mappings", "mapping_proposals"))


def _matrix(spark, folder):
    approved, source, fields = _roles(spark, folder, "approved_mappings", "source_columns", "canonical_fields")
    platforms = platform_list(spark, folder)
    return coverage.coverage_matrix(approved, source, coverage.active_fields(fields), platforms), platforms


@query
def coverage_matrix(spark, folder):
    """A4, L4, W5."""
    return coverage.sort_matrix(_matrix(spark, folder)[0])


@query
def busy_matrix(spark, folder):
    """Fields of very many mappings, over columns whose ids repeat."""
    approved, source, fields = _roles(spark, folder, "busy_mappings", "repeated_columns", "canonical_fields")
    matrix = coverage.coverage_matrix(approved, source, coverage.active_fields(fields), platform_list(spark, folder))
    return coverage.sort_matrix(matrix)


@query
def matrix_filtered(spark, folder):
    """P6."""
    matrix, platforms = _matrix(spark, folder)
    return coverage.filter_matrix(matrix, platforms, "Bolt", platforms[3].name).drop("sort_name")


def _matrix_report(spark, folder, mappings="busy_mappings", columns="repeated_columns"):
    approved, source, fields, platforms = _roles(spark, folder, mappings, columns, "canonical_fields", "platforms")
    return reports.matrix_report(approved, source, coverage.active_fields(fields), platforms)


@query
def matrix_headers(spark, folder):
    """A4: one row per field, though each has very many mappings."""
    return _matrix_report(spark, folder).headers.drop("sort_name")


@query
def matrix_entries(spark, folder):
    """The cells of the same fields, one numbered row per name."""
    return _matrix_report(spark, folder).entries


@query
def matrix_cells(spark, folder):
    """The same cells as texts of 100 names."""
    return reports.cell_pages(_matrix_report(spark, folder).entries, ["canonical_id", "platform_id"], "column_name", 100)


@query
def matrix_report_filtered(spark, folder):
    """P6 on the long form."""
    found = reports.filter_matrix_report(_matrix_report(spark, folder, "approved_mappings", "source_columns"), "bolt", 3)
    more = reports.filter_matrix_report(_matrix_report(spark, folder, "approved_mappings", "source_columns"), "#000000012", 3)
    return found.headers.unionByName(more.headers).distinct().drop("sort_name")


def _worklist_report(spark, folder):
    approved, source, labels = _roles(spark, folder, "approved_mappings", "source_columns", "platforms")
    return reports.worklist_report(worklist.filter_worklist(_worklist_rows(spark, folder), "pending_review"), approved, source, labels)


@query
def worklist_headers(spark, folder):
    """One row per open proposal."""
    return _worklist_report(spark, folder).headers


@query
def worklist_entries(spark, folder):
    """What the platforms call the fields that open proposals suggest."""
    return _worklist_report(spark, folder).entries


def _profile_report(spark, folder):
    return reports.profile_report(*_roles(spark, folder, "platforms", "source_columns", "mapping_proposals", "approved_mappings"))


@query
def profile_headers(spark, folder):
    """A2: one row per platform."""
    return _profile_report(spark, folder).headers


@query
def profile_entries(spark, folder):
    """A2: the tables of every platform by name."""
    return _profile_report(spark, folder).entries


@query
def matrix_totals(spark, folder):
    """A5."""
    return coverage.matrix_totals(*_roles(spark, folder, "approved_mappings", "source_columns", "platforms"))


@query
def platform_coverage(spark, folder):
    """A6."""
    return coverage.platform_coverage(*_roles(spark, folder, "approved_mappings", "source_columns", "platforms"))


@query
def registry_kpis(spark, folder):
    """A7."""
    fields, approved, source = _roles(spark, folder, "canonical_fields", "intake_approved", "intake_columns")
    return coverage.registry_kpis(coverage.active_fields(fields), approved, source)


@query
def field_coverage(spark, folder):
    """A8."""
    fields, approved, source, platforms = _roles(spark, folder, "canonical_fields", "approved_mappings", "source_columns", "platforms")
    return coverage.field_coverage(coverage.active_fields(fields), approved, source, platforms)


@query
def registry_report(spark, folder):
    """A9."""
    fields, approved, source = _roles(spark, folder, "canonical_fields", "intake_approved", "intake_columns")
    return coverage.registry_report(coverage.active_fields(fields), approved, source)


@query
def registry_filtered(spark, folder):
    """P1, P7."""
    fields = coverage.active_fields(role(spark, folder, "canonical_fields"))
    return coverage.filter_registry(fields, "Gear", "ECONOMY")


@query
def field_detail(spark, folder):
    """J14."""
    return coverage.field_detail(*_roles(spark, folder, "approved_mappings", "mapping_proposals", "source_columns", "platforms"))


@query
def field_status(spark, folder):
    """A10."""
    return coverage.field_status(
        *_roles(spark, folder, "canonical_fields", "approved_mappings", "source_columns", "mapping_proposals", "platforms")
    )


# ---- conform ----


@query
def conform_plan(spark, folder):
    """A11."""
    approved, source, fields, platforms = _roles(spark, folder, "approved_mappings", "source_columns", "canonical_fields", "platforms")
    return conform.conform_plan(approved, source, coverage.active_fields(fields), platforms)


@query
def rename_text(spark, folder):
    """the text of every table's view, in parts."""
    approved, source, fields = _roles(spark, folder, "approved_mappings", "source_columns", "canonical_fields")
    return conform.rename_text(approved, source, fields)


def _repeated_pairs(spark, folder):
    approved, source, fields = _roles(spark, folder, "approved_mappings", "source_columns", "repeated_fields")
    return conform.rename_pairs(approved, source, fields)


@query
def rename_plan(spark, folder):
    """Every rename once, with the columns that clash; field ids repeat."""
    return conform.rename_plan(_repeated_pairs(spark, folder))


@query
def repeated_conform_plan(spark, folder):
    """A11 over field ids that repeat."""
    approved, source, fields, platforms = _roles(spark, folder, "approved_mappings", "source_columns", "repeated_fields", "platforms")
    return conform.conform_plan(approved, source, fields, platforms)


@query
def repeated_rename_text(spark, folder):
    """F11 over field ids that repeat."""
    approved, source, fields = _roles(spark, folder, "approved_mappings", "source_columns", "repeated_fields")
    return conform.rename_text(approved, source, fields)


@query
def conform_table(spark, folder):
    """Two tables conformed by one mapping table."""
    renames = [
        ("cat.crm.customer", "c_custkey", "party_id"), ("cat.crm.customer", "c_name", "party_name"),
        ("cat.crm.customer", "c_acctbal", "balance"), ("cat.buy.supplier", "s_suppkey", "party_id"),
        ("cat.buy.supplier", "s_name", "party_name"), ("cat.buy.supplier", "s_acctbal", "balance"),
    ]
    pairs = spark.createDataFrame(renames, "source_table string, column_name string, canonical_name string")
    done = conform.conform_all(
        {"cat.crm.customer": table(spark, folder, "customer"), "cat.buy.supplier": table(spark, folder, "supplier")}, pairs
    )
    first, second = sorted(((c.source_table, c.frame) for c in done), key=lambda c: c[0])
    return first[1].withColumn("source_table", F.lit(first[0])).unionByName(second[1].withColumn("source_table", F.lit(second[0])))


# ---- audit ----


@query
def audit_latest(spark, folder):
    """L2: the 500 latest events, as the report shows them."""
    return audit.audit_latest(role(spark, folder, "audit_log")).select("event_id", "action", "actor", "created_at")


@query
def audit_metrics(spark, folder):
    """A12."""
    return audit.audit_metrics(role(spark, folder, "audit_log"))


@query
def audit_filtered(spark, folder):
    """P8, A12."""
    return audit.filter_audit(role(spark, folder, "audit_log"), "mapping", "click", "user 7").select("event_id", "details", "created_at")


@query
def audit_facets(spark, folder):
    """A13."""
    return audit.facets(role(spark, folder, "audit_log"), ["entity_type", "action", "actor"])


# ---- stored tables ----


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def ordered_registry(spark, folder):
    """The registry report written in order and read again, with each row's ordinal."""
    fields, approved, source = _roles(spark, folder, "canonical_fields", "approved_mappings", "source_columns")
    place = _place(spark, "registry")
    ordered.write_ordered(coverage.registry_report(fields, approved, source), place, ["canonical_name", "canonical_id"])
    return ordered.read_ordered(spark, place).select("canonical_id", "canonical_name", "total_mappings", "ordinal")


@query
def ordered_audit_page(spark, folder):
    """The third hundred of the audit log, newest first, out of the whole log as written."""
    place = _place(spark, "audit")
    ordered.write_ordered(role(spark, folder, "audit_log"), place, [F.desc("created_at"), F.asc("event_id")])
    return ordered.read_ordered(spark, place, 200, 300).select("event_id", "action", "actor", "created_at", "ordinal")


@query
def exported_registry(spark, folder):
    """The registry report as CSV files in order, read back."""
    fields, approved, source = _roles(spark, folder, "canonical_fields", "approved_mappings", "source_columns")
    place = _place(spark, "export")
    ordered.write_ordered_report(coverage.registry_report(fields, approved, source), place, ["canonical_name", "canonical_id"])
    kinds = "canonical_id long, canonical_name string, data_type string, domain string, definition string, platforms_covered long, total_mappings long"
    return seed.read_seed(spark, place, kinds)


@query
def seeded_fields(spark, folder):
    """The vocabulary as a seed file, loaded: its lock flag is the active flag."""
    place = _place(spark, "seed")
    rows = role(spark, folder, "canonical_fields").select("canonical_id", "canonical_name", "data_type", "business_definition", "domain_category", F.col("is_active").alias("is_locked"), F.lit("seed").alias("created_by"))
    tables.write_report(rows, place)
    return coverage.active_fields(seed.read_fields(spark, place)).drop("created_at", "updated_at")


@query
def seeded_platforms(spark, folder):
    """Two platforms' tables as seed files, their columns counted; a platform without file is skipped."""
    place = _place(spark, "platforms")
    tables.write_report(table(spark, folder, "customer"), f"{place}/crm.csv")
    table(spark, folder, "supplier").write.parquet(f"{place}/buy.parquet")
    listed = [Platform("crm", "CRM", seed_file="crm.csv", seed_table="customer"), Platform("buy", "Buying", seed_file="buy.parquet", seed_table="supplier"),
              Platform("none", "None", seed_file="none.csv", seed_table="x")]
    kinds = {"crm": table(spark, folder, "customer").schema}
    return discovery.profile_columns(spark, seed.read_platforms(spark, listed, place, kinds))


@query
def stored_proposals(spark, folder):
    """Proposals appended to a table in two goes, the table read back; a table that is reset holds what came after."""
    schema = f"stored_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{_place(spark, 'stored')}'")
    tables.create_tables(spark, schema)
    kinds = {f.name: f.dataType for f in schemas.MAPPING_PROPOSALS.fields}
    rows = role(spark, folder, "mapping_proposals")
    rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in rows.columns if c in kinds])
    tables.append(rows.limit(10), f"{schema}.mapping_proposals")
    tables.reset(spark, schema)
    for some in (rows.where("status = 'approved'"), rows.where("status <> 'approved'")):
        tables.append(some, f"{schema}.mapping_proposals")
    stored = tables.load_metadata(spark, schema, "mapping_proposals")
    return stored.select("proposal_id", "column_id", "suggested_canonical_id", F.round("confidence", 6).alias("confidence"), "confidence_level", "status", "assigned_to")


@query
def published_views(spark, folder):
    """Two tables published as views under one vocabulary, read back, with the number of views published."""
    pairs = spark.createDataFrame(
        [("cat.crm.customer", "c_custkey", "party_id"), ("cat.crm.customer", "c_name", "party_name"), ("cat.buy.supplier", "s_suppkey", "party_id"), ("cat.buy.supplier", "s_name", "party_name"),
         ("cat.ops.nation", "n_name", "name"), ("cat.ops.nation", "n_nationkey", "name")], "source_table string, column_name string, canonical_name string")
    given = {"cat.crm.customer": table(spark, folder, "customer"), "cat.buy.supplier": table(spark, folder, "supplier"), "cat.ops.nation": table(spark, folder, "nation")}
    run = uuid.uuid4().hex
    done, errors = tables.publish(spark, conform.conform_each(given, pairs), {"cat.crm.customer": f"crm_{run}", "cat.buy.supplier": f"buy_{run}", "cat.ops.nation": run})
    event = tables.publication_event(spark, done, "ann").select(F.col("details").alias("party_name"), F.lit(len(errors)).cast("bigint").alias("party_id"), F.lit("event").alias("view"))
    views = [spark.table(f"{name}_{run}__{leaf}").withColumn("view", F.lit(name)) for name, leaf in (("crm", "customer"), ("buy", "supplier"))]
    return views[0].unionByName(views[1]).unionByName(event)
