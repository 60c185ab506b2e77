from pyspark.sql import functions as F

from fieldloom.operators import audit, coverage
from fieldloom.operators.conform import conform, conform_all, conform_each, conform_plan, rename_pairs, rename_plan, rename_text

PROPOSALS = "proposal_id string, column_id string, suggested_canonical_id string, confidence_level string, status string"


def proposals(spark):
    return spark.createDataFrame(
        [("p1", "sc_001", "cf_001", "high", "approved"), ("p2", "sc_002", "cf_001", "low", "pending_review"),
         ("p3", "gone", "cf_001", "low", "pending_review")], PROPOSALS)


def test_active_fields(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_active boolean")
    assert sorted(r.id for r in coverage.active_fields(df).collect()) == [1, 3]


def test_matrix(spark, columns, approved, vocabulary, platforms):
    listed, labels = platforms
    extra = spark.createDataFrame([("am_004", "sc_003", "cf_x", "p", "bob", None), ("am_005", "sc_002", "cf_001", "p", "bob", None),
                                   ("am_006", "none", "cf_001", "p", "bob", None)], approved.schema)
    links = approved.union(extra)
    matrix = coverage.coverage_matrix(links, columns, vocabulary, listed)
    rows = {r.canonical_field: r for r in matrix.collect()}
    assert set(rows) == {"fund_identifier", "net_asset_value", "cf_x"}
    # Unknown approval times come last.
    assert rows["fund_identifier"].Ledger == "FND_ID, NAV_AMT"
    one = rows["fund_identifier"]
    assert (sorted(one.Ledger.split(", ")), one.Books, one.Empty, one.coverage) == (["FND_ID", "NAV_AMT"], "fund_id", "", "2/3")
    assert (rows["cf_x"].domain, rows["cf_x"].coverage) == ("", "1/3")
    assert [r.canonical_field for r in coverage.sort_matrix(matrix).collect()] == ["cf_x", "fund_identifier", "net_asset_value"]
    assert {r.canonical_field for r in coverage.filter_matrix(matrix, listed, "nav", "Ledger").collect()} == {"fund_identifier", "net_asset_value"}
    assert coverage.filter_matrix(matrix, listed, platform="Empty").isEmpty()
    small = coverage.coverage_matrix(links, columns, vocabulary, listed, page_size=1).filter("canonical_field = 'fund_identifier'")
    assert sorted((r.page, r.Ledger != "", r.Books) for r in small.collect()) == [(0, True, "fund_id"), (1, True, "")]
    paged = coverage.coverage_matrix(links, columns, vocabulary, listed, page_size=1)
    found = coverage.filter_matrix(paged, listed, "nav", "Books").collect()
    assert sorted((r.canonical_field, r.page) for r in found) == [("fund_identifier", 0), ("fund_identifier", 1)]
    total = coverage.matrix_totals(links, columns, labels).first()
    assert (total.mapped_fields, total.total_links, total.platforms, total.best_platform, total.best_covered) == (3, 5, 3, "Ledger", 2)
    none = coverage.matrix_totals(links.limit(0), columns, labels).first()
    assert (none.mapped_fields, none.total_links, none.best_platform, none.best_covered) == (0, 0, "Ledger", 0)
    summary = {r.platform: (r.fields_covered, r.source_columns, r.approved_columns, r.column_coverage)
               for r in coverage.platform_coverage(links, columns, labels).collect()}
    assert summary == {"Ledger": (2, 2, 3, "150%"), "Books": (2, 1, 2, "200%"), "Empty": (0, 0, 0, "0%")}


def test_run_reports(spark, columns, approved, platforms):
    _, labels = platforms
    kpis = coverage.run_kpis(columns, proposals(spark)).first()
    assert kpis.asDict() == {"source_columns": 3, "unmapped": 1, "pending_review": 2, "approved": 1}
    profile = {r.platform: (r.tables, r.columns, r.proposals, r.approved) for r in
               coverage.platform_profile(labels, columns, proposals(spark), approved).collect()}
    assert profile == {"Ledger": ("positions", 2, 2, 2), "Books": ("investors", 1, 0, 1), "Empty": ("--", 0, 0, 0)}
    summary = {r.platform_id: (r.total_columns, r.mapped_columns, r.pending_proposals) for r in
               coverage.batch_summary(columns.union(columns), approved.union(approved), proposals(spark)).collect()}
    assert summary == {"ledger": (2, 2, 1), "books": (1, 1, 0)}


def test_reports_scan_each_table_once(spark, columns, approved, vocabulary, platforms, tmp_path):
    def written(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    columns, approved, fields = written("columns", columns), written("approved", approved), written("fields", vocabulary)
    asked, labels = written("proposals", proposals(spark)), written("platforms", platforms[1])
    assert scans(coverage.run_kpis(columns, asked)) == 2
    assert scans(coverage.registry_kpis(fields, approved, columns)) == 3
    assert scans(coverage.matrix_totals(approved, columns, labels)) == 3


def test_registry(spark, columns, approved, vocabulary, platforms):
    _, labels = platforms
    kpis = coverage.registry_kpis(vocabulary, approved.filter("column_id != 'sc_003'"), columns).first()
    assert (kpis.fields, kpis.mappings, kpis.unmapped, kpis.coverage) == (5, 2, 1, "66.7%")
    assert coverage.registry_kpis(vocabulary, approved, columns.limit(0)).first().coverage == "0.0%"
    cover = {r.name: (r.platform_coverage, r.mapped_headers) for r in coverage.field_coverage(vocabulary, approved, columns, labels).collect()}
    assert cover["fund_identifier"] == ("Ledger(1), Books(1)", 2) and cover["fund_name"] == ("--", 0)
    report = {r.canonical_name: (r.platforms_covered, r.total_mappings) for r in coverage.registry_report(vocabulary, approved, columns).collect()}
    assert report["fund_identifier"] == (2, 2) and report["fund_name"] == (0, 0)
    assert [r.canonical_name for r in coverage.filter_registry(vocabulary, "LEGAL").collect()] == ["fund_name"]
    assert coverage.filter_registry(vocabulary, "fund", "Fund").count() == 2
    status = {r.canonical_name: (r.platform_coverage, r.linked, r.pending, r.status) for r in
              coverage.field_status(vocabulary, approved, columns, proposals(spark), labels).collect()}
    assert status["fund_identifier"] == ("2/3", 2, 2, "2 Linked, 2 Pending")
    assert status["net_asset_value"][3] == "1 Linked" and status["fund_name"][3] == "No mappings"
    detail = coverage.field_detail(approved, proposals(spark), columns, labels).filter("canonical_id = 'cf_001'").collect()
    assert sorted((r.platform, r.kind, r.column_name, r.approved_by, r.match_confidence) for r in detail) == sorted([
        ("Ledger", "Linked", "FND_ID", "ann", None), ("Books", "Linked", "fund_id", "bob", None), ("Ledger", "Pending", "NAV_AMT", None, "Low")])


def test_conform(spark, columns, approved, vocabulary, platforms):
    _, labels = platforms
    plan = {r.table: (r.platform, r.mapped_columns, r.column_renames) for r in conform_plan(approved, columns, vocabulary.filter("canonical_id != 'cf_005'"), labels).collect()}
    assert plan == {"positions": ("Ledger", 2, "NAV_AMT -> ?, FND_ID -> fund_identifier"), "investors": ("Books", 1, "fund_id -> fund_identifier")}
    shown = conform_plan(approved, columns, vocabulary, labels, shown=1).filter("table = 'positions'").first()
    assert shown.column_renames == "NAV_AMT -> net_asset_value..."
    pairs = rename_pairs(approved, columns, vocabulary)
    positions = spark.createDataFrame([("F1", 1.5, "x")], "FND_ID string, NAV_AMT double, OTHER string")
    done = conform(positions, "main.ledger.positions", pairs)
    assert done.columns == ["fund_identifier", "net_asset_value"] and tuple(done.first()) == ("F1", 1.5)
    assert conform(positions, "main.other.t", pairs) is None
    clash = pairs.union(pairs.filter("column_name = 'FND_ID'").withColumn("column_name", F.lit("OTHER")))
    results = {c.source_table: c for c in conform_all(
        {"main.ledger.positions": positions, "main.books.investors": positions.withColumnRenamed("OTHER", "fund_id"), "none": positions}, clash)}
    assert set(results) == {"main.ledger.positions", "main.books.investors"}
    assert "FND_ID and OTHER both map to fund_identifier" in results["main.ledger.positions"].error
    assert results["main.books.investors"].frame.columns == ["fund_identifier"]
    texts = {r.source_table: r.text for r in rename_text(approved, columns, vocabulary).collect()}
    assert texts["main.books.investors"] == (
        "CREATE OR REPLACE VIEW gold.books__investors AS\nSELECT\n    `fund_id` AS `fund_identifier`\nFROM main.books.investors")
    parts = rename_text(approved, columns, vocabulary, page_size=1).filter("source_table = 'main.ledger.positions'").orderBy("page").collect()
    assert len(parts) == 2 and "".join(p.text for p in parts) == texts["main.ledger.positions"]


def test_audit(spark):
    rows = [(1, "mapping", "approved", "ann", 3), (2, "proposal", "created", "bot", 2), (3, None, "created", "ann", 1), (4, "mapping", "", None, 3)]
    log = spark.createDataFrame(rows, "event_id int, entity_type string, action string, actor string, created_at int")
    assert [r.event_id for r in audit.audit_latest(log, 3).collect()] == [1, 4, 2]
    assert tuple(audit.audit_metrics(log).first()) == (4, 2, 2)
    assert [r.event_id for r in audit.filter_audit(log, action="created", actor="ann").collect()] == [3]
    assert [tuple(r) for r in audit.facets(log, ["action", "actor"]).collect()] == [
        ("action", "approved"), ("action", "created"), ("actor", "ann"), ("actor", "bot")]


def test_repeated_ids_count_once(spark, columns, approved, vocabulary, platforms):
    from fieldloom.operators import coverage, retrieval, worklist

    listed, frame = platforms
    # The later row in the order of platform, table and name stands for the id.
    repeated = columns.unionByName(spark.createDataFrame([("sc_001", "aaa", "OLD", "main.aaa.t")], columns.schema))
    fields = vocabulary.unionByName(spark.createDataFrame([("cf_001", "an_older_name", "STRING", "old", "Fund")], vocabulary.schema))
    docs = retrieval.approved_documents(repeated, approved, fields).collect()
    assert sorted((d.doc_id, d.column_name, d.canonical_name) for d in docs) == [
        ("am_001", "FND_ID", "fund_identifier"), ("am_002", "NAV_AMT", "net_asset_value"), ("am_003", "fund_id", "fund_identifier"),
    ]
    assert retrieval.links(approved, repeated).count() == 3
    matrix = coverage.coverage_matrix(approved, repeated, fields, listed).collect()
    assert sorted((r.canonical_field, r.Ledger, r.Books, r.coverage) for r in matrix) == [
        ("fund_identifier", "FND_ID", "fund_id", "2/3"), ("net_asset_value", "NAV_AMT", "", "1/3"),
    ]
    proposals = spark.createDataFrame([("p1", "sc_001", "cf_001")], "proposal_id string, column_id string, suggested_canonical_id string")
    rows = worklist.joined_proposals(proposals, repeated, fields).collect()
    assert [(r.column_name, r.canonical_name) for r in rows] == [("FND_ID", "fund_identifier")]


def test_run_kpis_with_null_and_repeated_ids(spark):
    from fieldloom.operators import coverage

    source = spark.createDataFrame([(1,), (1,), (2,), (None,)], "column_id int")
    proposals = spark.createDataFrame(
        [(1, "approved"), (1, "pending_review"), (7, "pending_review"), (None, "approved")], "column_id int, status string"
    )
    assert tuple(coverage.run_kpis(source, proposals).first()) == (4, 2, 2, 2)
    assert tuple(coverage.run_kpis(source.limit(0), proposals.limit(0)).first()) == (0, 0, 0, 0)


def test_repeated_field_ids_rename_once(spark, columns, approved, vocabulary):
    fields = vocabulary.select("canonical_id", "canonical_name").union(spark.createDataFrame([("cf_001", "an_older_name"), ("cf_001", "fund_identifier"), ("cf_005", None)], "a string, b string"))
    pairs = rename_pairs(approved, columns, fields)
    assert sorted((r.source_table, r.column_name, r.canonical_name) for r in pairs.collect()) == [
        ("main.books.investors", "fund_id", "fund_identifier"), ("main.ledger.positions", "FND_ID", "fund_identifier"), ("main.ledger.positions", "NAV_AMT", "net_asset_value")]
    positions = spark.createDataFrame([("F1", 1.5, "x")], "FND_ID string, NAV_AMT double, OTHER string")
    assert conform(positions, "main.ledger.positions", pairs).columns == ["fund_identifier", "net_asset_value"]
    text = [r.text for r in rename_text(approved, columns, fields).filter("source_table = 'main.ledger.positions'").collect()]
    assert len(text) == 1 and text[0].count("`FND_ID`") == 1


def test_rename_plan_names_clashes(spark):
    rows = [("t", "a", "x", 1), ("t", "a", "x", 2), ("t", "b", "x", 3), ("t", "c", "y", 4), ("u", "a", "x", 5)]
    plan = rename_plan(spark.createDataFrame(rows, "source_table string, column_name string, canonical_name string, mapping_id int")).collect()
    assert sorted((r.source_table, r.column_name, r.canonical_name, r.mappings, r["columns"], r.first_column) for r in plan) == [
        ("t", "a", "x", 2, 2, "a"), ("t", "b", "x", 1, 2, "a"), ("t", "c", "y", 1, 1, "c"), ("u", "a", "x", 1, 1, "a")]


def test_tables_are_conformed_in_batches_without_a_cap(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(1200)])
    tables = {"wide": wide, **{f"t{i}": spark.range(2).toDF("a") for i in range(5)}, "odd": spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"))}
    rows = [("wide", f"c{i}", f"n{i:04d}") for i in range(1200)] + [(f"t{i}", "a", "id") for i in range(5)] + [("odd", "a", "id"), ("odd", "b", "id"), ("none", "a", "id")]
    pairs = spark.createDataFrame(rows, "source_table string, column_name string, canonical_name string")
    for batch in (1, 3, 50_000):
        done = {c.source_table: c for c in conform_all(tables, pairs, batch)}
        assert set(done) == set(tables) and len(done["wide"].renames) == 1200 and done["wide"].frame.columns[7] == "n0007"
        assert done["odd"].error == "odd: a and b both map to id" and done["t3"].frame.columns == ["id"]
    steps = conform_each(tables, pairs, 3)
    assert next(steps).source_table == "wide"
