"""Long-form reports: one header row per key, entries numbered, sums independent of page sizes."""

from fieldloom.operators import coverage, reports, worklist


def more_links(spark, approved):
    extra = [("am_004", "sc_002", "cf_001", "p", "bob", None), ("am_005", "sc_003", "cf_x", "p", "bob", None), ("am_006", "gone", "cf_001", "p", "bob", None)]
    return approved.union(spark.createDataFrame(extra, approved.schema))


def test_matrix_report(spark, columns, approved, vocabulary, platforms):
    listed, labels = platforms
    links = more_links(spark, approved)
    report = reports.matrix_report(links, columns, vocabulary, labels)
    heads = {r.canonical_field: (r.domain, r.type, r.covered, r.links, r.coverage) for r in report.headers.collect()}
    assert heads == {"fund_identifier": ("Fund", "STRING", 2, 3, "2/3"), "net_asset_value": ("Valuation", "DECIMAL", 1, 1, "1/3"), "cf_x": ("", "", 1, 1, "1/3")}
    entries = sorted((r.canonical_id, r.platform, r.entry, r.column_name) for r in report.entries.collect())
    # Unknown approval times come last.
    assert entries == [("cf_001", "Books", 1, "fund_id"), ("cf_001", "Ledger", 1, "FND_ID"), ("cf_001", "Ledger", 2, "NAV_AMT"),
                       ("cf_005", "Ledger", 1, "NAV_AMT"), ("cf_x", "Books", 1, "fund_id")]
    for size in (1, 1000):
        pages = reports.cell_pages(report.entries, ["canonical_id", "platform_id"], "column_name", size).collect()
        assert sum(p.names for p in pages) == sum(h[3] for h in heads.values()) == 5
        assert max(p.names for p in pages) <= size
    whole = {(p.canonical_id, p.platform_id): p.cell for p in pages}
    matrix = {r.canonical_id: r for r in coverage.coverage_matrix(links, columns, vocabulary, listed).collect()}
    assert all(whole.get((c, p.id), "") == row[p.name] for c, row in matrix.items() for p in listed)
    assert {r.canonical_id for r in reports.filter_matrix_report(report, "nav_a", "ledger").headers.collect()} == {"cf_001", "cf_005"}
    found = reports.filter_matrix_report(report, "FUND_I", "books")
    assert {r.canonical_id for r in found.headers.collect()} == {"cf_001", "cf_x"} and found.entries.count() == 4
    empty = reports.matrix_report(links.limit(0), columns, vocabulary, labels)
    assert empty.headers.isEmpty() and empty.entries.isEmpty()


def test_coverage_stands_once_per_field(spark, columns, approved, vocabulary, platforms):
    paged = coverage.coverage_matrix(more_links(spark, approved), columns, vocabulary, platforms[0], page_size=1).collect()
    assert sorted((r.canonical_field, r.page, r.coverage) for r in paged) == [
        ("cf_x", 0, "1/3"), ("fund_identifier", 0, "2/3"), ("fund_identifier", 1, ""), ("net_asset_value", 0, "1/3")]


def test_worklist_report(spark, columns, approved, vocabulary, platforms):
    rows = [("p1", "sc_001", "cf_001", "given", "high", "approved"), ("p2", "sc_002", "cf_001", "given", "low", "pending_review"), ("p3", "gone", "cf_x", "given", None, "flagged")]
    proposals = spark.createDataFrame(rows, "proposal_id string, column_id string, suggested_canonical_id string, suggested_canonical_name string, confidence_level string, status string")
    joined = worklist.joined_proposals(proposals, columns, vocabulary)
    report = reports.worklist_report(joined, approved, columns, platforms[1])
    got = {r.proposal_id: (r.suggested_match, r.header, r.platform, r.names) for r in report.headers.collect()}
    assert got == {"p1": ("fund_identifier", "FND_ID", "Ledger", 2), "p2": ("fund_identifier", "NAV_AMT", "Ledger", 2), "p3": ("given", "", "", 0)}
    assert sorted((r.canonical_id, r.platform, r.entry, r.column_name) for r in report.entries.collect()) == [("cf_001", "Books", 1, "fund_id"), ("cf_001", "Ledger", 1, "FND_ID")]


def test_profile_report_and_pages_agree(spark, columns, approved, platforms):
    more = spark.createDataFrame([("sc_009", "ledger", "X", "main.ledger.trades"), ("sc_010", "ledger", "Y", "main.ledger.cash")], columns.schema)
    proposals = spark.createDataFrame([("p1", "sc_001"), ("p2", "sc_010")], "proposal_id string, column_id string")
    report = reports.profile_report(platforms[1], columns.union(more), proposals, approved)
    got = {r.platform: (r.tables, r.columns, r.proposals, r.approved) for r in report.headers.collect()}
    assert got == {"Ledger": (3, 4, 2, 2), "Books": (1, 1, 0, 1), "Empty": (0, 0, 0, 0)}
    assert sorted((r.platform_id, r.entry, r.table, r.columns) for r in report.entries.collect()) == [
        ("books", 1, "investors", 1), ("ledger", 1, "cash", 1), ("ledger", 2, "positions", 2), ("ledger", 3, "trades", 1)]
    for size in (1, 1000):
        pages = coverage.platform_profile(platforms[1], columns.union(more), proposals, approved, size).collect()
        assert [sum(p[c] for p in pages) for c in ("columns", "proposals", "approved")] == [5, 2, 3]
        assert ", ".join(p.tables for p in sorted(pages, key=lambda p: p.page) if p.platform == "Ledger") == "cash, positions, trades"
