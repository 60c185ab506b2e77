from fieldloom.operators.review import register_rules
import datetime as dt

import pytest

from fieldloom.operators.review import apply_decisions
from fieldloom.operators.worklist import filter_worklist, joined_proposals, platform_cells, worklist

DAY = [dt.datetime(2025, 3, d) for d in range(1, 29)]


@pytest.fixture(scope="module")
def proposals(spark):
    rows = [
        ("p1", "sc_001", "cf_001", "fund_identifier", 95.0, "high", "Exact Match", "pending_review", None, None),
        ("p2", "sc_002", None, "something", 40.0, "low", "weak", "pending_review", None, None),
        ("p3", "sc_003", "cf_002", "fund_name", 70.0, "medium", None, "flagged", DAY[0], "old"),
        ("p4", "gone", "cf_404", "left", 70.0, "medium", "r", "approved", None, None),
    ]
    return spark.createDataFrame(
        rows, "proposal_id string, column_id string, suggested_canonical_id string, suggested_canonical_name string, confidence double, "
        "confidence_level string, reasoning string, status string, reviewed_at timestamp, reviewed_by string")


def decide(spark, rows):
    return spark.createDataFrame(
        rows, "decision_id string, proposal_id string, action string, canonical_id string, actor string, decided_at timestamp")


def states(df):
    return {r.proposal_id: (r.status, r.reviewed_at, r.reviewed_by) for r in df.collect()}


def test_each_decision(spark, proposals):
    made = decide(spark, [
        ("d1", "p1", "approve", None, "ann", DAY[1]), ("d2", "p2", "approve", None, "ann", DAY[1]),
        ("d3", "p3", "flag", None, "ann", DAY[1]), ("d4", "p4", "reassign", "cf_001", "bob", DAY[2]), ("d5", "none", "reject", None, "x", DAY[2]),
    ])
    after, approved, audit = apply_decisions(proposals, made)
    assert states(after) == {
        "p1": ("approved", DAY[1], "ann"), "p2": ("pending_review", None, None), "p3": ("flagged", DAY[0], "old"), "p4": ("approved", DAY[2], "bob")}
    assert {(r.column_id, r.canonical_id, r.proposal_id, r.approved_by) for r in approved.collect()} == {
        ("sc_001", "cf_001", "p1", "ann"), ("gone", "cf_001", "p4", "bob")}
    assert {(r.entity_type, r.action, r.details) for r in audit.collect()} == {
        ("mapping", "approved", '{"canonical_id":"cf_001","column_id":"sc_001"}'),
        ("mapping", "approved", '{"canonical_id":"cf_001","reassigned":true}'), ("proposal", "flagged", None)}
    ids = {r.mapping_id for r in approved.collect()}
    assert ids == {r.entity_id for r in audit.filter("entity_type = 'mapping'").collect()}
    # Applied again: the same states, mappings and events.
    again, approved_again, audit_again = apply_decisions(after, made)
    assert states(again) == states(after) and {r.mapping_id for r in approved_again.collect()} == ids
    assert {r.event_id for r in audit_again.collect()} == {r.event_id for r in audit.collect()}


def test_latest_decision_wins(spark, proposals):
    made = decide(spark, [
        ("d1", "p1", "approve", None, "ann", DAY[1]), ("d2", "p1", "reject", None, "bob", DAY[2]),
        ("d3", "p2", "reject", None, "ann", DAY[1]), ("d4", "p2", "approve", None, "bob", DAY[5]),  # no suggestion: does not count
        ("d5", "p3", "reject", None, "ann", DAY[3]), ("d6", "p3", "approve", None, "bob", DAY[3]),  # tie: the higher id
    ])
    after, approved, _ = apply_decisions(proposals, made)
    got = states(after)
    assert got["p1"] == ("rejected", DAY[2], "bob") and got["p2"] == ("rejected", DAY[1], "ann") and got["p3"] == ("approved", DAY[3], "bob")
    assert [r.proposal_id for r in approved.collect()] == ["p3"]


def test_worklist(spark, proposals, columns, approved, vocabulary, platforms):
    listed, labels = platforms
    joined = joined_proposals(proposals, columns, vocabulary)
    cells = platform_cells(approved, columns, listed)
    rows = {r.proposal_id: r for r in worklist(joined, cells, labels, listed).collect()}
    assert (rows["p1"].suggested_match, rows["p1"].header, rows["p1"].platform, rows["p1"].source_table) == ("fund_identifier", "FND_ID", "Ledger", "positions")
    assert (rows["p1"].Ledger, rows["p1"].Books, rows["p1"].Empty, rows["p1"].page) == ("FND_ID", "fund_id", "", 0)
    assert (rows["p2"].suggested_match, rows["p2"].Ledger, rows["p2"].page) == ("something", "", 0)
    assert (rows["p4"].suggested_match, rows["p4"].header, rows["p4"].platform, rows["p1"].status) == ("left", "", "", "Pending Review")
    found = lambda **k: sorted(r.proposal_id for r in filter_worklist(joined, **k).collect())
    assert found() == ["p1", "p2", "p3", "p4"]
    assert found(status="pending_review") == ["p1", "p2"] and found(platform="books") == ["p3"]
    assert found(search="EXACT") == ["p1"] and found(search="positions") == ["p1", "p2"] and found(search="fund_name") == ["p3"]
    assert found(status="pending_review", search="nav_") == ["p2"]


def test_equal_new_rows_get_ids_of_their_own(spark):
    rules = spark.createDataFrame([("fnd", "fund", "d")] * 3 + [("acct", "account", None)], "pattern string, replacement string, description string")
    created, audit = register_rules(rules, "ann")
    assert created.count() == 4 and created.select("rule_id").distinct().count() == 4 and audit.select("event_id").distinct().count() == 4
