import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vocabulary(spark):
    rows = [
        ("cf_001", "fund_identifier", "STRING", "Unique identifier for a fund entity", "Fund"),
        ("cf_002", "fund_name", "STRING", "Legal name of the fund", "Fund"),
        ("cf_005", "net_asset_value", "DECIMAL", "Total net asset value of the fund", "Valuation"),
        ("cf_008", "investor_identifier", "STRING", "Unique identifier for an investor", "Investor"),
        ("cf_017", "transaction_date", "DATE", "Date the transaction occurred", "Transaction"),
    ]
    return spark.createDataFrame(
        rows, "canonical_id string, canonical_name string, data_type string, business_definition string, domain_category string"
    )


@pytest.fixture(scope="session")
def columns(spark):
    rows = [
        ("sc_001", "ledger", "FND_ID", "main.ledger.positions"),
        ("sc_002", "ledger", "NAV_AMT", "main.ledger.positions"),
        ("sc_003", "books", "fund_id", "main.books.investors"),
    ]
    return spark.createDataFrame(rows, "column_id string, platform_id string, column_name string, source_table string")


@pytest.fixture(scope="session")
def approved(spark):
    rows = [
        ("am_001", "sc_001", "cf_001", "mp_001", "ann", "2025-01-01 00:00:00"),
        ("am_002", "sc_002", "cf_005", "mp_002", "ann", "2025-01-02 00:00:00"),
        ("am_003", "sc_003", "cf_001", "mp_003", "bob", "2025-01-03 00:00:00"),
    ]
    return spark.createDataFrame(
        rows, "mapping_id string, column_id string, canonical_id string, proposal_id string, approved_by string, approved_at string"
    ).selectExpr("* except (approved_at)", "cast(approved_at as timestamp) approved_at")


@pytest.fixture(scope="session")
def rule_rows(spark):
    rows = [
        ("r1", "abbreviation", "fnd", "fund", "true"),
        ("r2", "abbreviation", "acct", "account", "TRUE"),
        ("r3", "abbreviation", "nav", "net_asset_value", "True"),
        ("r4", "abbreviation", "txn", "transaction", "false"),
        ("r5", "naming_convention", "snake", "snake_case", "true"),
    ]
    return spark.createDataFrame(rows, "rule_id string, rule_type string, pattern string, replacement string, is_active string")


@pytest.fixture(scope="session")
def platforms(spark):
    from fieldloom.settings import Platform, platform_frame

    listed = [Platform("ledger", "Ledger"), Platform("books", "Books"), Platform("empty", "Empty")]
    return listed, platform_frame(spark, listed, "main")
