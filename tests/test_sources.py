import json

import pytest
from pyspark.sql import functions as F

from fieldloom import schemas
from fieldloom.operators.conform import Conformed, conform_all
from fieldloom.session import materialize, shared_folder
from fieldloom.settings import Platform, read_settings
from fieldloom.sources import discovery, seed, tables

FIELDS = '''canonical_id,canonical_name,data_type,business_definition,domain_category,is_locked,created_by
cf_001,fund_identifier,STRING,Unique identifier,Fund,TRUE,system
cf_010,investor_type,STRING,"Classification (institutional, ""retail"", etc.)",Investor,FALSE,system
'''
RULES = '''rule_id,rule_type,pattern,replacement,description,is_active
rule_001,abbreviation,acct,account,Account abbreviation,TRUE
'''


@pytest.fixture
def seeds(tmp_path):
    (tmp_path / "fields.csv").write_text(FIELDS)
    (tmp_path / "rules.csv").write_text(RULES)
    (tmp_path / "a.csv").write_text("FND_ID,NAV_AMT,NOTE\nF-1,10.5,\nF-2,,x\n")
    (tmp_path / "b.csv").write_text("Fund_Name,Vintage\nAlpha,2020\n")
    return tmp_path


def test_seed_files(spark, seeds):
    fields = seed.read_fields(spark, str(seeds / "fields.csv"))
    assert fields.columns == schemas.CANONICAL_FIELDS.fieldNames()
    rows = {r.canonical_id: r for r in fields.collect()}
    assert rows["cf_010"].business_definition == 'Classification (institutional, "retail", etc.)'
    assert (rows["cf_001"].is_active, rows["cf_010"].is_active) == (True, False) and rows["cf_001"].created_at == rows["cf_001"].updated_at
    assert seed.read_rules(spark, str(seeds / "rules.csv")).first().is_active is True


def test_platform_tables_and_discovery(spark, seeds):
    listed = [
        Platform("a", "A", seed_file="a.csv", seed_table="positions"), Platform("b", "B", catalog="other", schema="s", seed_file="b.csv", seed_table="t"),
        Platform("c", "C"), Platform("d", "D", seed_file="missing.csv", seed_table="t"),
    ]
    loaded = seed.read_platforms(spark, listed, str(seeds), {"a": "FND_ID string, NAV_AMT double, NOTE string"})
    assert {(p.id, name) for p, name in loaded} == {("a", "harmonised.a.positions"), ("b", "other.s.t")}
    found = discovery.discover_columns(spark, loaded)
    assert {(r.platform_id, r.column_name, r.data_type) for r in found.collect()} == {
        ("a", "FND_ID", "string"), ("a", "NAV_AMT", "double"), ("a", "NOTE", "string"), ("b", "Fund_Name", "string"), ("b", "Vintage", "int")}
    known = spark.createDataFrame([], schemas.SOURCE_COLUMNS)
    first = discovery.register_columns(found, known, "b1")
    assert first.columns == schemas.SOURCE_COLUMNS.fieldNames() and first.count() == 5
    assert discovery.register_columns(found, first, "b2").isEmpty()


def test_tables(spark, tmp_path):
    tables.create_tables(spark, "meta")
    tables.create_tables(spark, "meta")
    assert tables.load_metadata(spark, "meta", "audit_log").isEmpty()
    rows = spark.createDataFrame([("e1", "mapping"), ("e2", "proposal"), ("e3", "rule")], "event_id string, entity_type string")
    tables.append(rows.withColumn("created_at", F.current_timestamp() + F.expr("make_interval(0,0,0,int(substr(event_id,2)))")), "meta.audit_log")
    tables.append(rows.limit(0), "meta.audit_log")
    assert [r.event_id for r in tables.load_metadata(spark, "meta", "audit_log", 2).collect()] == ["e3", "e2"]
    assert tables.load_table(spark, "meta.nowhere", schemas.AUDIT_LOG).isEmpty()
    assert tables.load_table(spark, "meta.audit_log", schemas.SOURCE_COLUMNS, schemas.READ_ORDER["source_columns"]).isEmpty()
    tables.replace(spark.range(2), "meta.audit_log")
    assert spark.table("meta.audit_log").columns == ["id"]
    tables.reset(spark, "meta")
    assert tables.load_metadata(spark, "meta", "audit_log").isEmpty() and spark.table("meta.audit_log").columns == schemas.AUDIT_LOG.fieldNames()
    tables.write_report(spark.createDataFrame([('a "q", b', 1)], "name string, n int"), str(tmp_path / "report"))
    assert seed.read_seed(spark, str(tmp_path / "report"), "name string, n int").first().name == 'a "q", b'


def test_publish(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS ledger_db")
    df = spark.createDataFrame([("F1", 2.0)], "FND_ID string, `odd``name` double")
    df.write.mode("overwrite").saveAsTable("ledger_db.positions")
    name = "spark_catalog.ledger_db.positions"
    pairs = spark.createDataFrame([(name, "FND_ID", "fund_identifier"), (name, "odd`name", "value")], "source_table string, column_name string, canonical_name string")
    done = conform_all({name: spark.table("ledger_db.positions")}, pairs)
    failed = Conformed("spark_catalog.ledger_db.missing", df, (("x", "y"),))
    clash = Conformed("spark_catalog.ledger_db.clash", error="both map to y")
    owners = {c.source_table: "ledger" for c in [*done, failed, clash]}
    count, errors = tables.publish(spark, [failed, clash, *done], owners, gold="gold_db")
    assert count == 1 and set(errors) == {failed.source_table, clash.source_table}
    view = spark.table("gold_db.ledger__positions")
    assert view.columns == ["fund_identifier", "value"] and tuple(view.first()) == ("F1", 2.0)
    assert tables.publish(spark, done, owners) == (1, {}) and spark.table("ledger__positions").columns == ["fund_identifier", "value"]
    found = discovery.discover_catalog(spark, [Platform("ledger", "L", schema="ledger_db"), Platform("x", "X", schema="no_such_db")])
    assert {(r.source_table, r.column_name) for r in found.collect()} == {(name, "FND_ID"), (name, "odd`name")}


def test_settings(spark, tmp_path):
    config = {
        "main": {"catalog": "cat"}, "gold": {"schema": "g"}, "agent": {"confidence_high_min": 80, "max_rationale_length": 9}, "llm": {"endpoint": "m"},
        "platforms": [{"id": "a", "name": "A", "seed_csv": "a.csv", "seed_table": "t"}, {"id": "b", "name": "B", "source_catalog": "c2", "source_schema": "s2"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    s = read_settings(str(tmp_path / "c.json"))
    assert (s.catalog, s.gold_catalog, s.gold_schema, s.high_min, s.medium_min, s.rationale_length, s.model) == ("cat", "cat", "g", 80, 60, 9, "m")
    assert [(r.ord, r.platform_id, r.location) for r in s.platform_frame(spark).orderBy("ord").collect()] == [(0, "a", "cat.a"), (1, "b", "c2.s2")]


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5).withColumn("x", F.lit(None).cast("array<string>")), "t")
    assert df.count() == 5 and df.inputFiles()[0].find("/t-") > 0


def test_publication_event(spark):
    from fieldloom.sources.tables import publication_event

    row = publication_event(spark, 3, "ann").first()
    assert (row.entity_type, row.entity_id, row.action, row.actor, row.details) == ("gold_views", "batch", "created", "ann", '{"count":3}')
    assert publication_event(spark, 0, "ann").count() == 0


def test_written_frames_can_be_dropped(spark):
    from pathlib import Path

    from fieldloom.operators.bm25 import bm25_search, build_index

    docs = spark.createDataFrame([(1, "fund name"), (2, "net asset value"), (3, "trade date")], "id int, text string")
    index = build_index(docs, "id", "text")
    paths = [Path(p) for p in index.written]
    assert len(paths) == 4 and all(p.exists() for p in paths)
    asked = spark.createDataFrame([(9, "asset")], "q int, text string")
    assert [r.doc_id for r in bm25_search(asked, "q", "text", index).collect()] == [2]
    index.drop()
    assert not any(p.exists() for p in paths)


def test_columns_with_figures(spark, seeds, tmp_path):
    a, b = Platform("a", "A"), Platform("b", "B")
    odd = spark.createDataFrame([(1, "x", [1.5], None), (1, "y", [1.5], None), (None, "", None, None)], "`n``1` int, s string, l array<double>, e string")
    gone = spark.range(1).withColumn("x", F.expr("raise_error('unreadable')").cast("string"))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table PAR1")
    broken = spark.read.schema("x int").parquet(str(tmp_path / "broken.parquet"))
    found = discovery.profile_columns(spark, {(a, "odd"): odd, (a, "empty"): odd.limit(0), (b, "gone"): gone, (b, "broken"): broken})
    got = {(r.source_table, r.column_name): (r.platform_id, r.data_type, r.rows, r.nulls, r.distinct_values) for r in found.collect()}
    assert got == {
        ("odd", "n`1"): ("a", "int", 3, 1, 1), ("odd", "s"): ("a", "string", 3, 0, 3), ("odd", "l"): ("a", "array<double>", 3, 1, 1),
        ("odd", "e"): ("a", "string", 3, 3, 0), **{("empty", c): ("a", odd.schema[c].dataType.simpleString(), 0, 0, 0) for c in odd.columns},
    }
    assert discovery.profile_columns(spark, {}).isEmpty()
