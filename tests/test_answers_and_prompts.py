import pandas as pd
from pyspark.sql import functions as F

from fieldloom.functions import prompt as P
from fieldloom.functions.answers import extract_json, parse_answers
from fieldloom.plans.mapping_run import answer, run_mapping
from fieldloom.plans.prompts import build_prompts, prepare_indexes

FULL = (
    'Sure: {"recommended_canonical_id": "cf_001", "recommended_canonical_name": "fund_identifier", "confidence": 92, "rationale": "Clear.",'
    ' "standardized_name": "fund_id", "data_type": "string", "business_definition": "d", "domain_category": "Fund",'
    ' "alternatives": [{"canonical_id": "cf_002", "canonical_name": "fund_name", "confidence": 30, "reason": "r"}]} bye'
)


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t, "fall") for i, t in enumerate(texts)], "i int, raw_text string, fall string")
    return parse_answers(df, fallback="fall").orderBy("i").collect()


def test_extract_json(spark):
    texts = ['{"key": "value"}', 'answer: {"key": "value"} done', "none", '{"a": {"b": 1}}', "}{", None, "x {\n1\n} y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.j for r in df.select("i", extract_json("t").alias("j")).orderBy("i").collect()]
    assert got == ['{"key": "value"}', '{"key": "value"}', "", '{"a": {"b": 1}}', "", "", "{\n1\n}"]


def test_parse_full_answer(spark):
    (row,) = parsed(spark, [FULL])
    assert (row.recommended_canonical_id, row.confidence, row.rationale, row.standardized_name, row.error) == ("cf_001", 92, "Clear.", "fund_id", None)
    assert row.alternatives[0].asDict() == {"canonical_id": "cf_002", "canonical_name": "fund_name", "confidence": "30", "reason": "r"}


def test_parse_defaults_and_nulls(spark):
    a, b, c = parsed(spark, ["{}", '{"rationale": null, "standardized_name": null, "alternatives": "x"}', '{"alternatives": [1, {"reason": "q"}]}'])
    assert (a.recommended_canonical_id, a.confidence, a.rationale, a.standardized_name, a.alternatives, a.error) == (None, 0, "", "fall", [], None)
    assert (b.rationale, b.standardized_name, b.alternatives) == (None, None, [])
    assert [x.reason for x in c.alternatives] == [None, "q"]


def test_parse_confidence(spark):
    values = ['90', '"90"', '90.7', '-3.9', 'true', '" 12 "', 'null', '"90.5"', '"high"', '[1]']
    rows = parsed(spark, ['{"confidence": %s}' % v for v in values])
    assert [r.confidence for r in rows] == [90, 90, 90, -3, 1, 12, 0, 0, 0, 0]
    assert [r.error is None for r in rows] == [True] * 6 + [False] * 4


def test_parse_failures_keep_the_fallback(spark):
    for row in parsed(spark, ["no json", '{"a": 1', '{"a": 1} and {"b": 2}', '{"a": 1}, {"b": 2}', None, "{'a': 1}", ""]):
        assert row.error and row.standardized_name == "fall" and row.confidence == 0 and row.alternatives == [], row


def test_repeated_keys_last_wins(spark):
    assert parsed(spark, ['{"confidence": 1, "confidence": 2}'])[0].confidence == 2


def test_prompt_layout(spark, vocabulary, columns, approved, rule_rows, platforms):
    rules = rule_rows.filter("is_active != 'false' and rule_type = 'abbreviation'").select("pattern", "replacement")
    headers = spark.createDataFrame([("n1", "FND_IDENTIFIER", "ledger"), ("n2", "FND_IDENTIFIER", "unknown"), ("n3", "zzz", "books")],
                                    "column_id string, column_name string, platform_id string")
    built = {r.column_id: r for r in build_prompts(headers, columns, approved, vocabulary, rules, platforms[1]).collect()}
    one, two, three = (built[k].prompt.split("\n") for k in ("n1", "n2", "n3"))
    assert one[:8] == [
        "You are a data standardization expert at a financial services firm.", "",
        "TASK: Given a source column, recommend the best canonical field.", "Use all the context below to make your decision.", "",
        "PLATFORM: Ledger", 'SOURCE COLUMN: "FND_IDENTIFIER"', 'RULE-STANDARDIZED: "fund_identifier"',
    ]
    assert two[5] == "PLATFORM: unknown" and two[6:] == one[6:]
    start = one.index("ACTIVE ABBREVIATION RULES:")
    assert one[start - 1] == "" and one[start + 1:start + 4] == ["  acct -> account", "  fnd -> fund", "  nav -> net_asset_value"]
    at = one.index("CANDIDATE CANONICAL FIELDS:")
    assert one[at + 1].startswith('  1. fund_identifier (STRING, Fund) - "Unique identifier for a fund entity" [score: ')
    at = one.index("CROSS-PLATFORM CONTEXT FOR TOP CANDIDATES:")
    assert one[at + 1:at + 4] == ["  fund_identifier:", '    - ledger: "FND_ID"', '    - books: "fund_id"']
    assert any(line.startswith('  1. "FND_ID" (ledger) -> canonical: fund_identifier [score: ') for line in one)
    assert one[-1] == "}" and "INSTRUCTIONS:" in one
    # Nothing found: the three sections are absent, the rest stays.
    assert not any(line.startswith(("SIMILAR", "CANDIDATE", "CROSS")) for line in three) and three[8] == "" and three[9] == "ACTIVE ABBREVIATION RULES:"
    assert built["n1"].context_pages == 1 and built["n3"].context_pages == 0
    indexes = prepare_indexes(columns, approved, vocabulary)
    again = build_prompts(headers, columns, approved, vocabulary, rules, platforms[1], indexes=indexes)
    assert {r.column_id: r.prompt for r in again.collect()} == {k: r.prompt for k, r in built.items()}


def test_scores_round_half_even(spark):
    got = spark.sql("select explode(array(0.25d, 0.35d, 12.05d, 3.0d)) x").select(P._score(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{x:.1f}" for x in (0.25, 0.35, 12.05, 3.0)]


def test_run_mapping(spark, vocabulary, columns, approved, rule_rows, platforms):
    fresh = spark.createDataFrame(
        [("n1", "books", "Fund Name", "main.books.x"), ("n2", "books", "FundName", "main.books.x"), ("n3", "ledger", "who knows", "main.l.y"),
         ("n4", "ledger", "bad one", "main.l.y"), ("n5", "ledger", "silent", "main.l.y")], columns.schema)
    source = columns.union(fresh)
    proposals = spark.createDataFrame([("n5", "rejected")], "column_id string, status string")
    responses = spark.createDataFrame([("n3", FULL), ("n4", "no json"), ("other", FULL)], "column_id string, raw_text string")
    args = (source, approved, vocabulary, rule_rows, proposals, platforms[1], "batch")
    run = run_mapping(*args, responses=responses)
    got = {r.column_id: (r.suggested_canonical_id, r.confidence, r.confidence_level, r.agent_model, r.status) for r in run.proposals.collect()}
    assert got == {
        "n1": ("cf_002", 95.0, "high", "deterministic", "pending_review"), "n2": ("cf_002", 90.0, "high", "deterministic", "pending_review"),
        "n3": ("cf_001", 92.0, "high", "model", "pending_review"),
    }
    assert {r.details for r in run.audit.collect()} >= {'{"column":"who knows","confidence":92}'}
    assert {r.entity_id for r in run.audit.collect()} == {r.proposal_id for r in run.proposals.collect()}
    kept = run_mapping(*args, responses=responses, use_fast_path=False, keep_errors=True).proposals
    assert {r.column_id: (r.suggested_canonical_id, r.confidence_level) for r in kept.collect()} == {"n3": ("cf_001", "high"), "n4": (None, "low")}

    def complete(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: '{"recommended_canonical_id": "cf_008", "confidence": 61}' if "who knows" in p else "pass")

    model = run_mapping(*args, complete=complete)
    assert {r.column_id: r.confidence_level for r in model.proposals.collect()} == {"n1": "high", "n2": "high", "n3": "medium"}
    assert model.prompts.count() == 3 and answer(model.prompts, complete).count() == 3
    alone = run_mapping(*args)
    assert alone.proposals.count() == 2 and alone.prompts.count() == 3
    nothing = run_mapping(*args, use_fast_path=False)
    assert nothing.proposals.count() == 0 and nothing.prompts.count() == 5


def test_long_rationales_are_cut(spark, vocabulary, columns, approved, platforms):
    fresh = columns.union(spark.createDataFrame([("n1", "books", "odd", "t")], columns.schema))
    responses = spark.createDataFrame([("n1", '{"rationale": "%s"}' % ("é" * 600))], "column_id string, raw_text string")
    none = spark.createDataFrame([], "column_id string, status string")
    row = run_mapping(fresh, approved, vocabulary, None, none, platforms[1], "b", responses=responses).proposals.first()
    assert row.reasoning == "é" * 500 and row.confidence_level == "low"


def test_first_run_without_any_mapping(spark, vocabulary, columns, approved, platforms):
    headers = columns.select("column_id", "column_name", "platform_id")
    built = build_prompts(headers, columns, approved.limit(0), vocabulary, None, platforms[1]).collect()
    assert len(built) == 3 and all(r.context_pages == 0 for r in built)
    assert not any("SIMILAR APPROVED" in r.prompt or "CROSS-PLATFORM" in r.prompt or "ABBREVIATION" in r.prompt for r in built)
    bare = build_prompts(headers, columns, approved.limit(0), vocabulary.limit(0), None, platforms[1]).collect()
    assert all("CANDIDATE CANONICAL FIELDS:" not in r.prompt for r in bare)


def test_text_after_the_object_is_an_error(spark):
    texts = ['{"confidence": 5}] junk }', '{"confidence": 5}] [{"x":1}', '{"confidence": 5}, {"x":1}', '{"a": 1}, "end": 0}', '{"confidence": 9007199254740993}']
    rows = parsed(spark, texts)
    assert all(r.error for r in rows[:4]) and rows[4].error is None and rows[4].confidence == 9007199254740993


def test_field_ids_of_another_type_are_row_errors(spark):
    from pyspark.sql.types import LongType

    from fieldloom.functions.answers import parse_answers
    from fieldloom.plans.mapping_run import typed_answers

    texts = ['{"recommended_canonical_id": "12", "confidence": 80}', '{"recommended_canonical_id": "cf", "confidence": 70}', '{"confidence": 60}', "x"]
    answers = parse_answers(spark.createDataFrame(list(enumerate(texts)), "column_id int, raw_text string"))
    got = [(r.recommended_canonical_id, r.confidence, r.error) for r in typed_answers(answers, LongType()).orderBy("column_id").collect()]
    assert got[:3] == [(12, 80, None), (None, 0, "field id is not of type bigint: cf"), (None, 60, None)]
    assert got[3][2].startswith("Failed to parse LLM response")


def test_a_prompt_may_hold_over_a_thousand_rules(spark, columns, approved, vocabulary, platforms):
    from fieldloom.plans.prompts import build_prompts

    rules = spark.range(1500).selectExpr("concat('zz', id) AS pattern", "concat('word', id) AS replacement")
    text = build_prompts(columns.limit(1), columns, approved, vocabulary, rules, platforms[1]).first().prompt
    assert sum(f"  zz{i} -> word{i}\n" in text for i in range(1500)) == 1500
