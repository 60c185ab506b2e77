import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators.rules import abbreviation_map, active_abbreviations, standardize_headers

SEED_RULES = dict(
    acct="account", amt="amount", bal="balance", ccy="currency", cust="customer", desc="description", dt="date", fnd="fund",
    inv="investor", mgr="manager", mkt="market", nav="net_asset_value", num="number", perf="performance", pos="position",
    prc="price", qty="quantity", sec="security", txn="transaction", val="value", yr="year", mth="month",
)

SEED_NAMES = """
FND_ID fund_id|FUND_NM fund_nm|BASE_CCY base_currency|NAV_AMT net_asset_value_amount|NAV_DT net_asset_value_date|INV_CODE investor_code|
INVESTOR_NAME investor_name|COMMIT_AMT commit_amount|CALLED_CAP called_cap|DIST_AMT dist_amount|MGMT_FEE_PCT mgmt_fee_pct|TXN_DT transaction_date|
fund_ccy fund_currency|nav_per_unit net_asset_value_per_unit|sec_id security_id|FundCode fundcode|LPName lpname|TXN_AMT transaction_amount|
POS_QTY position_quantity|MKT_VAL market_value|ACCT_NUM account_number|Current_Mkt_Value current_market_value|Fund_Desc fund_description|
Perf_Fee_Amt performance_fee_amount|LP_Acct_ID lp_account_id|Reporting_Qtr reporting_qtr
"""


def run(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", make(F.col("c")).alias("x")).orderBy("i").collect()]


def test_tokenize(spark):
    got = run(spark, ["fund_identifier", "Fund-Name.value", "", None, " a\xa0b,,c "], T.tokenize)
    assert got == [["fund", "identifier"], ["fund", "name", "value"], [], [], ["a", "b", "c"]]


def test_standardize_plain(spark):
    pairs = {
        "Fund Name": "fund_name", "Acct-ID": "acct_id", "FundCode": "fundcode", "SELECT": "select_field", "1st_quarter": "n_1st_quarter",
        "# of Units": "count_of_units", "#offset": "offset", "日本": "日本", "": "", "()": "()", "a\xa0b": "a_b", "a\x1cb": "a_b",
        "Fee %": "fee_pct", "A (B c) (D)": "a_b_c_d", "(only)": "only", "((x))": "x", "__a__b__": "a_b",
        "This Is A Very Long Column Header Indeed": "this_is_a_very_long_column_hea",
        "abcdefghij abcdefghij abcdefgh x": "abcdefghij_abcdefghij_abcdefgh",
    }
    assert run(spark, list(pairs), T.standardize) == list(pairs.values())


def test_standardize_with_rules(spark):
    pairs = dict(p.split() for p in SEED_NAMES.replace("\n", "").split("|"))
    assert run(spark, list(pairs), lambda c: T.standardize(c, SEED_RULES)) == list(pairs.values())
    assert run(spark, ["NAV (USD)", "FND_ID"], lambda c: T.standardize(c, {"nav": "net_asset_value", "fnd": "fund"})) == [
        "net_asset_value_usd", "fund_id"]
    # Upper-case patterns never meet a lower-case token; a replacement may empty or prefix the name.
    assert run(spark, ["FND_ID"], lambda c: T.standardize(c, {"FND": "fund"})) == ["fnd_id"]
    assert run(spark, ["q_one"], lambda c: T.standardize(c, {"q": "4th_"})) == ["n_4th_one"]
    assert run(spark, ["Q q"], lambda c: T.standardize(c, {"q": "_"})) == ["q_q"]


def test_active_rules(spark, rule_rows):
    rows = rule_rows.union(spark.createDataFrame([("r9", "abbreviation", "fnd", "fundus", "true")], rule_rows.schema))
    found = {r.pattern: r.replacement for r in active_abbreviations(rule_rows).collect()}
    assert found == {"fnd": "fund", "acct": "account", "nav": "net_asset_value"}
    assert abbreviation_map(active_abbreviations(rows))["fnd"] == "fundus"
    assert abbreviation_map(active_abbreviations(rule_rows), limit=2) is None


def test_joined_rules_equal_literal_rules(spark):
    headers = ["FND_ID", "Acct num (nav)", "", None, "1 QTY", "SELECT", "nav_nav_x", "()", "FND_ID"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, header string")
    rules = spark.createDataFrame(list(SEED_RULES.items()), "pattern string, replacement string")
    few = standardize_headers(df, "header", rules)
    many = standardize_headers(df, "header", rules, limit=3)
    key = lambda r: (r.i, r.standardized)
    assert sorted(map(key, few.collect())) == sorted(map(key, many.collect()))


def test_ids_are_stable(spark):
    a, b = (run(spark, ["x", None], lambda c: T.stable_id(c, F.lit("k"))) for _ in range(2))
    assert a == b and a[0] != a[1] and all(len(x) == 32 and set(x) <= set("0123456789abcdef") for x in a)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_names_keep_their_form(spark, values):
    values = [v.replace("\x00", "").encode("utf8", "ignore").decode() for v in values]
    allowed = set(string.ascii_lowercase + string.digits + "_")
    for header, name in zip(values, run(spark, values, T.standardize)):
        fallback = header.lower().replace(" ", "_")[:30]
        assert name == fallback or (
            set(name) <= allowed and len(name) <= 36 and not name[0].isdigit() and "__" not in name and name.strip("_") == name
        )
        if name != fallback:
            # A standardised name is its own standardised name.
            assert run(spark, [name], T.standardize) == [name]
