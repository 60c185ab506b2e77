"""The test tables in the roles the operators expect, for Spark and, in the same terms, as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fieldloom.session import spread
from fieldloom.settings import Platform

# Each role is one SELECT that Spark and the check database both run.
ROLES = {
    "platforms": """
        SELECT n_nationkey AS ord, CAST(n_nationkey AS BIGINT) AS platform_id, n_name AS name,
               concat('Systems of ', n_name) AS description, concat('main.', n_name) AS location
        FROM nation""",
    "source_columns": """
        SELECT c_custkey AS column_id, CAST(c_nationkey AS BIGINT) AS platform_id,
               concat('cat.seg.', c_mktsegment) AS source_table, c_name AS column_name, 'STRING' AS data_type
        FROM customer""",
    "canonical_fields": """
        SELECT p_partkey AS canonical_id, replace(p_name, ' ', '_') AS canonical_name, p_brand AS data_type,
               concat(p_type, ' ', p_name, ' by ', p_brand) AS business_definition, p_type AS domain_category,
               CASE WHEN p_size > 40 THEN false WHEN p_size > 20 THEN true END AS is_active
        FROM part""",
    # Fields whose ids repeat: an older name stands beside the one that counts, which is the last in order.
    "repeated_fields": """
        SELECT p_partkey AS canonical_id, replace(p_name, ' ', '_') AS canonical_name, p_type AS domain_category FROM part
        UNION ALL SELECT p_partkey, concat(lower(p_type), '_', p_partkey % 10), p_type FROM part WHERE p_partkey % 3 = 0""",
    "approved_mappings": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS BIGINT), '-',
                      CAST(CAST(l_shipdate AS DATE) AS STRING)) AS mapping_id, o_custkey AS column_id,
               l_partkey AS canonical_id, o_orderkey AS proposal_id, o_orderpriority AS approved_by,
               o_orderdate AS approved_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    # Columns whose ids repeat: a supplier may bear the id of a customer.
    "repeated_columns": """
        SELECT c_custkey AS column_id, CAST(c_nationkey AS BIGINT) AS platform_id,
               concat('cat.seg.', c_mktsegment) AS source_table, c_name AS column_name, 'STRING' AS data_type
        FROM customer
        UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT), 'cat.buy.supplier', s_name, 'STRING' FROM supplier""",
    # Five fields share all mappings, so each has very many on every platform.
    "busy_mappings": """
        SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS BIGINT), '-',
                      CAST(CAST(l_shipdate AS DATE) AS STRING)) AS mapping_id, o_custkey AS column_id,
               l_partkey % 5 + 1 AS canonical_id, o_orderdate AS approved_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "mapping_proposals": """
        SELECT o_orderkey AS proposal_id, o_custkey AS column_id, s.suggested AS suggested_canonical_id,
               concat('proposed ', o_orderpriority) AS suggested_canonical_name, o_totalprice % 100 AS confidence,
               CASE WHEN o_totalprice % 100 >= 85 THEN 'high' WHEN o_totalprice % 100 >= 60 THEN 'medium' ELSE 'low' END
                 AS confidence_level,
               concat('Order of priority ', o_orderpriority) AS reasoning, 'model' AS agent_model, 'b0' AS batch_id,
               CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending_review'
                    WHEN o_orderpriority = '1-URGENT' THEN 'flagged' ELSE 'rejected' END AS status,
               o_orderdate AS created_at, CAST(NULL AS TIMESTAMP_NTZ) AS reviewed_at, CAST(NULL AS STRING) AS reviewed_by
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS suggested FROM lineitem GROUP BY l_orderkey) s
          ON s.l_orderkey = o_orderkey""",
    "audit_log": """
        SELECT event_id, CASE event_type WHEN 'view' THEN 'mapping' WHEN 'click' THEN 'mapping' WHEN 'purchase' THEN 'proposal'
                                         WHEN 'signup' THEN 'canonical' END AS entity_type,
               props AS details, event_type AS action, concat('user ', user_id) AS actor, ts AS created_at
        FROM events""",
    "decisions": """
        SELECT event_id AS decision_id, CAST(floor(value * 10) AS BIGINT) AS proposal_id,
               CASE event_type WHEN 'view' THEN 'flag' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'reassign'
                               ELSE 'approve' END AS action,
               CASE WHEN event_type = 'purchase' THEN user_id END AS canonical_id,
               concat('user ', user_id) AS actor, ts AS decided_at
        FROM events""",
    "headers": """
        SELECT concat('d', doc_id) AS header_id, text AS header FROM documents
        UNION ALL SELECT concat('u', page_id), url FROM pages
        UNION ALL SELECT concat('s', s_suppkey), s_name FROM supplier
        UNION ALL SELECT concat('p', p_partkey), concat(p_brand, ' (', p_name, ') % ', p_type) FROM part
        UNION ALL SELECT concat('o', o_orderkey), o_orderpriority FROM orders""",
    "intake_columns": """
        SELECT p_partkey AS column_id, CAST(p_size AS BIGINT) AS platform_id,
               concat('cat.', replace(p_brand, '#', '_'), '.', p_type) AS source_table,
               CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_name
                    WHEN p_type IN ('SMALL', 'MEDIUM') THEN replace(p_name, ' ', '')
                    ELSE concat(p_brand, ' ', p_name, ' qty') END AS column_name, 'STRING' AS data_type
        FROM part""",
    # One column per class of parts, its class for a name.
    "class_columns": """
        SELECT min(p_partkey) AS column_id, CAST(min(p_size) AS BIGINT) AS platform_id, 'cat.classes' AS source_table, p_type AS column_name,
               'STRING' AS data_type
        FROM part GROUP BY p_type""",
    "intake_approved": """
        SELECT concat('m', doc_id) AS mapping_id, doc_id AS column_id, doc_id AS canonical_id FROM labels""",
    "intake_proposals": """
        SELECT event_id AS proposal_id, event_id AS column_id,
               CASE event_type WHEN 'view' THEN 'pending_review' WHEN 'click' THEN 'approved' WHEN 'signup' THEN 'flagged'
                               ELSE 'rejected' END AS status
        FROM events""",
    "responses": """
        SELECT conv_id * 20 + turn AS column_id,
               CASE role
                 WHEN 'user' THEN concat('Answer: {"recommended_canonical_id": "', conv_id, '", "recommended_canonical_name": "field_',
                   turn, '", "confidence": ', length(text) % 101, ', "rationale": "', replace(replace(replace(text, '\\\\', ' '), '"', ' '), chr(10), ' '),
                   '", "alternatives": [{"canonical_id": "', turn, '", "reason": "close"}]} done')
                 WHEN 'assistant' THEN concat('{"recommended_canonical_id": null, "confidence": "', length(text) % 101,
                   '", "data_type": "string", "alternatives": "none"}')
                 ELSE concat('{"confidence": ', turn, ', ', 'not closed') END AS raw_text
        FROM conversations""",
    "rules": """
        SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS pattern, concat(lower(p_type), '_class') AS replacement, p_type AS rule_id,
               'abbreviation' AS rule_type, CASE WHEN p_type = 'PROMO' THEN 'FALSE' ELSE 'TRUE' END AS is_active
        FROM part""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Tables of long texts: a single small file of them is worth spreading over the cores.
LONG_TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LONG_TEXTS else df


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The role as a frame over the tables in `folder`; the SELECT names them by placeholders."""
    text = ROLES[name].replace("{", "{{").replace("}", "}}")
    used = {t: table(spark, folder, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    query = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text)
    return spark.sql(query, **used)


def platform_list(spark: SparkSession, folder: str) -> list[Platform]:
    """The platform configuration; a list by nature, so it may be read to the driver."""
    rows = role(spark, folder, "platforms").orderBy("ord").collect()
    return [Platform(r.platform_id, r.name, r.description) for r in rows]


def role_sql(*names: str) -> str:
    """The roles as leading WITH entries for check SQL."""
    parts = [f"{n} AS ({_check_dialect(ROLES[n])})" for n in names]
    return "WITH " + ",\n".join(parts)


def _check_dialect(select: str) -> str:
    return select.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("AS STRING", "AS VARCHAR").replace("'\\\\'", "'\\'")
