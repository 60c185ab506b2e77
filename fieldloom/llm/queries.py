"""The operators over the given tables, one query each, with check SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import conversation_repair, exact_dedup, license_scan, line_rules, mixing, packing, periodic_runs, quality_model, simhash, token_files, toxicity, url_filter, warc
from fieldloom.session import materialize, shared_folder

#: Fixed: rules of hosts and paths. Names listed as spam, each under all the endings listed.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
SPAM_NAMES = ["casino-win", "spam-farm", "free-bets", "cheap-pills", "ads-track", "adult-x"]
ENDINGS = ["com", "net", "org", "info", "biz"]
SPAM = [f"{name}.example.{ending}/" for name in SPAM_NAMES for ending in ENDINGS]
#: Tokens of a sequence, and the ids that end a document.
CAPACITY, PACK_END, FILE_END = 2048, 0, 1
#: Scores from which a text counts as good, and as toxic.
GOOD, TOXIC = 0.3, 0.5
#: Target weights: the largest source makes 6 of 25 parts, the 19 others one each.
PARTS = {"src0": 6} | {f"src{n}": 1 for n in range(1, 20)}
BLOCK_ROWS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where(~held_out(F.col("doc_id")))


def url_list(spark: SparkSession) -> DataFrame:
    """The rules (kind 0) and the spam hosts (kind 1)."""
    rows = [f"('{e}', 0, '{v}')" for e, v in RULES.items()] + [f"('{e}', 1, 'block')" for e in SPAM]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(entry, kind, verdict)")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, folder, "pages"), url_list(spark))
    return judged.select("page_id", "host", "path", F.when(F.col("kind") == 0, F.col("entry")).alias("rule"), "verdict")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_model.train(docs, learnable(spark, folder))
    return _predicted(quality_model.score_quality(docs, model), GOOD)


def _predicted(scores: DataFrame, least: float) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, PACK_END)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, CAPACITY)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix whose scarce sources go round again, so that the target weights hold to its end."""
    return mixing.mix_passes(table(spark, folder, "documents"), PARTS, BLOCK_ROWS)


def mixing_once(spark: SparkSession, folder: str) -> DataFrame:
    """The mix that sends every row once; its weights hold until the first source has run out."""
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, PARTS, BLOCK_ROWS, docs.count())


def with_places(docs: DataFrame) -> DataFrame:
    """The documents with the file and the row they were read from (_file, _line), files in the order they were written.

    Rows of a frame that is read from no files are numbered as they come.
    """
    try:
        name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        # Task numbers are padded, so that they sort as numbers whatever their length.
        number = F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 10, "0")
        return docs.select("*", F.concat(number, name).alias("_file"), row.alias("_line"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        numbered = docs.withColumn("_at", at)
        return numbered.select(*docs.columns, F.lpad(F.shiftright("_at", 33).cast("string"), 10, "0").alias("_file"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_line"))


def mixed_sequences(docs: DataFrame) -> DataFrame:
    """The pieces of the documents as their order mixes them, each period of the schedule packed by itself.

    Sources take turns by their target weights, each sends its documents in the order of `docs`, and scarce sources go round
    again: so the sequences of every period have the target weights. One row per piece and pass; slot and place are those of
    its document.
    """
    numbered = with_places(docs).select("doc_id", "source", "text", "_file", "_line")
    pieces = packing.token_pieces(numbered, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, PACK_END, also=("source", "_file", "_line"))
    pieces = materialize(pieces.select("_file", "_line", "doc_id", "source", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "digest")
    # Each row of docs has one piece 0; from here on no text is read.
    order = mixing.mix_passes(pieces.where("piece = 0"), PARTS, BLOCK_ROWS, also=("_file", "_line"), order=("_file", "_line"))
    order = order.select(F.col("_file").alias("_of"), F.col("_line").alias("_at"), "pass", "period", "slot", "place")
    runs = pieces.join(order, (F.col("_file") == F.col("_of")) & (F.col("_line") == F.col("_at"))).drop("_file", "_line", "_of", "_at")
    packed = packing.pack_runs(runs, CAPACITY, "period", ("slot", "place", "piece"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "source", "pass", "slot", "place")


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    files = token_files.write_token_files(table(spark, folder, "documents"), place, public_tokenizers.path("word_bpe_49k.json"), FILE_END)
    read = token_files.read_token_files(spark, place, files)
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_report(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge_lines(table(spark, folder, "documents"), cleaned=False)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"), hash_all=True)
    return groups.withColumnRenamed("sha256", "text_sha256")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, learnable(spark, folder))
    return _predicted(toxicity.score_toxicity(docs, model), TOXIC)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by crc32(conv_id:turn) % 20; a null in either counts as one blank there."""
    blank = F.lit(" ")
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    kept = rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("_copy"),
    )
    return kept.drop("_copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    after = damaged(rows)
    reports = conversation_repair.repair_reports(after, rows)
    hashes = conversation_repair.repaired_hashes(after, reports).select(F.col("conv_id").alias("_of"), F.col("sha256").alias("repaired_sha256"))
    return reports.join(hashes, F.col("conv_id").eqNullSafe(F.col("_of"))).drop("_of")


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = warc.write_pages(table(spark, folder, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    columns = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    # Payloads are read and held against their digests, but not handed on.
    read = warc.read_archives(spark, place, columns, verify="true").where(F.col("record_type").isin("response", "revisit"))
    return read.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose crc32(doc_id) ends in 0 repeat their words from place a on with period p; others are as they were.

    A null id has no crc32 and changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")

    def repeated(w: Column) -> Column:
        # Each value is bound once by a transform over one element.
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        bound = F.struct(w.alias("w"), n.alias("n"), (g % n).alias("a"), (3 + g % 8).alias("parts"))
        place = lambda b, i: F.when(i < b.a, i).otherwise(b.a + (i - b.a) % (1 + F.floor((b.n - b.a) / b.parts)))
        joined = lambda b: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), b.n - 1), lambda i: F.get(b.w, place(b, i).cast("int"))), " ")
        return F.get(F.transform(F.array(bound), joined), F.lit(0))

    there = F.filter(F.array(words), lambda w: F.size(w) > 0)
    planted = F.coalesce(F.get(F.transform(there, repeated), F.lit(0)), F.col("text"))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    # Runs are in order of start and period, so the first of the greatest stays.
    best = F.aggregate(
        "runs", F.expr("cast(null as struct<start: long, length: long, period: long>)"),
        lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality, op3_packing, op4_mixing, op5_token_files, op6_license_scan, op7_simhash, op8_line_rules,
        op9_exact_dedup, op10_toxicity, op11_conversation_repair, op12_warc, op13_periodic_runs, mixing_once,
    )
}

#: crc32 of a text of ASCII characters in the check database: WITH entries, and the value of an expression.
CRC32_TABLE = """crc_steps AS (
            SELECT list(list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS steps
            FROM range(256) t(n)
        )"""


def check_crc32(expr: str) -> str:
    codes = f"list_transform(string_split({expr}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


CHECKS: dict[str, str] = {
    "op1_url_filter": """
        WITH cut AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), dotted AS (SELECT *, '.' || host AS h FROM cut), ruled AS (
            SELECT page_id, host, path, regexp_matches(h, '\\.(casino-win|spam-farm|free-bets|cheap-pills|ads-track|adult-x)\\.example\\.(com|net|org|info|biz)\\z') AS spam,
                CASE WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                    WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                    WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                    WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
                    WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM dotted
        )
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN spam AND starts_with(path, '/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op4_mixing": """
        WITH RECURSIVE parts AS (
            SELECT 'src' || n AS source, CASE WHEN n = 0 THEN 6 ELSE 1 END AS parts, row_number() OVER (ORDER BY 'src' || n) - 1 AS g FROM range(20) t(n)
        ), grouped AS (SELECT doc_id, d.source, coalesce(g, 20) AS g, coalesce(parts, 1) AS parts FROM documents d LEFT JOIN parts p ON p.source = d.source), counts AS (
            SELECT g, any_value(parts) AS parts, count(*) AS n FROM grouped GROUP BY g
        ), demand AS (SELECT max((n + 64 * parts - 1) // (64 * parts)) AS periods, sum(parts)::BIGINT AS total FROM counts), sizes AS (
            SELECT periods, total, max((n + periods * parts - 1) // (periods * parts)) AS size FROM counts, demand GROUP BY periods, total
        ), windows AS (
            SELECT row_number() OVER (ORDER BY (total * (k + 1) + parts - 1) // parts, g, k) AS urgency, g, k, total * k // parts AS release
            FROM counts, sizes, range(6) t(k) WHERE k < parts
        ), period AS (
            SELECT 0 AS slot, (SELECT min(urgency) FROM windows WHERE release <= 0) AS urgency, [(SELECT min(urgency) FROM windows WHERE release <= 0)] AS sent
            UNION ALL
            SELECT slot + 1, next, list_append(sent, next) FROM (
                SELECT p.slot, p.sent, min(w.urgency) AS next FROM period p, windows w, sizes
                WHERE p.slot < total - 1 AND w.release <= p.slot + 1 AND NOT list_contains(p.sent, w.urgency) GROUP BY p.slot, p.sent
            )
        ), ranked AS (
            SELECT doc_id, source, g, parts, row_number() OVER (PARTITION BY g ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS r FROM grouped
        ), passed AS (
            SELECT doc_id, source, g, r.parts, r, n, unnest(range((periods * r.parts * size - r - 1) // n + 1)) AS pass, total, size FROM ranked r JOIN counts c USING (g), sizes
        ), blocked AS (SELECT *, (r + pass * n) // size AS block, (r + pass * n) % size AS place FROM passed)
        SELECT doc_id, source, pass, block, block // parts AS period, block * total // parts AS release, ((block + 1) * total + parts - 1) // parts AS deadline,
            block // parts * total + slot AS slot, place
        FROM blocked b JOIN (windows JOIN period USING (urgency)) w ON w.g = b.g AND w.k = b.block % b.parts
    """,
    "mixing_once": """
        WITH RECURSIVE parts AS (
            SELECT 'src' || n AS source, CASE WHEN n = 0 THEN 6 ELSE 1 END AS parts FROM range(20) t(n)
        ), windows AS (
            SELECT row_number() OVER (ORDER BY (25 * (k + 1) + parts - 1) // parts, source, k) AS urgency, source, parts, k,
                25 * k // parts AS release
            FROM parts, range(6) t(k) WHERE k < parts
        ), period AS (
            SELECT 0 AS slot, (SELECT min(urgency) FROM windows WHERE release <= 0) AS urgency,
                [(SELECT min(urgency) FROM windows WHERE release <= 0)] AS sent
            UNION ALL
            SELECT slot + 1, next, list_append(sent, next) FROM (
                SELECT p.slot, p.sent, min(w.urgency) AS next FROM period p, windows w
                WHERE p.slot < 24 AND w.release <= p.slot + 1 AND NOT list_contains(p.sent, w.urgency) GROUP BY p.slot, p.sent
            )
        ), ranked AS (
            SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS place FROM documents
        ), blocked AS (
            SELECT doc_id, r.source, place, parts, CASE WHEN parts IS NOT NULL THEN place // 64 END AS block FROM ranked r LEFT JOIN parts USING (source)
        )
        SELECT doc_id, b.source, block, block * 25 // b.parts AS release, ((block + 1) * 25 + b.parts - 1) // b.parts AS deadline,
            block // b.parts * 25 + slot AS slot, CASE WHEN block IS NULL THEN place ELSE place % 64 END AS place
        FROM blocked b LEFT JOIN (windows JOIN period USING (urgency)) w ON w.source = b.source AND w.k = b.block % b.parts
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_conversation_repair": f"""
        WITH RECURSIVE {CRC32_TABLE}, hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {check_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc_steps
        ), damaged AS (
            SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged
        ), faulty AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN right(bare, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM numbered
        ), figures AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
        ), rests AS (
            -- The cheapest rest before row i: after nothing (e), after s, after u and after a.
            SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': ''}} AS e, {{'c': 4, 'a': 'II'}} AS s, {{'c': 2, 'a': 'I'}} AS u, {{'c': 0, 'a': ''}} AS a FROM figures
            UNION ALL
            SELECT conv_id, i,
                list_sort([e, {{'c': 2 + u.c, 'a': 'I' || u.a}}, {{'c': 4 + a.c, 'a': 'II' || a.a}}])[1], list_sort([s, {{'c': 2 + u.c, 'a': 'I' || u.a}}, {{'c': 4 + a.c, 'a': 'II' || a.a}}])[1],
                list_sort([u, {{'c': 2 + a.c, 'a': 'I' || a.a}}])[1], list_sort([a, {{'c': 2 + u.c, 'a': 'I' || u.a}}])[1]
            FROM (
                SELECT r.conv_id, r.i - 1 AS i,
                    list_sort([{{'c': 3 + e.c, 'a': 'D' || e.a}}] || CASE WHEN must THEN [] ELSE [{{'c': more + 2 + u.c, 'a': 'R' || u.a}}] END
                        || CASE WHEN must THEN [] WHEN initial = 'u' THEN [{{'c': more + u.c, 'a': 'K' || u.a}}] WHEN initial = 's' THEN [{{'c': more + s.c, 'a': 'K' || s.a}}] ELSE [] END)[1] AS e,
                    list_sort([{{'c': 3 + s.c, 'a': 'D' || s.a}}] || CASE WHEN must THEN [] WHEN initial = 'u' THEN [{{'c': more + u.c, 'a': 'K' || u.a}}] ELSE [{{'c': more + 2 + u.c, 'a': 'R' || u.a}}] END)[1] AS s,
                    list_sort([{{'c': 3 + u.c, 'a': 'D' || u.a}}] || CASE WHEN must THEN [] WHEN initial = 'a' THEN [{{'c': more + a.c, 'a': 'K' || a.a}}] ELSE [{{'c': more + 2 + a.c, 'a': 'R' || a.a}}] END)[1] AS u,
                    list_sort([{{'c': 3 + a.c, 'a': 'D' || a.a}}] || CASE WHEN must THEN [] WHEN initial = 'u' THEN [{{'c': more + u.c, 'a': 'K' || u.a}}] ELSE [{{'c': more + 2 + u.c, 'a': 'R' || u.a}}] END)[1] AS a
                FROM rests r JOIN (SELECT conv_id, i, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more FROM faulty) f
                    ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i - 1
            )
        ), audits AS (SELECT conv_id, e.c AS cost, e.a AS audit FROM rests WHERE i = 1), edits AS (
            SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS j FROM audits WHERE audit <> ''
        ), placed AS (
            SELECT conv_id, j, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i FROM edits
        ), made AS (
            SELECT p.conv_id, j, edit, role, text, row_number() OVER (PARTITION BY p.conv_id ORDER BY j) - 1 AS m
            FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND edit <> 'I' WHERE edit <> 'D'
        ), opened AS (
            SELECT *, max(CASE WHEN m = 0 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS opening FROM made
        ), repaired AS (
            SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (m - opening) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS sha
            FROM opened GROUP BY conv_id
        )
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
            LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
    """,
    "op12_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
        ), named AS (SELECT *, page_id IS NOT DISTINCT FROM first AS is_first, sha1(html) AS hex FROM payloads)
        SELECT page_id, strlen(html) AS payload_bytes, CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT is_first THEN first END AS refers_to,
            array_to_string(list_transform(range(32), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, k // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest
        FROM named
    """,
    "op13_periodic_runs": f"""
        WITH {CRC32_TABLE}, hashed AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {check_crc32("doc_id::VARCHAR")} AS h FROM documents, crc_steps
        ), cut AS (
            SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM hashed
        ), texts AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w
                ELSE list_transform(range(n), lambda i: w[(CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END) + 1]) END AS w FROM cut
        ), placed AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM texts), lagged AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i, row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS r
            FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), stretches AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM lagged GROUP BY doc_id, q, i - r HAVING count(*) + q >= greatest(6, 4 * q)
        ), runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length), listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
        ), best AS (
            SELECT DISTINCT ON (doc_id) doc_id, start, length, period FROM runs r
            ORDER BY doc_id, (SELECT count(*) FROM runs o WHERE o.doc_id = r.doc_id AND o.length * r.period > r.length * o.period), start, period
        ), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs), collapsed AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM texts t LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
    """,
}
