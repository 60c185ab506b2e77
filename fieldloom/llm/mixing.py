"""Mix sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks of equal size. A source with `parts` of the `total` parts owes block k
(from 0) a window of slots: it is released at floor(k * total / parts) and due at ceil((k + 1) * total / parts). One
block is sent per slot, of the released blocks the one with the earliest deadline. As the parts sum up to the total,
every block is sent within its window, so after any number of slots each source is less than one block away from its
target. The windows repeat every `total` slots, so the schedule of one period says the slot of every block: nothing is
simulated that grows with the data.

`mix` sends every row once. When a source has no blocks left its slots stay empty, and the others go on in their
proportions: from there on the target weights are not reached. `mix_passes` sends scarce sources again until every row
has been sent, so that the weights hold to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.ranks import rank_by_share, spread_rank

#: Passes of a row that are made at once.
PASSES = 1024


def period(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """Earliest deadline first over one period: (source, block, release, deadline, slot), ties by source."""
    total = sum(parts.values())
    waiting = [(-(-(k + 1) * total // n), source, k, k * total // n) for source, n in parts.items() for k in range(n)]
    sent = []
    for slot in range(total):
        due, source, k, release = min(b for b in waiting if b[3] <= slot)
        waiting.remove((due, source, k, release))
        sent.append((source, k, release, due, slot))
    return sent


def mix(docs: DataFrame, parts: dict[str, int], block_rows: int, rows: int, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, source, block, release, deadline, slot, place.

    Ordering by (slot, place) gives the mix; place is the row's place in its block. Within a source rows are taken in
    the order of md5(doc_id), then of doc_id; repeated rows are separate rows. Rows whose source is null or has no
    parts stay in the result, after the mix: block, release, deadline and slot are null, place is their rank in their
    source. `rows` is the number of rows of `docs`. An empty table gives no rows. Other columns are not read.
    """
    total = sum(parts.values())
    listed = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"))
    ranked = spread_rank(listed, ["source"], F.col("doc_id"), ["doc_id"], rows, "_rank")
    values = ", ".join(f"({_text(s)}, {n}L, {k}L, {slot}L)" for s, k, _, _, slot in period(parts) for n in [parts[s]])
    table = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_source, _parts, _k, _slot)")
    shares = docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({_text(s)}, {n}L)" for s, n in parts.items()) + " AS t(_of, _n)")
    # Both tables are as long as the parts that the caller gives.
    blocks = ranked.join(F.broadcast(shares), F.col("source") == F.col("_of"), "left").withColumn(
        "block", F.when(F.col("_n").isNotNull(), F.expr(f"_rank div {block_rows}"))
    )
    placed = blocks.join(F.broadcast(table), (F.col("source") == F.col("_source")) & (F.col("block") % F.col("_parts") == F.col("_k")), "left")
    return placed.select(
        "doc_id", "source", "block",
        F.expr(f"(block * {total}) div _parts").alias("release"),
        F.expr(f"((block + 1) * {total} + _parts - 1) div _parts").alias("deadline"),
        F.expr(f"(block div _parts) * {total} + _slot").alias("slot"),
        F.when(F.col("block").isNull(), F.col("_rank")).otherwise(F.col("_rank") % block_rows).alias("place"),
    )


def demand(counts: dict, parts: dict, block_rows: int) -> tuple[int, int]:
    """(periods, rows a block) with which every source has sent all its rows: the fewest periods, then the smallest blocks."""
    periods = max(-(-n // (block_rows * parts[s])) for s, n in counts.items())
    return periods, max(-(-n // (periods * parts[s])) for s, n in counts.items())


def mix_passes(
    docs: DataFrame, parts: dict[str, int], block_rows: int, rest_parts: int = 1, id_column: str = "doc_id", source_column: str = "source",
    also: tuple[str, ...] = (), order: tuple[str, str] | None = None,
) -> DataFrame:
    """The mix at its target weights to the end.

    Gives doc_id, source, `also`, pass, block, period, release, deadline, slot, place.

    Every row of `docs` is sent in pass 0. A source goes round again, in the same order, until the source with the most
    rows for its parts has sent all of its own, which fills a whole number of periods: the weights are exact after each
    period, and after any row in the order of (slot, place) each source is less than one block from its target. Blocks
    hold `block_rows` rows at most, and all hold equally many. Rows of all other sources, also of null, count as one
    source of `rest_parts` parts; sources without rows get no slots. Within a source rows are taken in the order of
    md5(doc_id), then of doc_id and `also`; or, if given, in the `order` of two columns, the first of which parts the rows
    into shares of bounded size. An empty table gives no rows.
    """
    spark, rest = docs.sparkSession, len(parts)
    number = {s: i for i, s in enumerate(sorted(parts))}
    listed = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), *also, *(order or ()))
    known = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({_text(s)}, {i})' for s, i in number.items())} AS t(_of, _known)") if parts else None
    grouped = listed.withColumn("_group", F.lit(rest))
    if parts:
        # As long as the parts that the caller gives, like the other tables that are broadcast here.
        grouped = listed.join(F.broadcast(known), F.col("source") == F.col("_of"), "left").select(*listed.columns, F.coalesce("_known", F.lit(rest)).alias("_group"))
    counts = {r[0]: r[1] for r in grouped.groupBy("_group").agg(F.count("*")).collect()}
    weights = {i: parts[s] for s, i in number.items() if i in counts} | ({rest: rest_parts} if rest in counts else {})
    total = sum(weights.values())
    periods, size = demand(counts, weights, block_rows) if counts else (1, 1)
    if order is None:
        ranked = spread_rank(grouped, ["_group"], F.col("doc_id"), ["doc_id", *also], sum(counts.values()), "_rank")
    else:
        ranked = rank_by_share(grouped, ["_group"], order[0], [order[1]], "_rank")
    shares = ", ".join(f"({g}, {n}L, {weights[g]}L, {periods * weights[g] * size}L)" for g, n in counts.items()) or "(-1, 1L, 1L, 0L)"
    sized = ranked.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {shares} AS t(_g, _n, _parts, _quota)")), F.col("_group") == F.col("_g"))
    sized = sized.withColumn("_last", F.expr("(_quota - _rank - 1) div _n"))
    most = max((periods * weights[g] * size // n for g, n in counts.items()), default=0)
    if most < PASSES:
        sent = sized.withColumn("pass", F.explode(F.expr("sequence(0L, _last)")))
    else:
        # A row that goes round very often is spread over tasks first.
        lots = sized.withColumn("_lot", F.explode(F.expr(f"sequence(0L, _last, {PASSES}L)"))).repartition("doc_id", "_rank", "_lot")
        sent = lots.withColumn("pass", F.explode(F.expr(f"sequence(_lot, least(_last, _lot + {PASSES - 1}L))")))
    blocks = sent.withColumn("_at", F.expr("_rank + pass * _n")).withColumn("block", F.expr(f"_at div {size}"))
    values = ", ".join(f"({g}, {k}L, {slot}L)" for g, k, _, _, slot in period(weights)) or "(-1, 0L, 0L)"
    table = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(_source, _k, _slot)"))
    placed = blocks.join(table, (F.col("_group") == F.col("_source")) & (F.col("block") % F.col("_parts") == F.col("_k")))
    return placed.select(
        "doc_id", "source", *also, "pass", "block", F.expr("block div _parts").alias("period"),
        F.expr(f"(block * {total}) div _parts").alias("release"),
        F.expr(f"((block + 1) * {total} + _parts - 1) div _parts").alias("deadline"),
        F.expr(f"(block div _parts) * {total} + _slot").alias("slot"),
        F.expr(f"_at % {size}").alias("place"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
