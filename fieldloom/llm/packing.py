"""Best-fit packing of documents into sequences of a fixed number of tokens.

The method is bulk-synchronous best fit. Pieces are ordered by length, longest first, and ranked within their length;
gaps are kept in order of their free space. One superstep sweeps one length: its successor, the smallest free space that
holds a piece, is looked up among the gaps, every piece of the length is matched at once, the rank says which piece gets
which gap, and the gaps that were hit go back into the order with what they have left. Only where no gap holds the
length are sequences opened.

Pieces of one length differ only in rank, and gaps hit in one superstep have equal space, so both are held in runs: a
length with its number of pieces, a free space with its first sequence and its number of sequences. There are at most
`capacity` lengths however large the corpus is, so the supersteps work on a few thousand runs on the driver; the pieces
themselves are only ranked and matched to their run, in parallel, by Spark.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.ranks import spread_rank
from fieldloom.llm.tokens import encoder, packed
from fieldloom.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Runs whose sequences are summed up by one task.
LOT_RUNS = 4096


class Placement(NamedTuple):
    """Pieces of one length, from one rank on: `each` to a sequence, from `sequence` and `offset` on."""

    length: int
    rank: int
    pieces: int
    sequence: int
    each: int
    offset: int


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Cut a document: pieces of `capacity`, of which the first may be shorter."""
    count = max(1, -(-tokens // capacity))
    return [tokens - capacity * (count - 1)] + [capacity] * (count - 1)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_column: str = "doc_id", text_column: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of all documents with their ids, as bytes of little-endian unsigned 32-bit integers.

    Null text counts as empty; each document ends with `end_id`, so an empty one has one id. Texts are encoded whole,
    however long. Null and repeated document ids are kept as they are. The columns `also` come along with each piece;
    no others are read.
    """
    end = packed([end_id])
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"), *also)
    schema = ", ".join([PIECES, *(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[2:])])

    def cut(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            out, of = {k: [] for k in ("doc_id", "piece", "start", "length", "ids")}, []
            for row_at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids, at = encode(text.as_py()) + end, 0
                for number, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    row = (doc, number, at, length, ids[4 * at : 4 * (at + length)])
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    of.append(row_at)
                    at += length
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *(c.take(pa.array(of, pa.int64())) for c in batch.columns[2:])], [*out, *also])

    return texts.mapInArrow(cut, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Place all pieces, given how many there are of each length, by supersteps over lengths from the longest on."""
    placements: list[Placement] = []
    gaps: list[tuple[int, int, int]] = []  # free space, first sequence, sequences; in order
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                free, first, there = capacity, opened, -(-left // (capacity // length))
                opened += there
            else:
                free, first, there = gaps.pop(at)
            each = free // length
            full = min(there, left // each)
            over = min(left - full * each, each - 1) if full < there else 0
            for sequences, n, start in ((full, each, first), (1 if over else 0, over, first + full)):
                if sequences:
                    placements.append(Placement(length, rank, sequences * n, start, n, capacity - free))
                    rank, left = rank + sequences * n, left - sequences * n
                    if free > n * length:
                        insort(gaps, (free - n * length, start, sequences))
            used = full + (1 if over else 0)
            if used < there:
                insort(gaps, (free, first + used, there - used))
    return placements


def pack(pieces: DataFrame, capacity: int, length: str = "length", key: Column | None = None, ties: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces of at most `capacity` tokens; the other columns come along.

    The result depends on the rows only: equal lengths are ranked by the md5 of `key`, then by `ties`. Pieces without
    tokens or without a length take no space and get no sequence (both columns null); a piece longer than `capacity`
    is an error. An empty input gives no rows. Columns named `sequence_id` or `offset` are replaced.
    """
    key = F.col("doc_id") if key is None else key
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialize(pieces.select(*kept), "pieces")
    counts = {r[0]: r[1] for r in pieces.where(F.col(length) > 0).groupBy(length).agg(F.count("*")).collect()}
    if any(c > capacity for c in counts):
        raise ValueError(f"a piece is longer than {capacity}")
    placed = best_fit(counts, capacity)
    runs = pieces.sparkSession.createDataFrame(placed or [Placement(0, 0, 0, 0, 1, 0)], "_length long, _first long, _pieces long, _sequence long, _each long, _offset long")
    ranked = spread_rank(pieces, [length], key, list(ties), sum(counts.values()), "_rank")
    place = F.col("_rank") - F.col("_first")
    on = (F.col(length) == F.col("_length")) & (place >= 0) & (place < F.col("_pieces"))
    # The runs are bounded by the capacity, not by the corpus.
    return ranked.join(F.broadcast(runs), on, "left").select(
        *kept,
        (F.col("_sequence") + F.floor(place / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + place % F.col("_each") * F.col(length)).cast("long").alias("offset"),
    )


def pack_runs(pieces: DataFrame, capacity: int, run: str, order: tuple[str, ...]) -> DataFrame:
    """Pack the pieces of each run by themselves; sequences are numbered run after run, from 0 without gaps.

    Within a run the steps are those of `pack`: the lengths are counted, the supersteps sweep over the counts, each run's in
    a task that sees no piece, pieces of equal length are ranked in `order`, and the rank says which piece gets which gap.
    A run's sequences are numbered in the order of their first piece; `order` tells the pieces of a run apart. `run` is a
    whole number from 0. A piece without tokens, or longer than `capacity`, is an error. An empty input gives no rows. Adds
    `sequence_id` and `offset`; the other columns come along.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialize(pieces.select(*kept), "pieces")
    counts = pieces.groupBy(F.col(run).cast("long").alias("_run"), F.col("length").cast("long").alias("_length")).agg(F.count("*").alias("_n"))

    def sweep(lengths: pa.Table) -> pa.Table:
        by = dict(zip(lengths.column("_length").to_pylist(), lengths.column("_n").to_pylist(), strict=True))
        if min(by) < 1 or max(by) > capacity:
            raise ValueError(f"a piece without tokens or longer than {capacity}")
        placed = best_fit(by, capacity)
        made = [pa.array([lengths.column("_run")[0].as_py()] * len(placed), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*placed, strict=True))]
        return pa.Table.from_arrays(made, ["_run", "_length", "_first", "_pieces", "_sequence", "_each", "_offset"])

    placements = counts.groupBy("_run").applyInArrow(sweep, "_run long, _length long, _first long, _pieces long, _sequence long, _each long, _offset long")
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy(run, "length").orderBy(*order)) - 1)
    place = F.col("_rank") - F.col("_first")
    on = (F.col(run) == F.col("_run")) & (F.col("length") == F.col("_length")) & (place >= 0) & (place < F.col("_pieces"))
    local = ranked.join(placements, on).select(
        *kept, (F.col("_sequence") + F.floor(place / F.col("_each"))).alias("_local"),
        (F.col("_offset") + place % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
    local = materialize(local, "runs")
    # The sequences of a run by their first piece.
    opened = local.groupBy(F.col(run).alias("_run"), F.col("_local").alias("_as")).agg(F.min(F.struct(*order)).alias("_at"))
    opened = opened.select("_run", "_as", (F.row_number().over(Window.partitionBy("_run").orderBy("_at")) - 1).cast("long").alias("_number"))
    # Sums over lots of runs first, so that no task goes through all runs.
    used = opened.groupBy("_run").agg(F.count("*").alias("_used")).withColumn("_lot", F.expr(f"_run div {LOT_RUNS}"))
    lots = used.groupBy(F.col("_lot").alias("_of")).agg(F.sum("_used").alias("_all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("_of", F.coalesce(F.sum("_all").over(before(Window.orderBy("_of"))), F.lit(0)).alias("_from"))
    within = F.coalesce(F.sum("_used").over(before(Window.partitionBy("_lot").orderBy("_run"))), F.lit(0))
    starts = used.withColumn("_in", within).join(lots, F.col("_lot") == F.col("_of")).select(F.col("_run").alias("_in_run"), (F.col("_from") + F.col("_in")).alias("_start"))
    numbered = opened.join(starts, F.col("_run") == F.col("_in_run")).select("_run", "_as", (F.col("_start") + F.col("_number")).alias("sequence_id"))
    return local.join(numbered, (F.col(run) == F.col("_run")) & (F.col("_local") == F.col("_as"))).select(*kept, "sequence_id", "offset")
