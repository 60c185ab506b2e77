"""First, last, top-k and rank within groups, built so that no group has to fit one task.

First and last are aggregates, combined before the shuffle. Top-k is a limited window, cut before
the shuffle. A full rank uses a plain window for groups of ordinary size; groups that hold too
large a share of the rows are sorted over many tasks instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import materialize

# A group is hot when it has over HOT_FLOOR rows and holds over 1/HOT_SHARE of all, so fewer than HOT_SHARE are.
HOT_FLOOR = 500_000
HOT_SHARE = 5000
# Buckets that groups are counted in to tell whether one may be hot: several times HOT_SHARE.
BUCKETS = 16_384
PAGE_SIZE = 1000


def _order_key(order) -> Column:
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def _pick(df: DataFrame, keys, order, choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), _order_key(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the last in the given order."""
    return _pick(df, list(keys), order, F.max_by)


def first_match(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in the given order."""
    return _pick(df, list(keys), order, F.min_by)


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group with their 1-based rank."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def latest(df: DataFrame, order: str, n: int, tie: str | None = None) -> DataFrame:
    """The n rows with the highest order value."""
    ties = [F.asc(tie)] if tie else []
    return df.orderBy(F.desc(order), *ties).limit(n)


def _on_keys(keys, prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return condition


def _prefixed(df: DataFrame, keys, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


class Load(NamedTuple):
    rows: int
    hot: bool  # whether a group may be hot; if not, none is


def load(df: DataFrame, keys=None, floor: int = HOT_FLOOR, share: int = HOT_SHARE) -> Load:
    """Rows of a frame, and whether a group on `keys` (all its columns, if not given) may be hot.

    Groups are counted by buckets of their hash, so no list of groups is shuffled, however many there are.
    """
    bucket = F.pmod(F.xxhash64(*(keys or df.columns)), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    return Load(total or 0, bool(total) and largest > max(floor, total // share))


def hot_groups(df: DataFrame, keys, floor: int = HOT_FLOOR, share: int = HOT_SHARE) -> DataFrame | None:
    """Groups with over `floor` rows and over 1/share of all rows, with their size; None if there are none.

    At most `share` groups qualify, so the result is small whatever the size of the data.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    total, largest = sizes.agg(F.sum("_size"), F.max("_size")).first()
    limit = max(floor, (total or 0) // share)
    if not total or largest <= limit:
        return None
    hot = sizes.filter(F.col("_size") > limit)
    return df.sparkSession.createDataFrame(hot.limit(share).collect(), hot.schema)


def rank_in_group(
    df: DataFrame, keys, order, rank: str = "rank", floor: int = HOT_FLOOR, share: int = HOT_SHARE, sizes: DataFrame | Load | None = None,
    kept: list[str] | None = None,
) -> DataFrame:
    """1-based position of every row of every group, whatever the group's size.

    `order` must be ascending and make rows of a group distinct. `sizes` may name a cheaper frame
    whose groups on the keys it shares are at least as large, or its `load`; when none of those is hot, `df` itself is not
    counted. `kept` are the columns that come along, all if not given.
    """
    keys = list(keys)
    rows, hot = _in_order(df, keys, order, kept or df.columns, floor, share, sizes)
    plain = F.row_number().over(W.partitionBy(*keys).orderBy("_order")).cast("bigint")
    if hot is None:
        return rows.withColumn(rank, plain).select(*(kept or df.columns), rank)
    condition = _on_keys(keys, "_hot_")
    hot_keys = F.broadcast(_prefixed(hot.select(*keys), keys, "_hot_"))
    cold_rows = rows.join(hot_keys, condition, "left_anti").withColumn(rank, plain)
    ranked = _sorted_rank(rows.join(hot_keys, condition, "left_semi"), keys, rank)
    return cold_rows.select(*(kept or df.columns), rank).unionByName(ranked.select(*(kept or df.columns), rank))


def running_sum(
    df: DataFrame, keys, order, value: str, out: str = "running", floor: int = HOT_FLOOR, share: int = HOT_SHARE,
    sizes: DataFrame | Load | None = None, kept: list[str] | None = None,
) -> DataFrame:
    """The sum of `value` over the rows of the group up to and including each row, whatever the group's size.

    `order`, `sizes` and `kept` are as for `rank_in_group`; values are whole numbers that are never null.
    """
    keys, kept = list(keys), kept or df.columns
    rows, hot = _in_order(df, keys, order, list(dict.fromkeys([*kept, value])), floor, share, sizes)
    plain = F.sum(value).over(W.partitionBy(*keys).orderBy("_order").rowsBetween(W.unboundedPreceding, 0))
    if hot is None:
        return rows.withColumn(out, plain).select(*kept, out)
    condition = _on_keys(keys, "_hot_")
    hot_keys = F.broadcast(_prefixed(hot.select(*keys), keys, "_hot_"))
    cold_rows = rows.join(hot_keys, condition, "left_anti").withColumn(out, plain)
    return cold_rows.select(*kept, out).unionByName(_sorted_sum(rows.join(hot_keys, condition, "left_semi"), keys, value, out).select(*kept, out))


def _in_order(df: DataFrame, keys, order, kept, floor: int, share: int, sizes) -> tuple[DataFrame, DataFrame | None]:
    """The rows' `kept` columns and keys with `_order`, and the hot groups, or None.

    Where no group can be hot `_order` is the given order. Else all rows are sorted at once and written with their place in
    the sort, which then is the order: what made it need not be written, and a lost task cannot shift the rows.
    """
    rows = df.select(*dict.fromkeys([*keys, *kept]), _order_key(order).alias("_order"))
    if sizes is None:
        rows = materialize(rows, "rows")
        sizes = rows.select(*keys)
    found = sizes if isinstance(sizes, Load) else load(sizes, None, floor, share)
    if not found.hot:
        return rows, None
    placed = _sorted(rows, keys, -(-2 * found.rows // max(floor, found.rows // share)))
    return placed, hot_groups(placed, keys, floor, share)


def _sorted(df: DataFrame, keys, tasks: int) -> DataFrame:
    """Rows with their place in one distributed sort by keys and `_order`, which it replaces, and the task they were sorted by."""
    # The id counts on within a task and holds the task's number, tasks being in sort order, above that.
    return materialize(
        df.repartitionByRange(tasks, *keys, "_order")
        .sortWithinPartitions(*keys, "_order")
        .withColumn("_order", F.monotonically_increasing_id()),
        "sorted",
    ).withColumn("_task", F.shiftright("_order", 33))


def _spans(placed: DataFrame, keys, amount: Column) -> DataFrame:
    """Of every group's share of a task: its first place, and the `amount` that the tasks before hold of the group.

    One row per task and hot group in it: at most the number of tasks plus that of hot groups.
    """
    spans = placed.groupBy(*keys, "_task").agg(F.min("_order").alias("_first"), amount.alias("_n"))
    before = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    on = [*keys, "_task"]
    return F.broadcast(_prefixed(spans.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), on, "_s_"))


def _sorted_rank(placed: DataFrame, keys, rank: str) -> DataFrame:
    """Rank by one distributed sort: the place in the sort order, less the place where the group begins."""
    joined = placed.join(_spans(placed, keys, F.count("*")), _on_keys([*keys, "_task"], "_s_"))
    return joined.withColumn(rank, F.col("_offset") + F.col("_order") - F.col("_first") + 1)


def _sorted_sum(placed: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Prefix sums by one distributed sort: within each task's share of a group, plus what the tasks before hold."""
    joined = placed.join(_spans(placed, keys, F.sum(value)), _on_keys([*keys, "_task"], "_s_"))
    within = W.partitionBy(*keys, "_task").orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_offset") + F.sum(value).over(within))


def ordered_list(value, rank: str = "rank") -> Column:
    """Aggregate: the group's values as an array in rank order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), (F.col(value) if isinstance(value, str) else value).alias("v"))))
    return F.transform(pairs, lambda p: p.v)


def ordered_pages(
    df: DataFrame, keys, order, value, page_size: int = PAGE_SIZE, out: str = "items", sizes: DataFrame | Load | None = None,
    floor: int = HOT_FLOOR, share: int = HOT_SHARE,
) -> DataFrame:
    """The ordered values of every group as arrays of at most `page_size`; page 0 first.

    A group of ordinary size has page 0 only. Larger groups go on over further pages, so the list
    stays whole without any row or task having to hold it all.
    """
    keys = list(keys)
    # Of the rows only the values go on.
    valued = df.withColumn("_value", F.col(value) if isinstance(value, str) else value)
    ranked = rank_in_group(valued, keys, order, "_rank", floor, share, sizes, [*keys, "_value"])
    page = F.floor((F.col("_rank") - 1) / page_size).cast("int")
    return ranked.withColumn("page", page).groupBy(*keys, "page").agg(ordered_list("_value", "_rank").alias(out))
