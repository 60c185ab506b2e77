"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a task ranks at once, on average.
RANK_ROWS = 20_000


def spread_rank(df: DataFrame, groups: list[str], key: Column, ties: list[str], rows: int, name: str) -> DataFrame:
    """Add `name`: the rank from 0 of each row within its group, in the order of md5(key), then of `ties`.

    The first hex digits of the md5 deal a group out to many tasks; each ranks its share, and a running sum over the
    shares' counts gives where the share starts. The number of digits follows `rows`, the number of rows of `df`; it
    changes the tasks, never the ranks. `df` is read twice. Rows equal in key and ties are ranked in any order.
    Columns of `df` must not be named `_md5`, `_share` or `_row`.
    """
    digits, shares = 1, max(1, rows // RANK_ROWS)
    while 16**digits < shares:
        digits += 1
    keyed = df.withColumn("_md5", F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))).withColumn(
        "_share", F.substring("_md5", 1, digits)
    )
    return rank_by_share(keyed, groups, "_share", ["_md5", *ties], name).select(*df.columns, name)


def rank_by_share(df: DataFrame, groups: list[str], share: str, order: list[str], name: str) -> DataFrame:
    """Add `name`: the rank from 0 of each row within its group, in the order of `share`, then of `order`.

    A task ranks one share of one group; shares must be of bounded size. `df` is read twice. No column may be named `_row`.
    """
    counts = df.groupBy(*groups, share).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(share).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, share, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*groups, share).orderBy(*order)
    ranked = df.withColumn("_row", F.row_number().over(within))
    same = [ranked[c].eqNullSafe(starts[c]) for c in [*groups, share]]
    on = same[0]
    for one in same[1:]:
        on = on & one
    return ranked.join(starts, on).select(*[ranked[c] for c in df.columns], (F.col("_start") + F.col("_row") - 1).alias(name))
