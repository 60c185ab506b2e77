"""A blocked Bloom filter of column keys: rows that miss it are new for sure and skip the exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.intake import COLUMN_KEY, one_per_key
from fieldloom.session import materialize

#: Bits a key has in the filter, words of 64 bits a block has, and bits set per key: two in each word.
KEY_BITS, WORDS, BITS_PER_WORD = 16, 4, 2
#: Blocks a filter has at most: 64 MB where it is sent to every task. With more keys than it is made for it lets more through.
MOST_BLOCKS = 1 << 20
#: Under so many bits a key the filter would let most rows through and is left out; the rows are the same.
LEAST_KEY_BITS = 4


def _placed(df: DataFrame, blocks: int) -> DataFrame:
    """The keys with their block and, per word, the bits they set there."""
    keys = [F.col(c).cast("string") for c in COLUMN_KEY]
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in COLUMN_KEY])
    bits = F.xxhash64(F.lit(1), *keys, nulls)
    one = F.lit(1).cast("long")

    def word(n: int) -> Column:
        places = [F.shiftrightunsigned(bits, 6 * (BITS_PER_WORD * n + i)).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_PER_WORD)]
        made = F.call_function("shiftleft", one, places[0])
        for place in places[1:]:
            made = made.bitwiseOR(F.call_function("shiftleft", one, place))
        return made

    block = F.pmod(F.xxhash64(F.lit(2), *keys, nulls), F.lit(blocks))
    return df.select("*", block.alias("_block"), *[word(n).alias(f"_w{n}") for n in range(WORDS)])


def _filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, words): the blocks that hold any key; combined before the shuffle, so copies cost nothing."""
    set_ = _placed(keys.select(*COLUMN_KEY), blocks).groupBy(F.col("_block").alias("_b")).agg(*[F.bit_or(f"_w{n}").alias(f"_f{n}") for n in range(WORDS)])
    return materialize(set_, "key-filter")


def _blocks(keys: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-keys * KEY_BITS // (64 * WORDS))))


def _hits(df: DataFrame, found: DataFrame, blocks: int, out: str) -> DataFrame:
    """Whether the filter may hold each row's key."""
    there = F.col("_f0").isNotNull()
    for n in range(WORDS):
        there = there & (F.col(f"_f{n}").bitwiseAND(F.col(f"_w{n}")) == F.col(f"_w{n}"))
    joined = _placed(df, blocks).join(F.broadcast(found), F.col("_block") == F.col("_b"), "left")
    return joined.select(*df.columns, F.coalesce(there, F.lit(False)).alias(out))


def split_by_filter(discovered: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that are new for sure, rows that may be known, known keys that one of those may bear).

    The first are most of a new system's columns and never reach a join with the registry; of a huge registry only the keys
    that pass a filter of the remaining rows do.
    """
    n_known = known.count()
    blocks = _blocks(n_known)
    once = one_per_key(discovered)
    # Values of two types may be equal in a join and yet differ in their texts, which the filter takes.
    alike = all(discovered.schema[c].dataType == known.schema[c].dataType for c in COLUMN_KEY)
    if not alike or not n_known or blocks * 64 * WORDS < LEAST_KEY_BITS * n_known:
        return once.limit(0), once, known.select(*COLUMN_KEY)
    marked = materialize(_hits(once, _filter(known, blocks), blocks, "_may"), "marked-columns")
    new, open_rows = marked.where("not _may").drop("_may"), marked.where("_may").drop("_may")
    n_open = open_rows.count()
    blocks = _blocks(n_open)
    keys = known.select(*COLUMN_KEY)
    if not n_open or blocks * 64 * WORDS < LEAST_KEY_BITS * n_open:
        return new, open_rows, keys
    return new, open_rows, _hits(keys, _filter(open_rows, blocks), blocks, "_may").where("_may").drop("_may")


def new_columns_filtered(discovered: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of `intake.new_columns`, with the exact join held to the rows that the filters let through."""
    new, open_rows, keys = split_by_filter(discovered, known)
    condition = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in COLUMN_KEY]
    exact = open_rows.alias("n").join(keys.alias("k"), condition, "left_anti")
    return new.unionByName(exact).select(*discovered.columns)
