"""URL filters by listed hosts and path prefixes: a blocked Bloom filter before an exact join.

A listed entry is a canonical URL, `host/path`. It fits a URL whose host is the entry's or a subdomain of it and whose
path starts with the entry's path. So the entries that may fit a URL are its host's suffixes, from label to label, each
with the prefixes of its path of the lengths that the list has. These candidates are looked up in a blocked Bloom
filter: one block of four 64-bit words a candidate, one bit in each word. What passes goes to an exact hash join with
the list, which removes the false positives. The filter's size follows the number of entries; up to FILTER_BLOCKS
blocks it is broadcast, beyond that candidates and blocks are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialize

#: Entries a block holds on average: 16 bits each.
BLOCK_ENTRIES = 16
#: Blocks of 32 bytes that may be broadcast: 8 MB.
FILTER_BLOCKS = 1 << 18
#: Entries that may be broadcast to the exact join.
BROADCAST_ENTRIES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.

    Both are empty for null and for a URL without `://`.
    """
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, UPPER, LOWER), path


def _block(entry: str, blocks: int) -> str:
    return f"cast(pmod(xxhash64({entry}), {blocks}) as int)"


def _bit(entry: str, word: int) -> str:
    """The bit of an entry in a word of its block: six bits of a second hash."""
    return f"shiftleft(1L, cast(shiftright(xxhash64({entry}, 'bits'), {6 * word}) & 63 as int))"


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of the column `entry`: one row per block that has a bit."""
    bits = [F.bit_or(F.expr(_bit("entry", w))).alias(f"_w{w}") for w in range(4)]
    return listed.groupBy(F.expr(_block("entry", blocks)).alias("_block")).agg(*bits)


def may_be_listed(df: DataFrame, column: str, listed: DataFrame, out: str) -> DataFrame:
    """Add `out`: whether the filter may hold the value of a column that is never null; false for sure where it is not listed.

    The filter has FILTER_BLOCKS blocks at most and is broadcast: with more entries than those are made for more rows pass.
    """
    blocks = max(1, min(FILTER_BLOCKS, -(-listed.count() // BLOCK_ENTRIES)))
    hit = F.expr(f"_block = {_block(column, blocks)}")
    for word in range(4):
        hit = hit & F.expr(f"(_w{word} & {_bit(column, word)}) != 0")
    bloom = materialize(bloom_blocks(listed, blocks), "filter")
    return df.join(F.broadcast(bloom), hit, "left").select(*[df[c] for c in df.columns], F.col("_block").isNotNull().alias(out))


def candidates(sites: DataFrame, lengths: list[int], labels: int) -> DataFrame:
    """All entries that may fit each (host, path), for lists whose paths have these lengths and whose hosts at most so many labels.

    So a host has at most `labels` suffixes, however many labels it has itself.
    """
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("path"))
    hosts = sites.where("host != ''").withColumn("_suffix", F.explode(suffixes))
    return hosts.withColumn("_size", F.explode(sizes)).select("host", "path", F.expr("concat(_suffix, substr(path, 1, _size))").alias("_candidate"))


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Judge every row: the id, host, path, entry, kind and verdict.

    `listed` has entry (`host/path`, the host in lower case), kind and verdict. Of the entries that fit, those of the
    smallest kind count first and the longest of them wins; an entry listed twice counts with its smallest verdict. A
    URL that none fits has null entry and kind and the default verdict, and so have null, empty and malformed URLs and
    an empty list. Repeated rows are judged alike, each on its own; null ids are kept. Other columns are not read.
    """
    listed = listed.where("entry is not null and instr(entry, '/') > 1").groupBy("entry").agg(F.min(F.struct("kind", "verdict")).alias("_v"))
    listed = materialize(listed.select("entry", "_v.kind", "_v.verdict"), "listed")
    n = listed.count()
    # One row per length that paths of the list have.
    shapes = listed.select(F.expr("char_length(entry) - instr(entry, '/') + 1").alias("n"), F.size(F.split(F.substring_index("entry", "/", 1), r"\.", -1)).alias("labels"))
    found = shapes.groupBy("n").agg(F.max("labels")).collect()
    lengths, labels = [r[0] for r in found], max((r[1] for r in found), default=1)
    host, path = host_and_path(F.col(url_column))
    judged = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    sites = judged.select("host", "path").distinct()
    blocks = max(1, -(-n // BLOCK_ENTRIES))
    bloom = bloom_blocks(listed, blocks)
    if blocks <= FILTER_BLOCKS:
        bloom = F.broadcast(bloom)
    tried = candidates(sites, sorted(lengths) or [1], labels)
    hit = F.expr(f"_block = {_block('_candidate', blocks)}")
    for word in range(4):
        hit = hit & F.expr(f"(_w{word} & {_bit('_candidate', word)}) != 0")
    possible = tried.join(bloom, hit, "left_semi")
    exact = possible.join(F.broadcast(listed) if n <= BROADCAST_ENTRIES else listed, F.col("_candidate") == F.col("entry"))
    best = F.max_by(F.struct("entry", "kind", "verdict"), F.struct((-F.col("kind")).alias("k"), F.char_length("entry").alias("n"), F.col("entry").alias("e")))
    fits = exact.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(best.alias("_fit"))
    # Written, so that both sides of the join are shuffled for it and a hot URL's rows can be split.
    fits = materialize(fits, "fits")
    on = (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    return judged.join(fits, on, "left").select(
        "page_id", "host", "path", F.col("_fit.entry").alias("entry"), F.col("_fit.kind").alias("kind"),
        F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"),
    )
