"""Source tables under their canonical column names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.display import leaf_name
from fieldloom.functions.text import text
from fieldloom.operators.coverage import with_label
from fieldloom.operators.ordering import PAGE_SIZE, ordered_pages, top_k
from fieldloom.operators.retrieval import links, mapping_order, one_per_field
from fieldloom.session import materialize

# Tables are conformed in batches of so many renames, or one by one where a table has more: what is read of the plan at once.
BATCH_RENAMES = 50_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Conformed:
    source_table: str
    frame: DataFrame | None = None
    renames: tuple[tuple[str, str], ...] = ()
    error: str | None = None


def _table_links(approved: DataFrame, source: DataFrame) -> DataFrame:
    order = [c for c in ("approved_at", "mapping_id") if c in approved.columns]
    return links(approved, source, order).filter(text("source_table") != "")


def _owner() -> Column:
    """The platform of a table's first mapping."""
    return F.min_by("platform_id", F.struct("_newest", "mapping_id")).alias("platform_id")


def _dated(linked: DataFrame, approved: DataFrame) -> DataFrame:
    return linked.withColumn("_newest", F.lit(0) if len(mapping_order(approved)) == 1 else mapping_order(approved)[0])


def conform_plan(
    approved: DataFrame, source: DataFrame, fields: DataFrame, platforms: DataFrame, shown: int = 3
) -> DataFrame:
    """Per source table its platform, mapped columns, and the first renames; an unknown field shows as `?`."""
    linked = _table_links(approved, source)
    order = mapping_order(approved)
    counts = _dated(linked, approved).groupBy("source_table").agg(F.count("*").alias("mapped_columns"), _owner())
    first = top_k(linked, ["source_table"], order, shown, "_r").join(one_per_field(fields), "canonical_id", "left")
    pair = F.concat(text("column_name"), F.lit(" -> "), F.coalesce("canonical_name", F.lit("?")))
    renames = first.groupBy("source_table").agg(F.sort_array(F.collect_list(F.struct("_r", pair.alias("t")))).alias("_p"))
    renames = renames.select("source_table", F.array_join(F.transform("_p", lambda p: p.t), ", ").alias("_text"))
    rows = with_label(counts.join(renames, "source_table"), platforms)
    return rows.select(
        "source_table", leaf_name("source_table").alias("table"), "platform", "mapped_columns",
        F.concat("_text", F.when(F.col("mapped_columns") > shown, "...").otherwise("")).alias("column_renames"),
    )


def _named(linked: DataFrame, fields: DataFrame) -> DataFrame:
    named = one_per_field(fields).filter(text("canonical_name") != "")
    return linked.filter(text("column_name") != "").join(named, "canonical_id")


def rename_pairs(approved: DataFrame, source: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per mapping that renames a column of a table; of a repeated field id the last name counts."""
    return _named(_table_links(approved, source), fields)


def rename_text(
    approved: DataFrame, source: DataFrame, fields: DataFrame, gold: str = "gold", page_size: int = PAGE_SIZE
) -> DataFrame:
    """The statement each table's view would have, in consecutive parts of at most `page_size` renames.

    Preview only: publishing selects columns and runs no such text.
    """
    linked = _dated(_table_links(approved, source), approved)
    linked = materialize(linked.select("canonical_id", "mapping_id", "_newest", "platform_id", "source_table", "column_name"), "links")
    pairs = _named(linked, fields)
    item = F.concat(F.lit("    `"), "column_name", F.lit("` AS `"), "canonical_name", F.lit("`"))
    pages = ordered_pages(pairs, ["source_table"], ["_newest", "mapping_id"], item, page_size, "items", sizes=linked.select("source_table"))
    ends = pages.groupBy("source_table").agg(F.max("page").alias("last"))
    owner = linked.groupBy("source_table").agg(_owner())
    view = F.concat(F.lit(f"{gold}."), F.col("platform_id").cast("string"), F.lit("__"), leaf_name("source_table"))
    head = F.concat(F.lit("CREATE OR REPLACE VIEW "), view, F.lit(" AS\nSELECT\n"))
    tail = F.concat(F.lit("\nFROM "), "source_table")
    body = F.array_join("items", ",\n")
    return (
        pages.join(ends, "source_table").join(owner, "source_table")
        .select(
            "source_table", "page",
            F.concat(
                F.when(F.col("page") == 0, head).otherwise(""), body,
                F.when(F.col("page") == F.col("last"), tail).otherwise(",\n"),
            ).alias("text"),
        )
    )


def rename_plan(pairs: DataFrame) -> DataFrame:
    """(source_table, column_name, canonical_name, mappings, columns, first_column): every rename of every table once.

    `columns` tells how many columns of the table are to bear the name, `first_column` the least of them: over one is a
    clash, which cannot be published. Both are counted over renames, not mappings, and no table's plan is gathered.
    """
    renames = pairs.groupBy("source_table", "column_name", "canonical_name").agg(F.count("*").alias("mappings"))
    named = renames.groupBy("source_table", "canonical_name").agg(F.count("*").alias("columns"), F.min("column_name").alias("first_column"))
    return renames.join(named, ["source_table", "canonical_name"]).select("source_table", "column_name", "canonical_name", "mappings", "columns", "first_column")


def _known_renames(pairs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The distinct renames of columns that the given tables have, with the place of the column in its table."""
    rows = [(t, c, i) for t, df in tables.items() for i, c in enumerate(df.columns)]
    known = pairs.sparkSession.createDataFrame(rows, "source_table string, column_name string, _i int")
    return pairs.select("source_table", "column_name", "canonical_name").distinct().join(known, ["source_table", "column_name"])


def _clashes(renames: DataFrame) -> dict[str, str]:
    """The first clash of every table that has one, found by Spark; one row a table is read."""
    two = top_k(renames, ["source_table", "canonical_name"], ["_i"], 2, "_r")
    both = two.groupBy("source_table", "canonical_name").agg(F.count("*").alias("_n"), F.min(F.struct("_i", "column_name")).alias("a"), F.max(F.struct("_i", "column_name")).alias("b"))
    first = both.filter("_n > 1").groupBy("source_table").agg(F.min(F.struct("b._i", "canonical_name", F.col("a.column_name").alias("a"), F.col("b.column_name").alias("b"))).alias("c"))
    return {r.source_table: f"{r.source_table}: {r.c.a} and {r.c.b} both map to {r.c.canonical_name}" for r in first.collect()}


def _batched(counts: dict[str, int], size: int) -> Iterator[list[str]]:
    """Tables in their order, together at most `size` renames, or one table."""
    held, total = [], 0
    for table, n in counts.items():
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(table)
        total += n
    if held:
        yield held


def conform_each(tables: dict[str, DataFrame], pairs: DataFrame, batch: int = BATCH_RENAMES) -> Iterator[Conformed]:
    """Conform tables that have mapped columns, batch by batch, so that a publisher need not hold the plan of them all.

    Clashes are found before anything of the plan is read; a table that has one is an error of its own and does not stop the
    others. A table's renames are as many as the columns of its view, which the driver has to name in any case.
    """
    renames = materialize(_known_renames(pairs, tables), "renames")
    clashes = _clashes(renames)
    sizes = {r[0]: r[1] for r in renames.groupBy("source_table").count().collect()}
    counts = {t: 0 if t in clashes else sizes[t] for t in tables if t in sizes}
    for names in _batched(counts, batch):
        found: dict[str, list] = {t: [] for t in names}
        for r in renames.filter(F.col("source_table").isin([t for t in names if t not in clashes])).collect():
            found[r.source_table].append((r["_i"], r.canonical_name, r.column_name))
        for table in names:
            if table in clashes:
                yield Conformed(table, error=clashes[table])
                continue
            listed = tuple((column, name) for _, name, column in sorted(found[table]))
            yield Conformed(table, tables[table].select(*[F.col(quoted(c)).alias(n) for c, n in listed]), listed)


def conform(df: DataFrame, source_table: str, pairs: DataFrame) -> DataFrame | None:
    """The mapped columns of one table under their canonical names; None when none is mapped."""
    for done in conform_each({source_table: df}, pairs):
        if done.error:
            raise ValueError(done.error)
        return done.frame
    return None


def conform_all(tables: dict[str, DataFrame], pairs: DataFrame, batch: int = BATCH_RENAMES) -> list[Conformed]:
    """Conform every table that has mapped columns; a table that fails does not stop the others."""
    return list(conform_each(tables, pairs, batch))
