"""BM25 (Okapi, k1 1.5, b 0.75, epsilon 0.25) as a relational index with an exact pruned top-k.

The index keeps every distinct bag of tokens once, with the documents that share it on the side, so
copies are scored once. A search never pairs every query with every document of a common term: a
lower bound on the k-th best score of each query comes from its strongest terms first, and common
terms whose best possible contribution cannot reach that bound are added only to documents that
other terms brought up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.text import tokenize
from fieldloom.operators.ordering import top_k
from fieldloom.session import drop_written, materialize, recorded

K1 = 1.5
B = 0.75
EPSILON = 0.25

# Postings of one term, and queries holding it, that one task joins; more are split over several.
POSTINGS_PER_TASK = 200_000
QUERIES_PER_TASK = 2_000
# Terms whose parts are sent to every task; more are joined.
SPLIT_TERMS = 100_000
# Query terms up to this many rows are sent to every task; the postings are then spread by document.
BROADCAST_ROWS = 200_000
READS_PER_TASK = 2_000_000
# Bags up to this many are sent to every task to find their members.
FEW_BAGS = 20_000
# Terms per query that seed the lower bound.
SEED_TERMS = 3
# Posting reads up to which a search scores outright, without bounds; never less than twice the index.
DIRECT_READS = 20_000_000
# Slack for sums taken in another order.
SLACK = 1e-7
# Documents to a pair of texts, on average, from which on pairs are gathered to bags; with fewer every document is a bag.
GATHER_COPIES = 4


@dataclass(frozen=True)
class Index:
    members: DataFrame  # bag, doc_id: the documents sharing a bag of tokens; a bag is named by its first document
    postings: DataFrame  # bag, term, impact: the term's share of its highest possible weight there
    terms: DataFrame  # term, bags, idf, peak
    written: tuple[str, ...] = ()  # the folders of the frames above
    documents: DataFrame | None = None  # doc_id and what names its bag in `bags`, where `members` is the join of the two
    bags: DataFrame | None = None  # bag and what names it
    pairs: Pairs | None = None  # of documents of two texts, whose postings are not written

    def members_of(self, wanted: DataFrame, few_bags: int = FEW_BAGS) -> DataFrame:
        """The members of the wanted bags, of which each comes once; few of them are looked up without moving the documents."""
        if self.pairs and not self.pairs.gathered:
            return wanted.select("bag", "bag.*")
        few = F.broadcast if wanted.count() <= few_bags else lambda df: df
        if self.pairs:
            return self.pairs.members(self.documents, few(wanted))
        if self.bags is None:
            return self.members.join(few(wanted), "bag", "left_semi")
        return _members(self.documents, few(self.bags.join(few(wanted), "bag", "left_semi")))

    def drop(self) -> None:
        """Remove the written index; neither it nor results of its searches can be read afterwards."""
        drop_written(self.terms.sparkSession, self.written)


@dataclass(frozen=True)
class Pairs:
    """Bags of documents of two texts, and the terms of either text: what a bag's postings follow from.

    A bag is a struct that begins with the id of its first document. It goes on with the ids of both texts where every document is
    a bag of its own, with the keys of both parts where the documents of a pair of parts are gathered.
    """

    bags: DataFrame  # bag, copies, first, second, length
    first: DataFrame  # first, term, tf
    second: DataFrame  # second, term, tf
    average: float  # length
    gathered: bool
    ids: tuple[str, str]  # the documents' columns that name the texts
    shared: DataFrame | None  # term: those in a first and in a second text, be it of different documents; None without any

    def sides(self) -> list[tuple[str, DataFrame]]:
        return [("first", self.first), ("second", self.second)]

    def members(self, documents: DataFrame, bags: DataFrame) -> DataFrame:
        """(bag, doc_id, ids): the documents of bags that are gathered."""
        named = documents.select("doc_id", *self.ids, F.col("first.key").alias("first"), F.col("second.key").alias("second"))
        return _members(named, bags.select("bag", "bag.first", "bag.second"), *self.ids)

    def postings(self, wanted: DataFrame | None = None) -> DataFrame:
        """(bag, term, impact), of the wanted terms if given; a term of both texts is one posting."""
        some = lambda terms: terms if wanted is None else terms.join(wanted, "term", "left_semi")
        rows = [self.bags.join(some(terms), part).select("bag", "length", "term", "tf") for part, terms in self.sides()]
        rows = rows[0].unionByName(rows[1])
        if self.shared is not None:
            rows = rows.groupBy("bag", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
        return rows.select("bag", "term", _impact("tf", "length", self.average).alias("impact"))

    def terms(self, n_docs: int) -> DataFrame:
        """The weighted terms. A peak is that of a term's highest frequency in its shortest document."""
        rows, none = [], F.lit(None).cast("int")
        for part, terms in self.sides():
            counts = self.bags.groupBy(part).agg(F.sum("copies").alias("documents"), F.count("*").alias("bags"), F.min("length").alias("shortest"))
            tf = [F.when(F.lit(part == p), F.col("tf")).alias(f"{p}_tf") for p, _ in self.sides()]
            rows.append(terms.join(counts, part).select("term", "documents", "bags", "shortest", *tf))
        if self.shared is not None:
            # Bags with a term in both texts were counted twice.
            left, right = (terms.join(self.shared, "term", "left_semi").select(part, "term") for part, terms in self.sides())
            held = self.bags.join(left, "first").groupBy("second", "term").agg(F.sum("copies").alias("documents"), F.count("*").alias("bags"))
            rows.append(held.join(right, ["second", "term"]).select(
                "term", (-F.col("documents")).alias("documents"), (-F.col("bags")).alias("bags"), none.alias("shortest"),
                none.cast("long").alias("first_tf"), none.cast("long").alias("second_tf")))
        most = F.coalesce(F.max("first_tf"), F.lit(0)) + F.coalesce(F.max("second_tf"), F.lit(0))
        found = reduce(DataFrame.unionByName, rows).groupBy("term").agg(
            F.sum("documents").alias("documents"), F.sum("bags").alias("bags"), most.alias("most"), F.min("shortest").alias("shortest")
        )
        return weighted_terms(found.select("term", "documents", "bags", _impact("most", "shortest", self.average).alias("peak")), n_docs)

    def score_by_one_part(self, queries: DataFrame) -> DataFrame | None:
        """(query, bag, score) where the terms of all queries are in first texts only, or in second texts only; else None.

        `queries` has (query, term, weight). A part's query terms are gathered first, so that a bag is scored within its row.
        """
        reads = {}
        for part, terms in self.sides():
            counts = terms.groupBy("term").agg(F.count("*").alias("bags"))
            if amount := queries.join(counts, "term").agg(F.sum("bags")).first()[0]:
                reads[part] = amount, Index(self.bags, terms.withColumnRenamed(part, "bag"), counts)
        if len(reads) != 1:
            return None
        [(part, (amount, index))] = reads.items()
        asked = join_postings(queries, index, amount).groupBy("query", F.col("bag").alias(part)).agg(
            F.collect_list(F.struct("weight", "tf")).alias("asked")
        )
        rows = self.bags.join(materialize(asked, f"bm25-asked-{part}"), part)
        add = lambda sum_, a: sum_ + a.weight * _impact(a.tf, "length", self.average)
        return rows.select("query", "bag", F.aggregate("asked", F.lit(0.0), add).alias("score"))


def _impact(tf, length, average: float) -> Column:
    """A term's share of its highest possible weight in a bag."""
    tf, length = (F.col(c) if isinstance(c, str) else c for c in (tf, length))
    return tf / (tf + K1 * (1 - B + B * length / F.lit(average)))


def tokens_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, tokens): the tokens of every text and a digest that equal bags of tokens share."""
    tokens = df.select(F.col(id_col), F.sort_array(tokenize(text_col)).alias("tokens"))
    # Tokens hold no blank, so the joined text tells bags apart.
    return tokens.select(id_col, F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("content"), "tokens")


def _members(documents: DataFrame, bags: DataFrame, *kept: str) -> DataFrame:
    """(bag, doc_id, kept columns): documents joined to bags on the columns that name a bag, any of which may be null."""
    keys = [c for c in bags.columns if c != "bag"]
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return documents.join(bags.withColumnsRenamed({k: f"_{k}" for k in keys}), same).select("bag", "doc_id", *kept)


def sizes_of(tokens: DataFrame, id_col: str) -> tuple[int, int]:
    """Rows and tokens in all; the ids name rows and must not repeat."""
    return _unique_rows(tokens, id_col, F.sum(F.size("tokens")))


def _unique_rows(tokens: DataFrame, id_col: str, amount: Column) -> tuple[int, int]:
    hashed = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows, ids, total = tokens.agg(F.count("*"), F.count_distinct(hashed), amount).first()
    # Hashes are shuffled instead of ids; where two are equal the ids decide.
    if rows != ids:
        ids = tokens.agg(F.count_distinct(id_col)).first()[0]
    if rows != ids:
        raise ValueError(f"{id_col} is not unique: {rows} rows, {ids} ids")
    return rows, total or 0


def distinct_bags(tokens: DataFrame, id_col: str, name: str) -> DataFrame:
    """(content, name, copies, tokens): each bag of tokens once, named by the smallest id that has it."""
    return tokens.groupBy("content").agg(F.min(id_col).alias(name), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))


def counted(tokens: str) -> Column:
    """How often tokens, which are in order and not empty, hold each term: an array of (term, tf).

    Counted within the row, so that nothing is gathered or shuffled: a term's tokens run from one start to the next.
    """
    # The tokens and the starts are bound once by a transform over one element.
    starts = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: ~F.get(t, i).eqNullSafe(F.get(t, i - 1)))
    found = lambda b: F.transform(b.starts, lambda s, n: F.struct(
        F.get(b.tokens, s).alias("term"), (F.coalesce(F.get(b.starts, n + 1), F.size(b.tokens)) - s).cast("long").alias("tf")))
    started = F.transform(F.array(tokens), lambda t: F.struct(t.alias("tokens"), starts(t).alias("starts")))
    return F.flatten(F.transform(started, found))


def term_counts(bags: DataFrame, *columns) -> DataFrame:
    """(columns, term, tf): how often each row's tokens, which are in order, hold each term."""
    return bags.filter(F.size("tokens") > 0).select(*columns, F.inline(counted("tokens")))


def build_index(docs: DataFrame, doc_id: str, text_col: str) -> Index:
    """Index documents by unique id; the frames are written to the shared folder for reuse over many searches."""
    with recorded() as written:
        built = _written_index(docs, doc_id, text_col)
    return replace(built, written=tuple(written))


def _written_index(docs: DataFrame, doc_id: str, text_col: str) -> Index:
    tokens = materialize(tokens_of(docs, doc_id, text_col), "bm25-tokens")
    named = materialize(distinct_bags(tokens, doc_id, "bag"), "bm25-bags")
    documents = tokens.select("content", F.col(doc_id).alias("doc_id"))
    counts = term_counts(named, "bag", "copies", F.size("tokens").alias("length"))
    return _weighed(documents, named.select("bag", "content"), counts, *sizes_of(tokens, doc_id))


def build_pair_index(docs: DataFrame, doc_id: str, first: str, second: str, first_texts: DataFrame, second_texts: DataFrame) -> Index:
    """Index documents of two texts each, cutting every text into tokens once however many documents have it.

    `docs` names the texts by their ids `first` and `second`; the texts' frames have such an id, each once, and `text`.
    A document without first text is left out, one without second text has the first only. All columns of `docs` are written.
    Of the documents no postings are written: a search makes those of its terms.
    """
    with recorded() as written:
        first_keys, first_terms = _parts(first_texts, first, "first")
        second_keys, second_terms = _parts(second_texts, second, "second")
        found = docs.withColumnRenamed(doc_id, "doc_id").join(second_keys, second, "left").join(first_keys, first)
        documents = materialize(found, "bm25-pairs")
        length = F.col("first.size") + F.coalesce("second.size", F.lit(0))
        n_docs, n_tokens = _unique_rows(documents, "doc_id", F.sum(length))
        columns = [F.col("first.key").alias("first"), F.col("second.key").alias("second"), length.alias("length")]
        gathered = documents.agg(F.approx_count_distinct(F.xxhash64("first", "second"))).first()[0] * GATHER_COPIES <= n_docs
        if gathered:
            # Pairs that differ may have the same tokens in all; as bags of their own they have the same score.
            bags = documents.select("doc_id", *columns).groupBy("first", "second").agg(
                F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("length").alias("length")
            )
            bags = materialize(bags, "bm25-bags").withColumn("bag", F.struct("doc_id", "first", "second")).drop("doc_id")
        else:
            bags = documents.select(F.struct("doc_id", first, second).alias("bag"), F.lit(1).cast("long").alias("copies"), *columns)
        shared = materialize(first_terms.select("term").distinct().join(second_terms.select("term"), "term", "left_semi"), "bm25-shared")
        shared = None if shared.isEmpty() else shared
        pairs = Pairs(bags, first_terms, second_terms, (n_tokens or 1) / (n_docs or 1), gathered, (first, second), shared)
        members = pairs.members(documents, bags) if gathered else bags.select("bag", "bag.*")
        built = Index(members, pairs.postings(), pairs.terms(n_docs), documents=documents, pairs=pairs)
    return replace(built, written=tuple(written))


def _parts(texts: DataFrame, key: str, part: str) -> tuple[DataFrame, DataFrame]:
    """(key, part) and (part's key, term, tf): texts of equal tokens are one part, a struct of its smallest key and its size in tokens."""
    tokens = tokens_of(texts, key, "text")
    named = distinct_bags(tokens, key, "key").select("content", F.struct("key", F.size("tokens").alias("size")).alias(part), "tokens")
    named = materialize(named, f"bm25-{part}")
    keys = materialize(tokens.select(key, "content").join(named.select("content", part), "content").select(key, part), f"bm25-{part}-keys")
    return keys, materialize(term_counts(named, F.col(f"{part}.key").alias(part)), f"bm25-{part}-terms")


def _weighed(documents: DataFrame, bags: DataFrame, counts: DataFrame, n_docs: int, n_tokens: int) -> Index:
    """The index of documents, the bags' (bag, what names it) and (bag, copies, length, term, tf).

    Members are joined where a search asks for some bags, not here for all.
    """
    impact = _impact("tf", "length", (n_tokens or 1) / (n_docs or 1))
    postings = materialize(counts.select("bag", "term", "copies", impact.alias("impact")), "bm25-postings")
    found = postings.groupBy("term").agg(
        F.sum("copies").alias("documents"), F.count("*").alias("bags"), F.max("impact").alias("peak")
    )
    return Index(
        _members(documents, bags), postings.select("bag", "term", "impact"), weighted_terms(found, n_docs), documents=documents, bags=bags
    )


def weighted_terms(found: DataFrame, n_docs: int) -> DataFrame:
    """(term, bags, peak, idf) of terms with their numbers of documents; a negative idf becomes a share of the mean."""
    raw_idf = F.log(F.lit(float(n_docs or 0)) - F.col("documents") + 0.5) - F.log(F.col("documents") + 0.5)
    terms = materialize(found.withColumn("raw_idf", raw_idf), "bm25-terms")
    mean_idf = terms.agg(F.avg("raw_idf")).first()[0] or 0.0
    idf = F.when(F.col("raw_idf") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("raw_idf"))
    return terms.select("term", "bags", "peak", idf.alias("idf"))


def _split_terms(queries: DataFrame, index: Index, postings_per_task: int, queries_per_task: int) -> DataFrame | None:
    """How many parts the postings and the queries of a very common term fall into; None when no term needs it."""
    uses = queries.groupBy("term").agg(F.count("*").alias("uses"))
    parts = (
        index.terms.join(uses, "term")
        .select(
            "term",
            F.ceil(F.col("bags") / postings_per_task).cast("int").alias("row_parts"),
            F.ceil(F.col("uses") / queries_per_task).cast("int").alias("use_parts"),
        )
        .filter("row_parts > 1 or use_parts > 1")
    )
    parts = materialize(parts, "bm25-split")
    terms = parts.count()
    return (F.broadcast(parts) if terms <= SPLIT_TERMS else parts) if terms else None


def join_postings(
    queries: DataFrame, index: Index, reads: int, broadcast_rows: int = BROADCAST_ROWS,
    postings_per_task: int = POSTINGS_PER_TASK, queries_per_task: int = QUERIES_PER_TASK,
) -> DataFrame:
    """Query terms with the postings of the term, `reads` rows in all.

    Few query terms go to every task, and the postings they name are spread by document, so that a
    document's score adds up where it is found. Many are joined on the term, a very common term as a
    grid of tasks.
    """
    if queries.count() <= broadcast_rows:
        tasks = max(queries.sparkSession.sparkContext.defaultParallelism, reads // READS_PER_TASK)
        wanted = index.postings.join(F.broadcast(queries.select("term").distinct()), "term", "left_semi")
        return wanted.repartition(tasks, "bag").join(F.broadcast(queries), "term")
    split = _split_terms(queries, index, postings_per_task, queries_per_task)
    if split is None:
        return queries.join(index.postings, "term")
    row_parts, use_parts = (F.coalesce(c, F.lit(1)) for c in ("row_parts", "use_parts"))
    left = (
        queries.join(split, "term", "left")
        .withColumn("_use", F.pmod(F.hash("query"), use_parts))
        .withColumn("_row", F.explode(F.sequence(F.lit(0), row_parts - 1)))
        .drop("row_parts", "use_parts")
    )
    right = (
        index.postings.join(split, "term", "left")
        .withColumn("_row", F.pmod(F.hash("bag"), row_parts))
        .withColumn("_use", F.explode(F.sequence(F.lit(0), use_parts - 1)))
        .drop("row_parts", "use_parts")
    )
    return left.join(right, ["term", "_use", "_row"]).drop("_use", "_row")


def search_bags(queries: DataFrame, index: Index, k: int, direct_reads: int = DIRECT_READS) -> DataFrame:
    """(query, bag, score) for every bag that may hold one of the k best documents of a query.

    `queries` has (query, tokens), each query once.
    """
    counts = term_counts(queries, "query").withColumnRenamed("tf", "qtf")
    weight = F.col("qtf") * F.col("idf") * (K1 + 1)
    weighted = materialize(
        counts.join(index.terms, "term").select(
            "query", "term", "bags", weight.alias("weight"), (F.greatest(weight, F.lit(0.0)) * F.col("peak")).alias("most")
        ),
        "bm25-queries",
    )
    reads = weighted.agg(F.sum("bags")).first()[0] or 0
    # The terms' bags in all are the postings.
    direct = reads <= (max(direct_reads, 2 * (index.terms.agg(F.sum("bags")).first()[0] or 0)) if direct_reads else 0)
    if index.pairs:
        scored = index.pairs.score_by_one_part(weighted.select("query", "term", "weight")) if direct else None
        if scored is not None:
            return scored
        wanted = index.pairs.postings(weighted.select("term").distinct())
        index = replace(index, postings=wanted if direct else materialize(wanted, "bm25-wanted"))
    if direct:
        return (
            join_postings(weighted.select("query", "term", "weight"), index, reads)
            .groupBy("query", "bag")
            .agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
        )
    by_most = [F.desc("most"), F.asc("bags"), F.asc("term")]

    # Lower bound on the k-th best score: the best documents of each query's strongest terms, fully scored.
    strong = top_k(weighted.filter("weight > 0"), ["query"], by_most, SEED_TERMS)
    wanted = strong.select("term").distinct()
    champions = top_k(index.postings.join(wanted, "term", "left_semi"), ["term"], [F.desc("impact"), F.asc("bag")], k)
    seeds = strong.select("query", "term").join(champions.select("term", "bag"), "term").select("query", "bag").distinct()
    seed_scores = (
        seeds.join(weighted.select("query", "term", "weight"), "query")
        .join(index.postings, ["bag", "term"])
        .groupBy("query", "bag")
        .agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    )
    bounds = (
        top_k(seed_scores, ["query"], [F.desc("score")], k, "_r")
        .groupBy("query")
        .agg(F.when(F.max("_r") == k, F.min("score")).otherwise(0.0).alias("bound"))
    )

    # Terms from strongest to weakest; the weak end that together cannot reach the bound is optional.
    below = W.partitionBy("query").orderBy(*by_most).rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy("query")
    ranked = weighted.join(bounds, "query").withColumn(
        "needed", (F.col("weight") > 0) & (F.sum("most").over(below) >= F.col("bound") - SLACK)
    )
    # Looking optional terms up in the documents brought up so far pays only while those are few;
    # otherwise reading the optional postings outright is less work.
    found = F.sum(F.when(F.col("needed"), F.col("bags")).otherwise(0)).over(whole)
    lookups = found * F.sum(F.when(F.col("needed"), 0).otherwise(1)).over(whole)
    reads = F.sum(F.when(F.col("needed"), 0).otherwise(F.col("bags"))).over(whole)
    ranked = materialize(
        ranked.withColumn("cheap", lookups < reads).withColumn("needed", F.col("needed") | ~F.col("cheap")).drop("cheap"),
        "bm25-bounds",
    )
    rest = ranked.groupBy("query").agg(
        F.first("bound").alias("bound"), F.sum(F.when(F.col("needed"), 0.0).otherwise(F.col("most"))).alias("rest")
    )
    needed_reads = ranked.filter("needed").agg(F.sum("bags")).first()[0] or 0
    partial = (
        join_postings(ranked.filter("needed").select("query", "term", "weight"), index, needed_reads)
        .groupBy("query", "bag")
        .agg(F.sum(F.col("weight") * F.col("impact")).alias("partial"))
        .join(rest, "query")
        .filter(F.col("partial") + F.col("rest") >= F.col("bound") - SLACK)
        .select("query", "bag", "partial")
    )
    optional = ranked.filter("not needed")
    if optional.isEmpty():
        return partial.withColumnRenamed("partial", "score")
    partial = materialize(partial, "bm25-partial")
    extra = (
        partial.join(optional.select("query", "term", "weight"), "query")
        .join(index.postings, ["bag", "term"])
        .groupBy("query", "bag")
        .agg(F.sum(F.col("weight") * F.col("impact")).alias("extra"))
    )
    return partial.join(extra, ["query", "bag"], "left").select(
        "query", "bag", (F.col("partial") + F.coalesce("extra", F.lit(0.0))).alias("score")
    )


def bm25_search(
    queries: DataFrame, query_id: str, query_col: str, index: Index, k: int = 5, direct_reads: int = DIRECT_READS, kept: tuple[str, ...] = ()
) -> DataFrame:
    """(query id, doc_id, score, rank): the k best documents of every query, ties by doc_id. Query ids are unique.

    Scores are ranked at 9 decimals and given at 4; documents scoring 0 or less are no hits. An index of pairs may have the ids
    of both texts `kept` as further columns.
    """
    asked = tokens_of(queries.select(query_id, query_col), query_id, query_col).filter(F.size("tokens") > 0)
    asked = materialize(asked, "bm25-asked")
    sizes_of(asked, query_id)
    named = materialize(distinct_bags(asked, query_id, "query"), "bm25-distinct")
    scored = search_bags(named.select("query", "tokens"), index, k, direct_reads)
    scored = scored.withColumn("_score", F.round("score", 9)).filter("_score > 0")
    # The k best bags, ties by their first document, hold the k best documents.
    best = materialize(top_k(scored, ["query"], [F.desc("_score"), F.asc("bag")], k, "_place"), "bm25-best")
    if index.pairs and not index.pairs.gathered:
        hits = best.select("*", "bag.*").withColumnRenamed("_place", "rank")
    else:
        copies = top_k(index.members_of(best.select("bag").distinct()), ["bag"], [F.asc("doc_id")], k, "_copy")
        hits = top_k(best.join(copies, "bag"), ["query"], [F.desc("_score"), F.asc("doc_id")], k)
    hits = hits.select("query", "doc_id", F.round("score", 4).alias("score"), "rank", *kept)
    names = named.select("content", "query")
    return asked.select(query_id, "content").join(names, "content").join(hits, "query").select(query_id, "doc_id", "score", "rank", *kept)
