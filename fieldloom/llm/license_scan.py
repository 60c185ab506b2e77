"""License scans by diagonal voting on word k-grams.

All rolling hashes of k words of a text are joined to the positions of the templates that hold them. A match of the word
at `pos` with the template's word at `at` votes for the diagonal `pos - at`. A text that holds the template word by word
puts all votes on one diagonal; inserted or missing words move the rest to a neighbouring one, so neighbours are merged.
Every match is verified on the words themselves, and the verified span counts if it covers enough of the template.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import materialize

#: Words of a gram.
K = 3
#: Diagonals this far apart belong to one span.
DRIFT = 4
#: Share of a template's grams that a span of the method must hold.
SHARE = 0.6
#: Fixed: the words of a text whose letters A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    words: str
    base: bool


#: Phrases of the base labels, and opening words of licenses for the method's own labels. 66 words at most.
TEMPLATES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", False),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", False),
    Template("gpl", "licensed under the gnu general public license", False),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("cc-by", "this work is licensed under a creative commons attribution", False),
    Template("mpl-2", "subject to the terms of the mozilla public license", False),
]


def words_of(text: Column) -> Column:
    """The words with A-Z lower-cased.

    `lower` also changes other letters, and of these only the Kelvin sign becomes a letter a-z; it is replaced before,
    so that comparing to words of a-z and digits is exact.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), 0)


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """The k-grams of all templates: as long as the list of templates."""
    rows = []
    for number, template in enumerate(templates):
        words = template.words.split()
        if not 0 <= len(words) - K < 64:
            raise ValueError(f"a template needs {K} to {63 + K} words: {template.words}")
        rows += [f"({number}, {at}, array({', '.join(repr(w) for w in words[at : at + K])}))" for at in range(len(words) - K + 1)]
    return spark.sql(
        "SELECT _template, _at, _gram, xxhash64(" + ", ".join(f"_gram[{i}]" for i in range(K)) + f") AS _hash FROM VALUES {', '.join(rows)} AS t(_template, _at, _gram)"
    )


def _key(id_column: str, text_column: str) -> list[Column]:
    return [F.col(id_column).alias("doc_id"), F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("text_hash")]


def scanned(docs: DataFrame, grams: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Each row's doc_id, text_hash, number of words and hits: the places whose rolling hash is that of a template's gram.

    Written, so that the words are cut and hashed once, for counts and spans alike.
    """
    listed = [r[0] for r in grams.select("_hash").distinct().collect()]
    # The words are bound once by a transform over one element.
    hit = lambda w, i: F.xxhash64(*[F.get(w, i + n) for n in range(K)]).isin(listed)
    rolling = lambda w: F.when(F.size(w) >= K, F.filter(F.sequence(F.lit(0), F.size(w) - K), lambda i: hit(w, i)))
    gram = lambda w: F.transform(rolling(w), lambda i: F.struct(i.alias("_pos"), F.slice(w, i + 1, K).alias("_gram")))
    found = F.transform(F.array(words_of(F.col(text_column))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), gram(w).alias("hits")))
    return materialize(docs.select(*_key(id_column, text_column), F.inline(found)), "scanned")


def license_spans(docs: DataFrame, templates: list[Template] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The verified spans of each text: doc_id, text_hash, label, base, first_word, last_word, covered.

    One row for each place of a base phrase (covered 1.0), and one for each span of another template of which merged
    diagonals hold SHARE or more. first_word and last_word are the span's ends, from 0. Null text is empty and has no
    spans. A row of `docs` that is repeated has its spans once. Whole texts are scanned, at any length.
    """
    grams = template_grams(docs.sparkSession, templates)
    return _spans(scanned(docs, grams, id_column, text_column), grams, templates)


def _spans(scan: DataFrame, grams: DataFrame, templates: list[Template]) -> DataFrame:
    placed = scan.select("doc_id", "text_hash", F.inline("hits"))
    # The hash has found the places, the words decide.
    found = placed.join(F.broadcast(grams.drop("_hash")), "_gram")
    votes = found.groupBy("doc_id", "text_hash", "_template", (F.col("_pos") - F.col("_at")).alias("_diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_mask"), F.min("_pos").alias("_first"), F.max("_pos").alias("_last")
    )
    # Written, as two searches read it.
    votes = materialize(votes, "votes")
    facts = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {len(t.words.split()) - K + 1})" for n, t in enumerate(templates))
    listed = scan.sparkSession.sql(f"SELECT * FROM VALUES {facts} AS t(_template, label, base, _grams)")
    votes = votes.join(F.broadcast(listed), "_template")
    base = votes.where("base and bit_count(_mask) = _grams")
    in_order = Window.partitionBy("doc_id", "text_hash", "_template").orderBy("_diagonal")
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(in_order) > DRIFT, F.lit(True))
    other = votes.where("not base").withColumn("_apart", apart.cast("int")).withColumn("_span", F.sum("_apart").over(in_order))
    merged = other.groupBy("doc_id", "text_hash", "label", "base", "_template", "_grams", "_span").agg(
        F.bit_or("_mask").alias("_mask"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    covered = F.expr("bit_count(_mask) / _grams")
    columns = ["doc_id", "text_hash", "label", "base", F.col("_first").cast("long").alias("first_word"), (F.col("_last") + K - 1).cast("long").alias("last_word")]
    return base.select(*columns, covered.alias("covered")).union(merged.where(covered >= SHARE).select(*columns, covered.alias("covered")))


def license_report(docs: DataFrame, templates: list[Template] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest covered share of a span, 0 without one. Rows with null ids, repeated rows and texts without
    words are reported like any other; columns besides the two are not read.
    """
    grams = template_grams(docs.sparkSession, templates)
    counted = scanned(docs, grams, id_column, text_column)
    spans = _spans(counted, grams, templates)
    only = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "text_hash").agg(
        F.count_if("base").alias("n_base"), F.min(only("first_word")).alias("first_word"),
        F.max(only("first_word")).alias("last_word"), joined(only("label")).alias("base_labels"),
        joined(F.col("label")).alias("labels"), F.max("covered").alias("score"),
    )
    on = counted.doc_id.eqNullSafe(found.doc_id) & (counted.text_hash == found.text_hash)
    return counted.join(found, on, "left").select(
        counted.doc_id, "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
