"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined with those of all templates: pairs for base phrases, triples for
longer texts. A hit at word p of the text and word q of a template votes for the diagonal p - q, where the template would begin.
Votes are added up per diagonal; diagonals of one template that lie within SLACK words are one occurrence with words put in or left
out. An occurrence is verified on the words themselves and by the share of the template's k-grams that voted.

Built-in expressions only. Words and hashes live inside one row, which only the k-grams that templates have leave, with the words
around them; what is shuffled is one small row per text and one per hit, added up before. Time grows with the length of a text.

Defined results: a null text is an empty one, with no words, no labels, null places and score 0. Repeated rows are each
returned. A base phrase is found wherever its words stand one after the other, also where places overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that may be put in or left out inside an occurrence.
SLACK = 3
#: Share of a template's k-grams that must vote, and of its words that must stand in the occurrence.
VOTES, HELD = 0.6, 0.75


@dataclass(frozen=True)
class Template:
    """``exact`` ones are the base phrases, of two words or more; the others, of three or more, are found with gaps."""

    label: str
    words: tuple[str, ...]
    exact: bool = False

    @property
    def k(self) -> int:
        return 2 if self.exact else 3

    def __post_init__(self) -> None:
        if len(self.words) < self.k:
            raise ValueError(f"a template of {self.k} words or more is needed: {self.label}")


# Base phrases and their labels.
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# Well-known sentences of public licences and notices, in lower case.
ADDED = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-grant", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-grant", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-notice", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-notice", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-version", "gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("cc-notice", "licensed under cc by"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("warranty", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("rights", "all rights reserved"),
]
TEMPLATES = [Template(label, tuple(text.split()), True) for label, text in BASE] + [Template(label, tuple(text.split())) for label, text in ADDED]

# Fixed value: what parts words, which are runs of digits, ASCII letters and characters beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words with A-Z in lower case. Splitting costs an eighth of the time of extracting all matches."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """``gram, template, q, width, tokens`` of each k-gram of each template, and the row that every text meets once."""
    rows = [(None, None, None, -1, 0, 1, [])]
    rows += [(*t.words[q : q + t.k], *[None] * (3 - t.k), n, q, len(t.words), list(t.words)) for n, t in enumerate(templates) for q in range(len(t.words) - t.k + 1)]
    table = spark.createDataFrame(rows, "a string, b string, c string, template int, q int, width int, tokens array<string>")
    pair, triple = F.xxhash64("a", "b"), F.xxhash64(F.xxhash64("a", "b"), F.xxhash64("b", "c"))
    return table.select(F.when(F.col("template") < 0, F.lit(0).cast("long")).when(F.col("c").isNull(), pair).otherwise(triple).alias("gram"), "template", "q", "width", "tokens")


def scan(docs: DataFrame, templates: list[Template] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences: ``doc_id, text_hash, n_words, rows, template, start, grams, share, held, exact, first_exact, last_exact``.

    One row per text has template -1 and stands for the text itself; ``rows`` counts the equal rows that it stands for.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    key = ["doc_id", "text_hash"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    hashes = F.when(n > 1, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    paired = texts.select(*key, "w", hashes.alias("pairs"))
    # Only k-grams that some template has leave the row, each with the words around it, so a text costs time by its length.
    reach = max((len(t.words) for t in templates), default=0) + SLACK
    every = list(dict.fromkeys(pair for t in templates for pair in zip(t.words, t.words[1:], strict=False)))
    exact = list(dict.fromkeys(pair for t in templates if t.exact for pair in zip(t.words, t.words[1:], strict=False)))
    known = lambda g, pairs: g.isin(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in pairs]) if pairs else F.lit(False)
    met = F.filter(F.transform("pairs", lambda g, i: F.when(known(g, every), F.struct((i + 1).alias("p"), g.alias("gram")))), lambda h: h.isNotNull())
    follows = lambda h, i: F.get("met", i + 1)
    triples = F.transform("met", lambda h, i: F.when(follows(h, i)["p"] == h["p"] + 1, F.struct(h["p"].alias("p"), F.xxhash64(h["gram"], follows(h, i)["gram"]).alias("gram"))))
    places = F.concat(F.filter("met", lambda h: known(h["gram"], exact)), F.filter(triples, lambda h: h.isNotNull()))
    placed = paired.select(*key, "w", met.alias("met")).select(*key, "w", F.size("w").alias("n_words"), places.alias("places"))
    first = lambda h: F.greatest(h["p"] - reach, F.lit(1))
    seen = F.transform("places", lambda h: F.struct(h["p"].alias("p"), h["gram"].alias("gram"), first(h).alias("first"), F.slice("w", first(h), F.lit(2 * reach)).alias("near")))
    itself = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("gram"), F.lit(1).alias("first"), F.array().cast("array<string>").alias("near")))
    found = placed.select(*key, "n_words", F.explode(F.concat(itself, seen)).alias("h")).select(*key, "n_words", "h.*")
    # The templates are a list in this file (or a short one given), so their k-grams may be broadcast.
    hits = found.join(F.broadcast(template_grams(spark, templates)), "gram").where("(p = 0) = (template < 0)")
    diagonal = (F.col("p") - 1 - F.col("q")).alias("diagonal")
    begin = F.col("p") - F.col("q")
    here = F.when((F.col("template") >= 0) & (begin >= 1), F.slice("near", F.greatest(begin - F.col("first") + 1, F.lit(1)), F.col("width")))
    around = F.slice("near", F.greatest(F.greatest(begin - SLACK, F.lit(1)) - F.col("first") + 1, F.lit(1)), F.col("width") + 2 * SLACK)
    held = F.when(F.col("template") >= 0, F.size(F.array_intersect("tokens", around)) / F.size(F.array_distinct("tokens"))).alias("held")
    k = F.when(F.element_at(F.array(*[F.lit(t.exact) for t in templates], F.lit(True)), F.greatest(F.col("template") + 1, F.lit(1))), 1).otherwise(2)
    hits = hits.select(*key, "n_words", "template", "q", (F.col("width") - k).alias("grams"), diagonal, (here == F.col("tokens")).alias("same"), held)
    # Votes of equal rows are added up before they meet.
    votes = hits.groupBy(*key, "template", "diagonal").agg(F.max("n_words").alias("n_words"), F.max("grams").alias("grams"), F.collect_set("q").alias("q"), F.max("same").alias("same"), F.max("held").alias("held"), F.count(F.lit(1)).alias("n")).repartition(*key)
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > SLACK).cast("int")
    votes = votes.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    voted = F.size(F.array_distinct(F.flatten(F.collect_list("q"))))
    place = F.when(F.col("same"), F.col("diagonal"))
    return votes.groupBy(*key, "template", "run").agg(
        F.max("n_words").alias("n_words"), F.max("n").alias("rows"), F.min("diagonal").alias("start"), F.max("grams").alias("grams"), (voted / F.greatest(F.max("grams"), F.lit(1))).alias("share"), F.max("held").alias("held"),
        F.count(place).alias("exact"), F.min(place).alias("first_exact"), F.max(place).alias("last_exact"),
    ).drop("run")


def labelled(docs: DataFrame, templates: list[Template] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row."""
    templates = TEMPLATES if templates is None else templates
    found = scan(docs, templates, id_col=id_col, text_col=text_col)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1) & (F.col("exact") > 0)
    close = ~F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1) & (F.col("share") >= VOTES) & (F.col("held") >= HELD)
    known = F.col("template") >= 0
    found = found.withColumn("base", F.when(known, base).otherwise(False)).withColumn("close", F.when(known, close).otherwise(False)).withColumn("label", F.when(known, label))
    text = lambda on: F.array_join(F.array_sort(F.collect_set(F.when(on, F.col("label")))), ",")
    score = F.when(F.col("base"), F.lit(1.0)).when(F.col("close"), F.col("share")).otherwise(0.0)
    out = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum(F.when(F.col("base"), F.col("exact")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_exact"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("last_exact"))).cast("long").alias("last_word"),
        text(F.col("base")).alias("base_labels"), text(F.col("base") | F.col("close")).alias("labels"), F.max(score).alias("score"), F.max(F.when(~known, F.col("rows"))).alias("rows"),
    )
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("text_hash", "rows", "row")


def op9_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"))
