"""License scans: exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A block is a line or, with ``across``, also any run of consecutive words of the whole text, over line ends, as long as the
template and so much more that foreign words may make up ``1 - threshold`` of it: a notice is found however it is wrapped,
at every place.  A block matches a template when it holds at least ``threshold`` of the template's distinct words.
The join is exact: template words are put in one global order, rarest in the corpus first (document frequencies over all
texts, counted for the template words alone, so their number is fixed by the templates); a block can only match if it

* has a word among the first ``n - need + 1`` of the template's n words (prefix filter, need = ceil(threshold * n)),
* has at least ``need`` distinct words (length filter), and
* leaves enough words behind the first shared one, on both sides, to reach ``need`` (positional filter).

Runs are only looked at around words of a template's prefix, where the neighbourhood, as far as a run with that word can
reach, has ``need`` distinct words; the work stays in proportion to the text.

What passes the filters is verified by its exact overlap.  The index of prefixes is made of literals as large as the
templates, so each text is scanned where it lies and no text is shuffled.

Beside the templates, fixed phrases are looked up word by word in the whole text, across lines.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned one by one; an empty
table gives an empty result; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and template text, in the words of public licenses' own notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under a creative commons attribution share alike 4.0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
#: What is no word and no line end; capitals are lowered before.
BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """ASCII capitals in lower case; other letters may change too, which no phrase or template can tell: all are ASCII,
    and the one other character whose lower case is ASCII (the Kelvin sign) is put out of reach first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _words(template: str) -> list[str]:
    return sorted(set(template.replace(".", " ").split()))


def run_length(template: str, threshold: float) -> int:
    """Words of a run that is compared with the template: its own, and foreign ones up to 1 - threshold of the run."""
    return math.ceil(len(template.replace(".", " ").split()) / threshold - 1e-9)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, lines (lowered, words with single spaces between) and padded (all words, a space before and behind each)."""
    lined = docs.select("doc_id", F.regexp_replace(_lowered(F.col("text")), BETWEEN, " ").alias("lined"))
    return lined.select("doc_id", "lined", F.regexp_replace(F.concat(F.lit(" "), "lined", F.lit(" ")), r"[ \n]+", " ").alias("padded"))


def word_order(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """The distinct words of the templates, rarest in docs first (ties by the word)."""
    known = sorted({w for _, t in templates for w in _words(t)})
    found = prepared(docs).select(F.explode(F.array_intersect(F.array(*map(F.lit, known)), F.split("padded", " "))).alias("word"))
    count = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most len(known) rows
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def scan(docs: DataFrame, order: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = 0.8, across: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score.

    score is the largest share of a template's words that a matching block holds, and 1 where a phrase stands.  Blocks are
    lines alone unless across is set.
    """
    rank = {w: i for i, w in enumerate(order)}
    ready = prepared(docs).select("*", (_spaces(F.col("padded")) - 1).cast("long").alias("n_words"))
    # phrases: a match is found by its words with the spaces around them, so places may share a space
    cols: dict[str, Column] = {}
    for k, (phrase, _) in enumerate(phrases):
        has = F.contains("padded", F.lit(f" {phrase} "))
        after = F.substring_index("padded", f" {phrase} ", -1)
        cols |= {
            f"n{k}": F.when(has, F.regexp_count("padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0).cast("long"),
            f"first{k}": F.when(has, _spaces(F.substring_index("padded", f" {phrase} ", 1)).cast("long")),
            f"last{k}": F.when(has, F.col("n_words") - _spaces(after) - len(phrase.split())),
        }
    ready = ready.withColumns(cols)
    # templates: (words in global order, words needed)
    index = []
    for label, text in templates:
        words = sorted(_words(text), key=rank.__getitem__)
        index.append((label, words, math.ceil(threshold * len(words) - 1e-9), run_length(text, threshold)))
    prefixes = sorted({w for _, words, need, _ in index for w in words[: len(words) - need + 1]}, key=rank.__getitem__)
    lits = lambda words: F.array(*map(F.lit, words))
    near = F.filter(F.split("lined", "\n"), lambda x: F.arrays_overlap(F.split(x, " "), lits(prefixes)))
    candidates = F.when(F.arrays_overlap(F.split("padded", " "), lits(prefixes)), F.transform(near, lambda x: F.array_intersect(lits(order), F.split(x, " "))))
    none = F.array().cast("array<array<string>>")
    ready = ready.withColumn("blocks", F.coalesce(candidates, none))
    if across:
        # every word, and the places (from 1) of those in prefixes; both null where the text has none of them
        ready = ready.withColumn("words", F.when(F.size("blocks") > 0, F.split("padded", " ")))
        ready = ready.withColumn("places", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(prefixes), i + 1))))

    def runs(words: list[str], need: int, length: int) -> Column:
        """Runs of words that may match the template: those with a word of its prefix, in neighbourhoods with enough words."""
        run = lambda i, n: F.slice("words", i, n)
        first = lambda i: F.greatest(i - (length - 1), F.lit(1))
        anchors = F.filter("places", lambda i: F.element_at("words", i).isin(words[: len(words) - need + 1]))
        near = F.filter(anchors, lambda i: F.size(F.array_intersect(lits(words), run(first(i), i - first(i) + length))) >= need)
        begins = F.array_distinct(F.flatten(F.transform(near, lambda i: F.sequence(first(i), i))))
        return F.coalesce(F.transform(begins, lambda i: F.array_intersect(lits(order), run(i, F.lit(length)))), none)

    def best(words: list[str], need: int, length: int) -> Column:
        """The largest overlap of a block with the template, 0 below need.  A block is its template words in global order."""
        blocks = F.concat("blocks", runs(words, need, length)) if across else F.col("blocks")

        def overlap(block: Column) -> Column:
            shared = F.array_intersect(lits(words), block)
            first = F.element_at(shared, 1)
            left = F.least(F.lit(len(words) + 1) - F.array_position(lits(words), first), F.size(block) + 1 - F.array_position(block, first))
            in_prefix = F.arrays_overlap(block, lits(words[: len(words) - need + 1]))
            return F.when((F.size(block) >= need) & in_prefix, F.when((left >= need) & (F.size(shared) >= need), F.size(shared)).otherwise(0)).otherwise(0)

        return F.coalesce(F.array_max(F.transform(F.filter(blocks, lambda b: F.size(b) >= need), overlap)), F.lit(0))

    ready = ready.withColumns({f"t{k}": F.when(F.size("blocks") > 0, best(words, need, length)).otherwise(0) for k, (_, words, need, length) in enumerate(index)})
    base = [F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]
    more = [F.when(F.col(f"t{k}") > 0, F.lit(label)) for k, (label, *_) in enumerate(index)]
    score = F.greatest(F.lit(0.0), *[F.when(F.col(f"n{k}") > 0, F.lit(1.0)) for k in range(len(phrases))], *[F.col(f"t{k}") / float(len(words)) for k, (_, words, *_) in enumerate(index)])
    tidy = lambda x: F.array_sort(F.array_distinct(F.array_compact(F.array(*x))))
    return ready.select(
        "doc_id",
        "n_words",
        sum(F.col(f"n{k}") for k in range(len(phrases))).alias("n_base"),
        F.least(*[F.col(f"first{k}") for k in range(len(phrases))]).alias("first_word"),
        F.greatest(*[F.col(f"last{k}") for k in range(len(phrases))]).alias("last_word"),
        tidy(base).alias("base_labels"),
        tidy(base + more).alias("labels"),
        score.alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = scan(docs, word_order(docs), across=True)
    return got.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})
