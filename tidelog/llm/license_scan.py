"""License scan: phrase places and an exact set-similarity join against license templates, DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import text_or_empty, written

# Phrases and their labels, as the contract of the query names them.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices by which public licenses ask to be named, and their labels.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is free and unencumbered software released into the public domain": "unlicense",
}
#: Share of a template's distinct words that a window of the text must have.
CONTAINMENT = 0.8
#: Words in a window, as a multiple of the template's: marks of comments and changes of the wording may stand between.
WINDOW_LENGTHS = 2
#: What is not a word, in Java's pattern syntax; words are what lies between.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _needed(size: int, containment: float) -> int:
    return math.ceil(round(containment * size, 9))


def _spaced(text: Column) -> Column:
    """The words of text with one blank between them; empty without words."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, NOT_WORD, " "))


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _all_words(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.lower()).split()


def _template_words(template: str) -> list[str]:
    """The distinct words of an ASCII template, sorted."""
    return sorted(set(_all_words(template)))


def _width(template: str) -> int:
    return WINDOW_LENGTHS * len(_all_words(template))


def spaced_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spaced) of each row of docs(doc_id, text): the words of whole texts with one blank between them."""
    text = text_or_empty("text")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _spaced(text).alias("spaced"))


def token_order(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each word of the vocabulary by the number of rows(spaced) with it, rarest first, ties by word.

    Counted over all documents. The vocabulary is that of the templates, so one row a word comes back.
    """
    words = F.array_intersect(F.split("spaced", " "), F.lit(vocabulary))
    counts = {r["word"]: r["n"] for r in rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {word: rank for rank, word in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _prefix_size(size: int, containment: float) -> int:
    """How many of a template's rarest words a window with enough of it can't be without all of."""
    return size - _needed(size, containment) + 1


def _prefix_index(spark: SparkSession, templates: dict[str, str], order: dict[str, int], containment: float) -> DataFrame:
    """One row for each word in a template's prefix: a window with enough of the template has one of them."""
    rows = []
    for template, label in templates.items():
        words = sorted(_template_words(template), key=order.get)
        prefix = words[: _prefix_size(len(words), containment)]
        rows += [(word, label, _needed(len(words), containment), _width(template), words) for word in prefix]
    return spark.createDataFrame(rows, "word string, label string, need int, width int, words array<string>")


def template_matches(rows: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, label, containment): labels of :func:`spaced_rows` by windows with that share of a template's words.

    A set-similarity join of word windows and templates. A window is as many consecutive words as WINDOW_LENGTHS
    lengths of the template, taken at each word of the whole text; ends of lines are like blanks. Words are ordered by
    their document frequency in the whole corpus, rarest first. A window that has ``need`` of a template's words has
    one of the template's first ``size - need + 1`` (prefix filter), so only the words around places of those are
    looked at: all windows with such a place together have at least ``need`` words of the template (length filter), and
    the best of them begins at a word of the template at or before the place (positional filter). What passes is counted
    in full, and a text's best window counts. Templates are constants of this module or a parameter, so their side is
    broadcast.
    """
    spark = rows.sparkSession
    vocabulary = sorted({w for t in templates for w in _template_words(t)})
    index = _prefix_index(spark, templates, token_order(rows, vocabulary), containment)
    prefix_words = sorted(r["word"] for r in index.select("word").distinct().collect())
    widest = max(map(_width, templates))
    # Blanks bound every word, so that a document without any prefix word is passed over by one pattern.
    any_prefix = f" (?:{'|'.join(prefix_words)}) "
    some = rows.filter(F.concat(F.lit(" "), "spaced", F.lit(" ")).rlike(any_prefix))
    texts = some.select("doc_id", "text_hash", F.split("spaced", " ").alias("all"))
    places = F.array_compact(F.transform("all", lambda w, i: F.when(w.isin(prefix_words), i)))
    # The words before a place, and those from it on, as far as windows reach.
    around = F.transform(
        places,
        lambda p: F.struct(
            F.slice("all", F.greatest(p - (widest - 1), F.lit(0)) + 1, F.least(p, F.lit(widest - 1))).alias("before"),
            F.slice("all", p + 1, widest).alias("after"),
        ),
    )
    found = texts.select("doc_id", "text_hash", F.explode(around).alias("a")).select("doc_id", "text_hash", "a.before", "a.after", F.element_at("a.after", 1).alias("word"))
    near = found.join(F.broadcast(index), "word")
    n_before = F.least(F.size("before"), F.col("width") - 1)
    near = near.withColumn("n_before", n_before).withColumn("near", F.concat(F.slice("before", F.size("before") - n_before + 1, n_before), F.slice("after", F.lit(1), F.col("width"))))
    candidates = near.filter(F.size(F.array_intersect("near", "words")) >= F.col("need"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n_before")), lambda s: F.array_contains("words", F.get("near", s)))
    overlap = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("near", s + 1, F.col("width")), "words"))))
    matches = candidates.select("doc_id", "text_hash", "label", "need", overlap.alias("overlap"), F.size("words").alias("size")).filter("overlap >= need")
    return matches.select("doc_id", "text_hash", "label", (F.col("overlap") / F.col("size")).alias("containment")).distinct()


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a phrase's words stand one after another; first_word and last_word are the
    smallest and largest start among them, null without any. labels are those of the phrases and of
    :func:`template_matches`. score is 1 with a phrase, else the largest containment found, else 0.

    Texts are normalised once, into a table of their words, which the counts of words and the windows are read from.

    Null and empty texts have no words and no labels. Rows with a null doc_id get their own matches as any others;
    rows that repeat each other give equal results. Other columns of docs are ignored. An empty table gives an empty
    result.
    """
    base = spaced_rows(docs)
    base = base.withColumn("n_words", F.when(F.col("spaced") == "", F.lit(0)).otherwise(_blanks(F.col("spaced")) + 1).cast("long"))
    base = base.withColumn("padded", F.concat(F.lit(" "), "spaced", F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        has = F.contains("padded", F.lit(f" {phrase} "))
        pieces = F.split("padded", f"(?<= ){phrase}(?= )")
        counts.append(F.when(has, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(has, _blanks(F.element_at(pieces, 1)) - 1))
        lasts.append(F.when(has, F.col("n_words") - (_blanks(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    base = base.select(
        "doc_id",
        "text_hash",
        "spaced",
        "n_words",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )
    base = written(docs.sparkSession, base, "license-words")
    found = template_matches(base, templates, containment).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    joined = base.join(found, base["doc_id"].eqNullSafe(found["found_id"]) & (base["text_hash"] == found["found_hash"]), "left")
    every = F.sort_array(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
