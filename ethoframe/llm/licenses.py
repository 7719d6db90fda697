"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of ``2 * stride`` words that starts at a multiple of ``stride``, where the stride is the length of the longest template: any passage
of up to that many words stands whole in some block. A template matches a block if the block has at least ``threshold`` of the
template's distinct words (templates of at most SHORT words: all; phrases: all of them, standing consecutively). The join is exact and uses no word pairs beyond these filters:

* words are ordered by the number of documents that have them, rarest first, counted over all documents;
* prefix: a block that shares ``need`` words with a template shares one of the template's ``size - need + 1`` rarest;
* length: a block must have ``need`` words of the template vocabulary at all;
* position: behind a shared word, both sides must have enough words left in the global order.

Nulls and edges: a null or empty text has no words and no match; documents of any length are cut into blocks, never shortened; repeated
rows give repeated results; ties in the order of words are broken by the word; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoframe.llm.common import TEXT_SEPARATORS, ascii_lower, words_of

#: Phrases whose consecutive words are places of a label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licenses, in the words of their texts.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
]
THRESHOLD = 0.85
#: A template of at most this many distinct words matches whole or not at all: one word of it may tell two licenses apart.
SHORT = 12


def _words(text: str) -> list[str]:
    cut = "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or c.isdigit() or "a" <= c <= "z" else " " for c in text)
    return cut.split()


def _literal(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def license_scan(docs: DataFrame, templates=tuple(TEMPLATES), phrases=tuple(PHRASES.items()), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and match: doc_row, doc_id, n_words, label, kind (template or phrase), block_start, containment, places.

    ``places`` are the starts of a phrase, each reported by the one block in whose first half it lies. A document without a match has one row with a
    null label. ``doc_row`` tells repeated rows apart.
    """
    spark = docs.sparkSession
    parts = [("template", label, _words(text)) for label, text in templates] + [("phrase", label, _words(text)) for text, label in phrases]
    stride = max(len(w) for _, _, w in parts)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("doc_row"), words_of(ascii_lower(F.col("text")), TEXT_SEPARATORS).alias("words"))

    vocabulary = sorted({w for _, _, words in parts for w in words})
    # a count for each word of the templates: as many rows as the templates have words
    seen = rows.select(F.explode(F.array_intersect(_literal(vocabulary), "words")).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}

    index = []
    for kind, label, words in parts:
        ordered = sorted(set(words), key=rank.__getitem__)
        need = len(ordered) if kind == "phrase" or len(ordered) <= SHORT else max(1, math.ceil(threshold * len(ordered) - 1e-9))
        index += [(w, at + 1, kind, label, words, ordered, need) for at, w in enumerate(ordered[: len(ordered) - need + 1])]
    postings = spark.createDataFrame(index, "word string, at int, kind string, label string, phrase array<string>, ordered array<string>, need int")
    prefix_words = _literal(sorted({x[0] for x in index}, key=rank.__getitem__))
    order = _literal(sorted(vocabulary, key=rank.__getitem__))

    n = F.size("words")
    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, 2 * stride).alias("words")))
    some = F.when(F.arrays_overlap("words", prefix_words), F.filter(blocks, lambda b: F.arrays_overlap(b["words"], prefix_words)))
    cut = rows.select("doc_row", "doc_id", n.cast("long").alias("n_words"), F.explode_outer(some).alias("block"))
    known = cut.select("*", F.array_intersect(order, "block.words").alias("known"))
    probes = known.select("*", F.explode_outer(F.array_intersect(prefix_words, "known")).alias("word"))
    joined = probes.join(F.broadcast(postings), "word", "left")
    left = lambda size, at: size - at + 1
    fits = (F.size("known") >= F.col("need")) & (
        F.least(left(F.size("ordered"), F.col("at")), left(F.size("known"), F.array_position("known", F.col("word")))) + F.col("at") - 1 >= F.col("need")
    )
    shared = F.size(F.array_intersect("known", "ordered"))
    block = F.col("block.words")
    places = F.when(
        F.col("kind") == "phrase",
        F.filter(F.sequence(F.lit(0), F.least(F.lit(stride), F.size(block)) - 1), lambda i: F.slice(block, i + 1, F.size("phrase")) == F.col("phrase")),
    )
    kept = joined.withColumn("shared", F.when(fits, shared)).withColumn("places", F.when(F.col("shared") >= F.col("need"), places))
    hit = (F.col("shared") >= F.col("need")) & ((F.col("kind") == "template") | (F.size("places") > 0))
    when = lambda c: F.when(hit, c)
    return kept.select(
        "doc_row", "doc_id", "n_words", when(F.col("label")).alias("label"), when(F.col("kind")).alias("kind"), when(F.col("block.start")).alias("block_start"),
        when(F.col("shared") / F.size("ordered")).alias("containment"), when(F.transform("places", lambda p: p + F.col("block.start"))).alias("places"),
    )


def license_report(docs: DataFrame, **options) -> DataFrame:
    """license_scan() by document: n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment)."""
    found = license_scan(docs, **options)
    phrase = lambda c: F.when(F.col("kind") == "phrase", c)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    # a phrase has one rarest word, so a block finds it once; a template may be found by several words, which changes no set and no maximum
    return found.groupBy("doc_row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(phrase(F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(phrase(F.array_min("places"))).cast("long").alias("first_word"), F.max(phrase(F.array_max("places"))).cast("long").alias("last_word"),
        names(phrase(F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"),
        F.coalesce(F.max("containment"), F.lit(0.0)).cast("double").alias("score"),
    ).drop("doc_row")


