"""License scans by diagonal voting. DataFrame functions only.

Templates (whole licence texts, notices and short phrases) and documents are rows
of words. The hashes of all rolling word grams of every document are joined with
the templates' gram positions: grams of K words, and of 2 or 1 for phrases that
have fewer. Each word is hashed once; a gram's hash rolls up from those of its two
halves. A match at document word d and template word t votes for the template on the
diagonal d - t. The rows that are joined hold a hash and its place, no words; the
documents that have matches are read again, and their words compared at those places, so
the work grows with a text's length alone.
Votes are gathered by diagonal; neighbouring diagonals, as words put in or left
out make them, are merged into spans. A span is verified by the share of the
template's grams that it holds. A phrase is found where one diagonal holds all
its grams.

Defined cases: a null or empty text has no words; fewer words than a gram match
nothing; a template without words is never found; a text of any length is scanned
whole; repeated rows get the same result each; a null doc_id is scanned like
any; an empty table gives no row; other columns are ignored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import documents, member_filter, saved, text_key
from tablesmith.llm.license_texts import TEXTS

#: Words of a gram, a power of two.
K = 4
#: So many gram positions of templates are broadcast at most; beyond that Spark chooses the join.
MOST_BROADCAST = 100_000
#: A diagonal of a template needs so many votes before it is merged with others.
LEAST_VOTES = 2
#: Diagonals up to so many words apart belong to one span.
SLACK = 4
#: Least share of a template's grams in a verified span.
LEAST_COVER = 0.7

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices and texts; a label may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    *TEXTS,
]

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def gram_words(words: list[str]) -> int:
    """Words of the grams of a template: K, or the next smaller power of two for a short one."""
    return min(K, 1 << (max(1, len(words)).bit_length() - 1))


def _rolled(halves: Column, size: int) -> Column:
    """Hashes of all grams of `size` words, from those of half the size."""
    n = F.size(halves)
    pairs = F.transform(F.sequence(F.lit(0), n - size // 2 - 1), lambda i: F.xxhash64(F.get(halves, i), F.get(halves, i + size // 2)))
    return F.when(n > size // 2, pairs).otherwise(F.array().cast("array<bigint>"))


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each document: doc_id, n_words, places (phrase number and start
    of each phrase found) and spans (label, start, end, cover) of templates."""
    spark = docs.sparkSession
    known = [(label, template_words(text), True) for text, label in phrases.items()] + [(label, template_words(text), False) for label, text in templates]
    sized = [(n, label, words, phrase, gram_words(words)) for n, (label, words, phrase) in enumerate(known)]
    rows = [(n, label, phrase, len(words) - k + 1, k, t, words[t : t + k]) for n, label, words, phrase, k in sized for t in range(len(words) - k + 1)]
    sizes = [1 << i for i in range(K.bit_length())]
    # the same hashes as those of the documents, rolled up from the words
    grams = spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, k int, t int, gram array<string>").withColumn("_1", F.transform("gram", lambda w: F.xxhash64(w)))
    for k in sizes[1:]:
        grams = grams.withColumn(f"_{k}", _rolled(F.col(f"_{k // 2}"), k))
    grams = grams.withColumn("h", F.coalesce(*[F.when(F.col("k") == k, F.get(f"_{k}", F.lit(0))) for k in sizes])).drop(*[f"_{k}" for k in sizes])
    positions = F.broadcast(grams) if len(rows) <= MOST_BROADCAST else grams

    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    words = F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words.alias("words"))
    keys = ["doc_id", "text_key"]
    counted = base.select(*keys, F.size("words").cast("long").alias("n_words")).groupBy(*keys).agg(F.first("n_words").alias("n_words"), F.count("*").alias("rows"))
    rolled = base.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("_1"))
    for k in sizes[1:]:
        rolled = rolled.withColumn(f"_{k}", _rolled(F.col(f"_{k // 2}"), k))
    used = sorted({k for *_, k in sized})
    place = lambda h, i: F.struct(i.alias("d"), h.alias("h"))
    each = rolled.select(*keys, F.explode(F.concat(*[F.transform(f"_{k}", place) for k in used])).alias("at")).select(*keys, "at.*")
    # a gram's row has its hash alone; words are compared once for each document, at the places that matched
    met = each.join(positions, "h").groupBy(*keys).agg(F.collect_list(F.struct("template", "label", "phrase", "grams", "k", "t", "d", "gram")).alias("votes"))
    met = saved(met.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "votes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").where(member_filter(met, "_key", on="text_key"))
    both = texts.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(keys).select(*keys, words.alias("words"), "votes")
    sure = F.filter("votes", lambda v: F.slice("words", v["d"] + 1, v["k"]) == v["gram"])
    votes = both.select(*keys, F.inline(sure)).withColumn("diagonal", F.col("d") - F.col("t"))

    lines = votes.groupBy(*keys, "template", "label", "phrase", "grams", "k", "diagonal").agg(F.collect_set("t").alias("held"))
    strong = F.when(F.col("phrase"), F.size("held") == F.col("grams")).otherwise(F.size("held") >= F.least(F.lit(LEAST_VOTES), F.col("grams")))
    lines = lines.where(strong)
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True)) | F.col("phrase")
    islands = lines.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy(*keys, "template", "label", "phrase", "grams", "k", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.min(F.col("diagonal") + F.array_min("held")).alias("start"), F.max(F.col("diagonal") + F.array_max("held") + F.col("k")).alias("end")
    )
    spans = spans.withColumn("cover", F.size("held") / F.col("grams"))
    found = spans.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("phrase"), F.struct("start", "label")))).alias("places"),
        F.array_sort(F.collect_list(F.when(~F.col("phrase"), F.struct("start", "end", "label", "cover")))).alias("spans"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    every = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    nothing = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("places", "spans")]
    copies = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select("doc_id", "n_words", *nothing)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(documents(spark, sf_dir))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("places", lambda p: p.label)
    sure = F.transform(F.filter("spans", lambda s: s.cover >= LEAST_COVER), lambda s: s.label)
    starts = F.transform("places", lambda p: p.start.cast("long"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.cover)), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, sure)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.round(best, 6)).alias("score"),
    )
