"""License scan by diagonal voting.

All word pairs of all texts are hashed and joined with the places of the same pairs in the templates: grams of two
words in short notices, where one inserted word must not cost much, and of three in phrases and long
passages. Each hit is verified on its gram's words when it is joined, so hash collisions never vote. A hit votes for the
diagonal ``word - place in the template``; neighbouring diagonals of one template are merged, which bridges inserted and
dropped words. A diagonal or a merged span counts if enough of the template's grams voted and its telling words, those
that tell licenses apart, are the template's in the template's order; so ``lesser`` between two hits is never the plain
license, and a number is never another version's.

Only DataFrame functions are used. The templates are a fixed list, so they are broadcast; texts never leave
their task, only their hits do, with one row for each text. Hits are written once, so texts are read once and
a row's number is the same for its head and its hits whatever becomes of an executor.

Defined cases: a null or empty text, or one without words, has no words, no places and score 0; repeated rows are
scanned each; an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

KEY = 2                          # words of a gram that are hashed
GRAM = 3
#: Templates of at most so many words are notices, with grams of two words.
NOTICE = 10
#: Words that may be inserted or dropped between neighbouring diagonals.
SLACK = 4
#: Share of a template's grams that must vote: one word put into the shortest notice leaves three of four.
ENOUGH = 0.6
HEAD = -1
BUCKET = 64                      # words, for meeting spans and telling words by equality
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"

# The phrases of the base labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Words that tell licenses apart; a template without any is told by its grams alone.
TELLING = ("affero apache attribution bsd cc cc0 commons creative gnu lesser library mit mozilla nc nd noderivatives "
           "noncommercial not sa sharealike 0 1 2 3 4").split()
# Passages of public licenses and of the notices that refer to them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the "
                 "license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "released under cc0 1 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("all-rights-reserved", "all rights reserved"),
]


def lower_words(text: Column) -> Column:
    """Lower-case words. ``lower`` turns one character outside ASCII, the Kelvin sign, into an ASCII letter."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ª"))), F.lit(WORDS), F.lit(0))


def _keys(words: str) -> Column:
    """A hash for each pair of neighbours in an array of word hashes; none for fewer words."""
    hashes = F.col(words)
    return F.when(F.size(hashes) >= KEY, F.transform(F.sequence(F.lit(0), F.size(hashes) - KEY), lambda i: F.xxhash64(
        *(F.get(hashes, i + k) for k in range(KEY))))).otherwise(F.array().cast("array<bigint>"))


def telling_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in text.split() if w in TELLING))


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each gram of each template, and one head row that meets the head of every text."""
    listed = [(n, label, True, text) for n, (label, text) in enumerate(phrases)]
    listed += [(len(phrases) + n, label, False, text) for n, (label, text) in enumerate(templates)]
    if any(not GRAM <= len(text.split()) < 64 for *_, text in listed):
        raise ValueError(f"a template has {GRAM} to 63 words")
    strings = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(
        F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"),
        F.lit(KEY if len(text.split()) in range(GRAM + 1, NOTICE + 1) and not base else GRAM).alias("gram_words"),
        strings(telling_words(text)).alias("telling"), strings(text.split()).alias("words"))
        for n, label, base, text in listed))).alias("t")).select("t.*")
    rows = rows.withColumn("n_grams", F.size("words") - F.col("gram_words") + 1).withColumn(
        "hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = rows.select("*", F.posexplode(_keys("hashes")).alias("place", "hash")).where("place < n_grams").select(
        "template", "label", "base", "telling", "n_grams", "place", "hash",
        F.slice("words", F.col("place") + 1, F.col("gram_words")).alias("gram"))
    head = spark.range(1).select(
        F.lit(HEAD).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"),
        F.lit(None).cast("array<string>").alias("telling"), F.lit(0).alias("n_grams"), F.lit(0).alias("place"),
        F.lit(HEAD).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("gram"))
    return grams.union(head)


def hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Verified gram hits, and a head row (``template`` -1) of every text with the places of its telling words."""
    texts = docs.select("doc_id", lower_words(text_or_empty()).alias("words"),
                        F.monotonically_increasing_id().alias("row"))
    hashed = texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    spread = hashed.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.posexplode(
        F.concat(F.array(F.lit(HEAD).cast("long")), _keys("hashes"))).alias("at", "hash"))
    known = F.broadcast(template_grams(docs.sparkSession, phrases, templates))
    # at counts the head row as 0, so it is also the 1-based place of the gram
    real = ((F.col("at") == 0) & (F.col("template") == HEAD)) | (
        (F.col("at") > 0) & (F.slice("words", F.col("at"), F.size("gram")) == F.col("gram")))
    placed = F.filter(F.transform("words", lambda w, i: F.when(w.isin(TELLING), F.struct(
        i.alias("word"), w.alias("said")))), lambda t: t.isNotNull())
    return spread.join(known, "hash").where(real).select(
        "row", "doc_id", "n_words", "template", "label", "base", "telling", "n_grams", "place",
        (F.col("at") - 1).alias("word"), (F.col("at") - 2 + F.size("gram")).alias("last"),
        F.when(F.col("at") == 0, placed).alias("said"))


def spans(found: DataFrame, slack: int = SLACK) -> DataFrame:
    """Diagonals, and merged spans of several; ``covered`` is the share of the template's grams that voted.

    Phrases of the base labels stay on their own diagonal; for them a span is a place when all voted.
    """
    keys = ["row", "template", "label", "base", "telling", "n_grams"]
    diagonals = found.where(F.col("template") != HEAD).groupBy(
        *keys, (F.col("word") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("votes"),
        F.min("word").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= slack, 0).otherwise(1)
    chained = diagonals.withColumn("apart", apart).withColumn("chain", F.sum("apart").over(order))
    # a row for the diagonal itself (chain null) and one for its chain
    both = chained.select("*", F.explode(F.when(F.col("base"), F.array(F.lit(False))).otherwise(
        F.array(F.lit(False), F.lit(True)))).alias("merged"))
    merged = both.groupBy(*keys, "merged", F.when(F.col("merged"), F.col("chain")).otherwise(
        F.col("diagonal")).alias("span")).agg(
        F.bit_or("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.select("row", "template", "label", "base", "telling", "merged", "span", "first", "last",
                         (F.bit_count("votes") / F.col("n_grams")).alias("covered"))


def verified(found: DataFrame, judged: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """``row, label`` of the covered spans whose telling words are their template's, in its order."""
    covered = judged.where(~F.col("base") & (F.col("covered") >= enough))
    plain = covered.where(F.size("telling") == 0).select("row", "label")
    asked = covered.where(F.size("telling") > 0).select("*", F.explode(F.sequence(
        F.floor(F.col("first") / BUCKET), F.floor(F.col("last") / BUCKET))).alias("bucket"))
    said = found.where(F.col("template") == HEAD).select(F.col("row"), F.explode("said").alias("s")).select(
        "row", "s.*", F.floor(F.col("s.word") / BUCKET).alias("bucket"))
    within = asked.join(said, ["row", "bucket"]).where(F.col("word").between(F.col("first"), F.col("last")))
    words = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("word", "said"))), lambda s: s["said"]))
    told = within.groupBy("row", "template", "label", "telling", "merged", "span").agg(words.alias("words"))
    return plain.union(told.where(F.col("words") == F.col("telling")).select("row", "label"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, enough: float = ENOUGH) -> DataFrame:
    """Counts, places and labels of every row; ``score`` is the best cover of any template."""
    found = stage(hits(docs, phrases, templates), "license-hits")
    heads = found.where(F.col("template") == HEAD).select("row", "doc_id", "n_words")
    judged = stage(spans(found), "license-spans")
    place = F.col("base") & (F.col("covered") == 1)
    counts = judged.groupBy("row").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("first"))).alias("last_word"),
        F.collect_set(F.when(place, F.col("label"))).alias("base_labels"),
        F.max(F.when(place | ~F.col("base"), F.col("covered"))).alias("score"))
    own = verified(found, judged, enough).groupBy("row").agg(F.collect_set("label").alias("own"))
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    base, both = F.coalesce("base_labels", none), F.array_union(F.coalesce("base_labels", none), F.coalesce("own", none))
    return heads.join(counts, "row", "left").join(own, "row", "left").select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined(base).alias("base_labels"), joined(both).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
