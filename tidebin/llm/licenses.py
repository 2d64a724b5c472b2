"""License scan: an exact set-similarity join of text blocks with license templates.

DataFrame functions only. A text is cut into overlapping windows of words; a window
matches a template if it holds at least `threshold` of the template's distinct words. The
template words are put in the order of the documents that hold them, rarest first. Two
word sets with enough in common share a word of their prefixes in that order, so windows
and templates are joined on prefix words alone; length and position bounds drop more
pairs before whole sets are compared. Texts that hold no prefix word are not cut at all.

The templates are a parameter; their index is broadcast up to BROADCAST_ROWS rows, and
joined by a shuffle beyond.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.85
WINDOW, STEP = 96, 48
#: Index rows (template and prefix word) up to which the index is broadcast.
BROADCAST_ROWS = 20_000

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by which licenses are recognised (fixed values, public texts).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def words(low: Column) -> Column:
    return F.filter(F.split(low, GAP), lambda w: w != "")


def any_of(low: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts], F.lit(False))


def places(found: Column, phrases: Mapping[str, str]) -> Column:
    """Array of (at, label): where the words of a phrase stand one after the other."""

    def of(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        last = F.size(found) - len(parts)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        here = F.filter(starts, lambda i: reduce(lambda a, b: a & b, [F.get(found, i + k) == w for k, w in enumerate(parts)]))
        return F.transform(here, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(p, label) for p, label in phrases.items()])


def phrase_places(df: DataFrame, text: str, keep: Sequence[str], phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """`keep` columns, `n_words` and `places`, for every row; null texts are empty.

    Only texts that hold the longest word of a phrase are cut into words.
    """
    rows = df.select(*keep, lowered(text).alias("__low"))
    marks = sorted({max(p.split(" "), key=len) for p in phrases})
    rows = rows.select(*keep, F.regexp_count("__low", F.lit(WORD)).cast("long").alias("n_words"), F.when(any_of(F.col("__low"), marks), words(F.col("__low"))).alias("__words"))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return rows.select(*keep, "n_words", F.when(F.col("__words").isNotNull(), places(F.col("__words"), phrases)).otherwise(none).alias("places"))


def word_order(df: DataFrame, text: str, vocabulary: Sequence[str]) -> list[str]:
    """The template words by the number of documents that hold them, rarest first, then by word."""
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(lowered(text), GAP))
    counted = df.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    times = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (times.get(w, 0), w))


def matches(
    df: DataFrame, doc_id: str, text: str, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), threshold: float = THRESHOLD
) -> DataFrame:
    """`doc_id`, `first_word`, `end_word`, `label`, `containment`: every window of WINDOW
    words, one each STEP words, that reaches the threshold for a template.

    Null and empty texts have no window with words. Repeated rows give repeated rows; ids
    may be null; other columns play no part. Templates must have a word.
    """
    sets = [sorted(set(t.split())) for _, t in templates]
    order = word_order(df, text, sorted(set().union(*sets)))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, ((label, _), found) in enumerate(zip(templates, sets)):
        need = math.ceil(threshold * len(found) - 1e-9)
        ordered = sorted(found, key=rank.get)
        index += [(number, label, w, i, need, ordered) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    least = min(row[4] for row in index)
    prefixes = df.sparkSession.createDataFrame(index, "template int, label string, word string, t_at int, need int, t_words array<string>")
    if len(index) <= BROADCAST_ROWS:
        prefixes = F.broadcast(prefixes)
    rows = df.select(F.col(doc_id).alias("doc_id"), lowered(text).alias("low")).filter(any_of(F.col("low"), sorted({r[2] for r in index})))
    rows = rows.select("doc_id", words(F.col("low")).alias("words")).filter(F.size("words") > 0)
    known = F.array(*map(F.lit, order))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(STEP))
    windows = rows.select("doc_id", F.size("words").alias("n"), "words", F.explode(starts).alias("first"))
    windows = windows.select("doc_id", "n", "first", F.array_intersect(known, F.slice("words", F.col("first") + 1, WINDOW)).alias("held"))
    windows = windows.filter(F.size("held") >= least)
    entries = windows.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("b_at", "word"))
    bound = F.least("b_at", "t_at") + F.least(F.size("held") - F.col("b_at"), F.size("t_words") - F.col("t_at"))
    near = entries.join(prefixes, "word").filter((F.size("held") >= F.col("need")) & (bound >= F.col("need")))
    common = F.array_intersect("t_words", "held")
    # a pair is kept at the first prefix word that it shares
    exact = near.filter((F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("word")))
    return exact.select(
        "doc_id",
        F.col("first").cast("long").alias("first_word"),
        F.least("n", F.col("first") + WINDOW).cast("long").alias("end_word"),
        "template",
        "label",
        (F.size(common) / F.size("t_words")).alias("containment"),
    )
