"""License scans of texts by an exact set-similarity join of text blocks with license notices.

A block is a line of a text. A notice is found in a block if the block has at least `THRESHOLD` of the notice's
distinct words (containment). Base phrases are looked for word by word besides; their labels always stay.

1. One pass over the texts: words, places of base phrases, and of each line its distinct words that stand in any notice
   (others cannot be shared). Lines with fewer such words than any notice needs are left out: the length filter.
2. Words are counted over these lines of all documents; rare ones come first in the global order.
3. A notice of n words needs o = ceil(THRESHOLD n) of them, so one of its n - o + 1 rarest is shared; these prefixes
   are joined with the blocks' prefixes on the word. With the shared word at place i of the notice and j of
   the block, no more than min(n - i, size - j) words can be shared; pairs that cannot reach o end there (positional filter).
4. What is left is counted exactly. A pair is kept at its first shared word only, so it comes once.

A block takes the labels of the notices it has the most of, of several such notices those of the longest. A document's score is 1 with a base phrase, else the largest
containment found in it, else 0. Everything is DataFrame functions; the notices' words (a parameter of the caller) are
literals of the plan, and only counts of those words come to the driver.

Null texts are empty: no words, no label, score 0. Each row has its own result; repeated rows have equal ones. A null
doc_id is kept. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged, whole

THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices' prefixes with up to so many words in all are broadcast.
BROADCAST_WORDS = 1_000_000
#: What stands between words, A-Z being in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrase and label.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Common license notices, label and words.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def needed(size: int, threshold: float) -> int:
    """Shared words that a notice of so many distinct words needs."""
    return max(1, math.ceil(size * threshold - 1e-9))


def _places(words: Column, n: Column, joined: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other, from 0."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), n - len(parts))
    hit = F.filter(starts, lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda j: F.get(words, i + j) == F.get(F.array(*map(F.lit, parts)), j)))
    return F.when(joined.contains(f" {phrase} "), hit).otherwise(F.array().cast("array<int>"))


def _scanned(docs: DataFrame, base: list[tuple[str, str]], vocabulary: list[str], least: int) -> DataFrame:
    """A row for each document: key, doc_id, n_words, what the base phrases give, and the blocks that may hold a notice."""
    text = whole(F.col("text"))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text), 256)
    lines = docs.select("doc_id", F.unhex(key).alias("key"), F.split(F.translate(text, UPPER, LOWER), "\n").alias("lines"))
    cut = lines.withColumn("lines", F.transform("lines", lambda x: F.filter(F.split(x, BETWEEN), lambda w: w != "")))
    known = lambda line: F.array_distinct(F.filter(line, lambda w: w.isin(vocabulary)))
    blocks = F.filter(F.transform("lines", known), lambda b: F.size(b) >= least)
    words = cut.select("doc_id", "key", F.flatten("lines").alias("words"), blocks.alias("blocks"))
    words = words.withColumn("n", F.size("words")).withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    found = [_places(F.col("words"), F.col("n"), F.col("joined"), phrase) for phrase, _ in base]
    placed = words.select("doc_id", "key", "n", "blocks", *[c.alias(f"base{i}") for i, c in enumerate(found)])
    starts = F.concat(*[F.col(f"base{i}") for i in range(len(base))]) if base else F.array().cast("array<int>")
    labels = F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(base)]) if base else F.array()
    return placed.select(
        "doc_id",
        "key",
        F.col("n").cast("bigint").alias("n_words"),
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels.cast("array<string>")))).alias("base"),
        "blocks",
    )


def _matches(scanned: DataFrame, notices: list[tuple[str, list[str]]], vocabulary: list[str], threshold: float) -> DataFrame:
    """key, block, label, containment and the notice's size of all pairs of block and notice that reach the threshold."""
    spark = scanned.sparkSession
    counted = scanned.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counted.collect()}  # no more rows than the notices have words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for number, (label, words) in enumerate(notices):
        ranked, need = sorted(words, key=place.__getitem__), needed(len(words), threshold)
        prefixes += [(word, i, number, label, ranked, need) for i, word in enumerate(ranked[: len(ranked) - need + 1])]
    index = spark.createDataFrame(prefixes, "word string, i int, notice int, label string, words array<string>, need int")
    if sum(len(p[4]) for p in prefixes) <= BROADCAST_WORDS:
        index = F.broadcast(index)  # the blocks are then not shuffled
    least = min(needed(len(words), threshold) for _, words in notices)
    blocks = scanned.select("key", F.posexplode("blocks").alias("block", "b"))
    # The intersection keeps the order of its first array, the global one.
    ordered = blocks.select("key", "block", F.array_intersect(F.array(*map(F.lit, order)), "b").alias("b"))
    prefix = F.slice("b", F.lit(1), F.size("b") - (least - 1))
    probes = ordered.select("key", "block", "b", F.posexplode(prefix).alias("j", "word"))
    reach = F.least(F.size("words") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")
    pairs = probes.join(index, "word").where((F.size("b") >= F.col("need")) & reach)
    shared = pairs.withColumn("shared", F.array_intersect("words", "b"))
    kept = shared.where((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
    return kept.select("key", "block", "label", (F.size("shared") / F.size("words")).alias("containment"), F.size("words").alias("size"))


def scan(
    docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD
) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    split = [(label, list(dict.fromkeys(words.split(" ")))) for label, words in notices]
    vocabulary = sorted({w for _, words in split for w in words})
    least = min((needed(len(words), threshold) for _, words in split), default=1)
    scanned = staged(_scanned(docs.select("doc_id", "text"), base, vocabulary, least))
    text = lambda labels: F.array_join(labels, ",")
    rows = scanned.drop("blocks")
    if split:
        found = _matches(scanned, split, vocabulary, threshold)
        held = F.struct("containment", "size")
        blocks = found.groupBy("key", "block").agg(F.max(held).alias("top"), F.collect_set(F.struct(held.alias("held"), "label")).alias("all"))
        best = F.transform(F.filter("all", lambda x: x["held"] == F.col("top")), lambda x: x["label"])
        per_text = blocks.select("key", "top.containment", F.explode(best).alias("label")).groupBy("key").agg(F.max("containment").alias("top"), F.collect_set("label").alias("more"))
        rows = rows.join(per_text, "key", "left")
    else:
        rows = rows.withColumns({"top": F.lit(None).cast("double"), "more": F.lit(None).cast("array<string>")})
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("top", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(labels).alias("labels"), score.alias("score"))
