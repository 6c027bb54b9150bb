"""License scans by an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A block is a sentence: what lies between full stops, question or exclamation marks before white space, or empty lines.
A template meets a block if the block has at least ``THRESHOLD`` of the template's distinct words. The join finds all
such pairs and checks few others:

1. Blocks keep only words that some template has, as no others can be shared (these are bounded by the templates).
2. The blocks' words are counted over all blocks, and all sets are put in one order, rarest words first.
3. Prefix filter: a template of n words of which need must be found has one of its n - need + 1 rarest in each block
   that meets it. Only these words are joined with the blocks'.
4. Length filter: the block must have need words. Positional filter: at the first common word, what is left of either
   set must hold the rest of need.
5. Pairs that are left are verified exactly, at their first common word, so each is found once.

Besides, the places of base phrases are found in the sequence of all words.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CUT = r"[.!?][ \t\r\n]|\n[ \t\r]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The part of a template's words that a block must have. Notices of under ten words must be there whole, as those of
#: different licenses differ in one word.
THRESHOLD = 0.9
#: Labels of phrases whose words must stand side by side (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of usual notices, by label (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Words of all templates, which the plan holds as one constant array.
MOST_WORDS = 5000


def words_in(template: str) -> list[str]:
    """Distinct words of a template, as of a text."""
    low = template.translate(str.maketrans(UPPER, LOWER))
    return sorted(set(re.findall(WORD, low)))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase begin to stand consecutively, from 0."""
    sought = phrase.split()

    def here(i: Column) -> Column:
        # The last word first, as it is the rarest where phrases end with "license".
        hits = [F.get(words, i + k) == w for k, w in reversed(list(enumerate(sought)))]
        all_hit = hits[0]
        for hit in hits[1:]:
            all_hit = all_hit & hit
        return F.coalesce(all_hit, F.lit(False))

    spots = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(sought), F.lit(0))), here)
    return F.when(F.array_contains(words, sought[-1]), spots).otherwise(F.array().cast("array<int>"))


def _constant(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def template_pairs(blocks: DataFrame, templates: list[tuple[str, str]] | tuple, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, block, template, label, containment) of all pairs that meet. ``blocks`` (uid, block, words) is read
    twice; its words are distinct in each block and all of templates'."""
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the templates
    sets = [words_in(t) for _, t in templates]
    order = sorted({w for s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    prefixes = []
    for number, ((label, _), words) in enumerate(zip(templates, sets)):
        ranks, need = sorted(rank[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
        prefixes += [(r, i, number, label, ranks, need) for i, r in enumerate(ranks[: len(ranks) - need + 1])] if words else []
    kinds = "rank int, i int, template int, label string, ranks array<int>, need int"
    entries = F.from_json(F.lit(json.dumps([dict(zip(("rank", "i", "template", "label", "ranks", "need"), p)) for p in prefixes])), f"array<struct<{kinds}>>")
    prefix = blocks.sparkSession.range(1).select(F.inline(entries))
    ranked = blocks.select("uid", "block", F.array_sort(F.transform("words", lambda w: F.array_position(_constant(order), w).cast("int"))).alias("own"))
    least = min((p[5] for p in prefixes), default=1)
    tokens = ranked.filter(F.size("own") >= least).select("uid", "block", "own", F.posexplode("own").alias("j", "rank"))
    met = tokens.join(F.broadcast(prefix), "rank")  # bounded by the templates
    left = 1 + F.least(F.size("ranks") - F.col("i") - 1, F.size("own") - F.col("j") - 1)
    met = met.filter((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    common = F.array_intersect("own", "ranks")
    met = met.withColumn("common", common).filter((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("rank")))
    return met.select("uid", "block", "template", "label", (F.size("common") / F.size("ranks")).alias("containment"))


def license_scan(df: DataFrame, text: str = "text", row_id: str = "doc_id", templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """What ``df`` says of licenses: (uid, id, n_words, starts, base) of each row, and the pairs of ``template_pairs``.

    starts has the places of all phrases, base their labels, once each and sorted. Null texts are empty ones: they
    have no words, phrases or blocks. Very long texts are read whole; a sentence of any length is one block, of at most
    as many words as the templates have. Equal rows are found each by itself, ids may be null, and other columns are
    ignored. An empty table gives no rows, and without templates there are no pairs.
    """
    phrases = PHRASES if phrases is None else phrases
    vocabulary = sorted({w for _, t in templates for w in words_in(t)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} words; at most {MOST_WORDS} are taken")
    rows = df.select(F.col(row_id).alias("id"), lowered(F.col(text)).alias("low"))
    rows = rows.withColumn("words", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    found = F.array(*[F.struct(F.lit(label).alias("label"), places(F.col("words"), phrase).alias("at")) for phrase, label in phrases.items()]) if phrases else F.array().cast("array<struct<label:string,at:array<int>>>")
    shared = F.transform(F.split("low", CUT, -1), lambda b: F.array_intersect(F.regexp_extract_all(b, F.lit(WORD), F.lit(0)), _constant(vocabulary)))
    facts = rows.select("id", F.size("words").cast("long").alias("n_words"), found.alias("found"), F.filter(shared, lambda b: F.size(b) > 0).alias("blocks"))
    starts = F.flatten(F.transform("found", lambda f: f["at"]))
    base = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda f: F.size(f["at"]) > 0), lambda f: f["label"])))
    facts = shared_table(facts.select(F.monotonically_increasing_id().alias("uid"), "id", "n_words", starts.alias("starts"), base.alias("base"), "blocks"), "blocks")
    blocks = facts.select("uid", F.posexplode("blocks").alias("block", "words"))
    return facts.drop("blocks"), template_pairs(blocks, templates, threshold)


def license_report(df: DataFrame, text: str = "text", row_id: str = "doc_id", templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    score is the greatest containment of a template in a block of the text; 1 where a base phrase stands, 0 where
    nothing was found. Labels are sorted and joined by commas, "" where there are none. See ``license_scan``.
    """
    facts, pairs = license_scan(df, text, row_id, templates, phrases, threshold)
    best = pairs.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    out = facts.join(best, "uid", "left")
    none = F.array().cast("array<string>")
    some = F.size("starts") > 0
    return out.select(
        F.col("id").alias(row_id), "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(some, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
