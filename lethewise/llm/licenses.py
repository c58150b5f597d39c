"""Licence notices by a positional index of rare words, with DataFrame functions alone.

Each notice is a template: its words, and phrases that must stand in it. Of every template the ``INDEXED`` words with the
highest inverse document frequency in the scanned table are posted with their positions, and of every base phrase the
rarest word. Of the posted words that a text holds, the ``LOOKED_UP`` of highest inverse document frequency of each template are
looked up; one at place i that stands at q in a template votes for the template to begin at i - q. Where
``MIN_VOTES`` places agree, the mandatory phrases are verified at their own places (up to ``SHIFT`` words off, as a year
or a name may have been put in), and the share of the template's words that stand at theirs is measured. Base phrases are
templates of their own words, verified without a shift: every place is found, as their rarest word is always looked up.

Words are lower-cased in A-Z and consist of ASCII letters, digits and characters beyond ASCII, so comment marks and
line ends do not matter. The score is the largest share of a template's words in place, of verified templates; ``PHRASE_SCORE``
at least where a base phrase stands; else 0.

The table is read twice: once for document frequencies (one row for each word of the templates, some hundreds whatever
the table) and once for the search, which is a projection of each row by itself, without a shuffle or a join.

Defined results: a null or empty text has no words and no labels; a text counts whole, however long; repeated rows each
get a row; an empty table gives no rows; words of equal frequency rank in their own order. Columns of the input are kept
(those named as in ``ADDED``, in any case of letters, give way).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

INDEXED, LOOKED_UP, MIN_VOTES, SHIFT, PHRASE_SCORE = 12, 8, 3, 3, 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ["n_words", "licence_spans", "base_labels", "labels", "licence_score"]

#: Phrases that are a licence's name.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, words of the licence's own notice, phrases that must stand in it.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted", "this permission notice appear in all copies"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms", "this list of conditions and the following disclaimer"]),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["licensed under the apache license", "except in compliance with the license"]),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ["distributed on an as is basis without warranties or conditions of any kind"]),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["under the terms of the gnu general public license", "published by the free software foundation"]),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version", ["gnu lesser general public license", "published by the free software foundation"]),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu affero general public license", "published by the free software foundation"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", ["free and unencumbered software released into the public domain"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["in no event will the authors be held liable for any damages", "to alter it and redistribute it freely"]),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ["obtaining a copy of the software and accompanying documentation covered by this license"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ["creative commons attribution noderivatives"]),
]


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class Template:
    """The words of a template, its phrases with their places, and how far off those may stand."""

    def __init__(self, label: str, text: str, phrases: list[str], base: bool = False):
        self.label, self.words, self.base, self.shift = label, _plain(text), base, 0 if base else SHIFT
        self.phrases = []
        for p in map(_plain, phrases):
            at = [i for i in range(len(self.words)) if self.words[i : i + len(p)] == p]
            if not at:
                raise ValueError(f"{' '.join(p)!r} is no part of the template {label}")
            self.phrases.append((at[0], p))

    def posted(self, rank: dict[str, int]) -> list[str]:
        """The words that are posted: the first in ``rank``, one of a base phrase."""
        return sorted(set(self.words), key=rank.__getitem__)[: 1 if self.base else INDEXED]


def templates() -> list[Template]:
    return [Template(label, phrase, [phrase], base=True) for phrase, label in BASE.items()] + [Template(*t) for t in TEMPLATES]


def text_words(text: Column) -> Column:
    """The words of a text; only A-Z are lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)


def word_ranks(docs: DataFrame, known: list[Template], text: str = "text") -> dict[str, int]:
    """The templates' words by falling inverse document frequency in ``docs``, then in their own order. As many rows come
    to the driver as the templates have words."""
    words = sorted({w for t in known for w in t.words})
    held = docs.select(F.explode(F.array_intersect(F.lit(words), text_words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = dict(held.collect())
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (n.get(w, 0), w)))}


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def scan(docs: DataFrame, text: str = "text", known: list[Template] | None = None) -> DataFrame:
    """``docs`` with n_words, ``licence_spans`` (label, start, end, share, base), ``base_labels`` and ``labels`` (distinct,
    sorted) and ``licence_score``."""
    known = templates() if known is None else known
    rank = word_ranks(docs, known, text)
    return storage.apart(docs, ADDED, lambda rows: _scanned(rows, known, rank), text=text)


def _scanned(docs: DataFrame, known: list[Template], rank: dict[str, int]) -> DataFrame:
    own = docs.columns
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(known):
        for w in template.posted(rank):
            postings.setdefault(w, []).extend((t, q) for q, x in enumerate(template.words) if x == w)
    indexed = sorted(postings, key=rank.__getitem__)
    table = F.create_map(*[c for w in indexed for c in (F.lit(w), F.array(*[_struct(t=F.lit(t), q=F.lit(q)) for t, q in postings[w]]))])
    need = F.lit([min(MIN_VOTES, len(t.posted(rank))) for t in known])
    shift = F.lit([t.shift for t in known])
    whole = F.lit([t.words for t in known])
    labels = F.lit([t.label for t in known])
    base = F.lit([t.base for t in known])
    phrases = F.array(*[F.array(*[_struct(q=F.lit(q), words=F.lit(p)) for q, p in t.phrases]) for t in known])

    rows = docs.withColumn("_w", text_words(F.col("text")))
    held = F.array_intersect(F.lit(indexed), F.col("_w"))  # in the order of the first
    rows = rows.withColumn("_held", held)
    highest = [F.slice(F.array_intersect("_held", F.lit(t.posted(rank))), 1, LOOKED_UP) for t in known]
    rows = rows.withColumn("_top", F.when(F.size("_held") > 0, F.array_distinct(F.concat(*highest))))
    hits = F.filter(F.transform("_w", lambda w, i: _struct(w=w, i=i)), lambda s: F.array_contains("_top", s["w"]))
    rows = rows.withColumn("_hits", F.when(F.col("_top").isNotNull(), hits))
    votes = F.sort_array(F.flatten(F.transform("_hits", lambda h: F.transform(table[h["w"]], lambda p: _struct(t=p["t"], o=h["i"] - p["q"])))))
    rows = rows.withColumn("_votes", votes)

    def agreed(s: Column, k: Column) -> Column:
        """The first of equal votes, of which there are enough."""
        v = F.col("_votes")
        return (F.get(v, k + F.get(need, s["t"]) - 1) == s) & ~F.coalesce(F.get(v, k - 1) == s, F.lit(False))

    rows = rows.withColumn("_met", F.filter("_votes", agreed))

    def stands(s: Column, phrase: Column) -> Column:
        def at(off: Column) -> Column:
            start = s["o"] + phrase["q"] + off + 1
            return F.when(start > 0, F.slice("_w", F.greatest(start, F.lit(1)), F.size(phrase["words"])) == phrase["words"]).otherwise(False)

        return F.exists(F.sequence(-F.get(shift, s["t"]), F.get(shift, s["t"])), at)

    verified = F.filter("_met", lambda s: F.forall(F.get(phrases, s["t"]), lambda p: stands(s, p)))
    rows = rows.withColumn("_found", verified)

    def span(s: Column) -> Column:
        words = F.get(whole, s["t"])
        in_place = F.size(F.filter(F.transform(words, lambda w, q: F.coalesce(F.get("_w", s["o"] + q) == w, F.lit(False))), lambda same: same))
        return _struct(label=F.get(labels, s["t"]), start=F.greatest(s["o"], F.lit(0)).cast("long"), end=F.least(s["o"] + F.size(words), F.size("_w")).cast("long"), share=in_place / F.size(words), base=F.get(base, s["t"]))

    rows = rows.withColumn("_spans", F.coalesce(F.transform("_found", span), F.array().cast("array<struct<label:string,start:bigint,end:bigint,share:double,base:boolean>>")))

    def listed(spans: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))

    bases = F.filter("_spans", lambda s: s["base"])
    best = F.array_max(F.transform("_spans", lambda s: F.when(s["base"], F.lit(PHRASE_SCORE)).otherwise(s["share"])))
    return rows.select(*own, F.size("_w").cast("long").alias("n_words"), F.col("_spans").alias("licence_spans"), listed(bases).alias("base_labels"), listed(F.col("_spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("licence_score"))
