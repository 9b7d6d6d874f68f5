"""License scan by a positional index of rare words, in DataFrame functions alone.

Words are maximal runs of digits, letters and non-ASCII characters, with A-Z lower-cased. Base
labels are those of phrases that stand in the text word by word. The index adds labels of its own:

1. The document frequency of every template word is counted over all documents. Each template is
   indexed by its rarest words (the half of its distinct words with the highest IDF, `INDEXED` at
   most); a posting is a template and the position of the word in it.
2. A text looks up, for each template, its `LOOKUPS` words of highest IDF that the index has. All
   their occurrences in the text meet their postings, and each meeting votes for the place where
   the template would begin (position in the text less position in the template). Places are kept
   in two overlapping grids of `DRIFT` words, so a few inserted or missing words do no harm.
3. A place with votes from at least `SHARE` of the postings of the template's `LOOKUPS` rarest words
   is verified: all mandatory phrases of the template must stand within the span it would cover.

The score is the largest share of a verified place, at least `BASE_SCORE` if a base phrase occurs,
and 0 where nothing is found. All of it is decided within a row: only the counts of the template
words are shuffled and reach the driver (bounded by the templates).

Null and empty texts have no words: counts are 0, first_word and last_word null, labels empty.
Repeated rows and rows of one id are each judged by their own text. Words of equal IDF are taken in
alphabetical order. Columns with the names of the results are replaced, all others stay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import free_names
from gridloom.llm.text_columns import joined_words, split_words, strings

INDEXED, LOOKUPS, SHARE, DRIFT, SLACK, BASE_SCORE = 16, 8, 0.6, 8, 8, 0.5
#: Bits of a vote: position in the template, grid cell.
POSITION_BITS, CELL_BITS = 10, 36

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases without which the text is not this license.
    mandatory: tuple[str, ...]


#: Notices as the licenses' publishers word them, and what no such notice lacks.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    Template("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products derived from this software",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("apache license version 2 0", "in compliance with the license")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", ("gnu general public license as published by the free software foundation",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license",)),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software released into the public domain",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", ("boost software license version 1 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", ("creative commons attribution sharealike",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal, http://creativecommons.org/publicdomain/zero/1.0/", ("waived all copyright and related or neighboring rights",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("mit", "Released under the MIT License", ("released under the mit license",)),
)


def template_words(text: str) -> list[str]:
    """The words of a template, as `text_columns` has them for texts."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text)
    return [w for w in folded.split(" ") if w]


class Index(NamedTuple):
    """For each template its indexed words, rarest first, and the number of postings that count as whole."""

    rare: list[list[str]]
    whole: list[int]


def build_index(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> Index:
    """The index of the templates' rarest words by their document frequency in docs."""
    own = [template_words(t.text) for t in templates]
    vocabulary = sorted({w for ws in own for w in ws})
    joined = free_names(docs, "joined")[0]
    one = docs.select(joined_words(docs[f"`{text_col}`"]).alias(joined)).select(F.explode(F.array_intersect(strings(vocabulary), split_words(F.col(joined)))).alias("word"))
    df = {r.word: r.n for r in one.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    rare, whole = [], []
    for ws in own:
        ranked = sorted(set(ws), key=lambda w: (df.get(w, 0), w))
        ranked = ranked[: min(INDEXED, max(min(len(ranked), 3), math.ceil(len(ranked) / 2)))]
        rare.append(ranked)
        whole.append(sum(w in ranked[:LOOKUPS] for w in ws))
    return Index(rare, whole)


def scan(docs: DataFrame, index: Index | None = None, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and `licenses`: the
    verified places (label, first word of the place, share), one for each template and grid cell."""
    index = index or build_index(docs, text_col, templates)
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses"]
    rest = [c for c in docs.columns if c.lower() not in new]
    joined, words, bases, looked, votes, places = free_names(docs, "joined", "words", "bases", "looked", "votes", "places")
    col = F.col
    keep = [f"`{c}`" for c in rest]
    kept = [docs[f"`{c}`"] for c in rest]

    out = docs.select(*kept, joined_words(docs[f"`{text_col}`"]).alias(joined))
    out = out.select(*keep, joined, split_words(col(joined)).alias(words))

    # base phrases: for each phrase the words where it starts
    padded = F.concat(F.lit(" "), col(joined), F.lit(" "))
    none = F.array().cast("array<int>")

    def starts(phrase: str) -> Column:
        own = phrase.split(" ")

        def here(i: Column) -> Column:
            out = F.get(col(words), i) == own[0]
            for k, w in enumerate(own[1:], 1):
                out &= F.get(col(words), i + k) == w
            return out

        return F.when(padded.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.size(words) - len(own)), here)).otherwise(none)

    # for each template the rarest of its indexed words that the text has
    vocabulary = sorted({w for ws in index.rare for w in ws})
    present = F.array_intersect(strings(vocabulary), col(words))
    found = F.array(*[F.slice(F.array_intersect(strings(ws), col(looked)), 1, LOOKUPS) for ws in index.rare])
    enough = [max(min(2, len(ws)), math.ceil(SHARE * min(LOOKUPS, len(ws)))) for ws in index.rare]
    out = out.select(*keep, words, F.array(*[starts(p) for p in phrases]).alias(bases), present.alias(looked))
    out = out.select(*keep, words, bases, F.transform(found, lambda ws, t: F.when(F.size(ws) >= F.get(F.array(*[F.lit(n) for n in enough]), t), ws).otherwise(F.array().cast("array<string>"))).alias(looked))

    # votes: (template, grid cell, position in the template), distinct and sorted
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (template, ws) in enumerate(zip(templates, index.rare, strict=True)):
        for p, w in enumerate(template_words(template.text)):
            if w in ws:
                postings.setdefault(w, []).append((t, p))
    table = F.from_json(F.lit("{" + ",".join(f'"{w}":[{",".join(f"[{t},{p}]" for t, p in at)}]' for w, at in sorted(postings.items())) + "}"), "map<string,array<array<bigint>>>")
    longest = max((len(template_words(t.text)) for t in templates), default=0)
    cell, wide = 1 << POSITION_BITS, 1 << CELL_BITS

    def code(t: Column, grid: int, place: Column, p: Column) -> Column:
        return ((t * 2 + grid) * wide + F.floor((place + longest + grid * (DRIFT // 2)) / DRIFT).cast("bigint")) * cell + p

    def vote(hit: Column) -> Column:
        own = F.filter(F.element_at(table, hit["w"]), lambda x: F.array_contains(F.get(col(looked), F.get(x, 0)), hit["w"]))
        at = lambda g: F.transform(own, lambda x: code(F.get(x, 0), g, hit["i"] - F.get(x, 1), F.get(x, 1)))
        return F.concat(at(0), at(1))

    wanted = F.array_distinct(F.flatten(col(looked)))
    hits = F.filter(F.transform(col(words), lambda w, i: F.struct(i.cast("bigint").alias("i"), w.alias("w"))), lambda x: F.array_contains(wanted, x["w"]))
    all_votes = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, vote))))
    out = out.select(*keep, words, bases, F.when(F.size(wanted) > 0, all_votes).otherwise(F.array().cast("array<bigint>")).alias(votes))

    # places: runs of votes of one template and cell
    key = lambda i: F.floor(F.get(col(votes), i) / cell)
    n = F.size(votes)
    begins = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (key(i) != key(i - 1)))).otherwise(none)
    out = out.select(*keep, words, bases, votes, begins.alias(looked))
    whole = F.array(*[F.lit(float(n)) for n in index.whole])
    run = F.transform(col(looked), lambda i, k: F.struct(F.floor(key(i) / (2 * wide)).cast("int").alias("t"), (F.pmod(key(i), F.lit(wide)) * DRIFT - longest - F.when(F.pmod(F.floor(key(i) / wide), F.lit(2)) == 1, DRIFT // 2).otherwise(0)).cast("int").alias("at"), (F.coalesce(F.get(col(looked), k + 1), n) - i).alias("votes")))
    shares = F.transform(run, lambda r: F.struct(r["t"].alias("t"), r["at"].alias("at"), F.least(F.lit(1.0), r["votes"] / F.get(whole, r["t"])).alias("share")))
    out = out.select(*keep, words, bases, F.filter(shares, lambda r: r["share"] >= SHARE).alias(places))

    # mandatory phrases within the span of the place
    needed = F.array(*[F.array(*[F.lit(f" {p} ") for p in t.mandatory]) for t in templates])
    length = F.array(*[F.lit(len(template_words(t.text))) for t in templates])
    names = F.array(*[F.lit(t.label) for t in templates])

    def verified(r: Column) -> Column:
        first = F.greatest(F.lit(0), r["at"] - SLACK)
        span = F.concat(F.lit(" "), F.array_join(F.slice(col(words), first + 1, F.get(length, r["t"]) + DRIFT + 2 * SLACK), " "), F.lit(" "))
        return F.forall(F.get(needed, r["t"]), lambda p: F.contains(span, p))

    found_at = F.transform(F.filter(col(places), verified), lambda r: F.struct(F.get(names, r["t"]).alias("label"), F.greatest(F.lit(0), r["at"]).cast("bigint").alias("first_word"), r["share"].alias("share")))
    out = out.select(*keep, words, bases, found_at.alias(places))
    all_at = F.flatten(col(bases))
    base = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(F.size(F.get(col(bases), k)) > 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>")) for k, v in enumerate(phrases.values())]))))
    score = F.greatest(F.coalesce(F.array_max(col(places)["share"]), F.lit(0.0)), F.when(F.size(all_at) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return out.select(
        *keep, F.size(words).cast("bigint").alias("n_words"), F.size(all_at).cast("bigint").alias("n_base"), F.array_min(all_at).cast("bigint").alias("first_word"), F.array_max(all_at).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, col(places)["label"])), ",").alias("labels"), score.alias("score"), F.col(places).alias("licenses"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
