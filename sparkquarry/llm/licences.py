"""Licence scans: fixed phrases, and licence notices by a positional index of their rarest words.

A notice is a template. Its words of highest inverse document frequency in the corpus are indexed with their positions. The
words of a file that the index has name (template, relative position) pairs; where enough weight of a template lines up, its
mandatory phrases are looked for in the file.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, lower_ascii, removed, text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract: phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Most indexed words of a template, least tenths of its greatest weight that they have, and share of their weight that must line up.
RARE, TENTHS, LEAST = 12, 4, 0.6
#: Words by which parts of a notice may be shifted against each other (up to half of it always counts as lined up).
SLACK = 8
#: Added to relative positions, so that they aren't negative: more than the words of any template.
BASE = 1 << 12
#: Bytes and rows of findings up to which they are broadcast.
ROWS, BYTES = 200_000, 16 << 20


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: What public licences ask to be put into files, or begin with, and phrases that no such notice lacks.
NOTICES = (
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistribution and use in source and binary forms",)),
    Notice("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("neither the name of", "specific prior written permission")),
    Notice("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license", "except in compliance with the license")),
    Notice("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Notice("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license as published by the free software foundation", "either version 3 of the license")),
    Notice("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Notice("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license as published by the free software foundation", "either version 2 of the license")),
    Notice("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Notice("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    Notice("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Notice("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Notice("bsl-1", "Distributed under the Boost Software License, Version 1.0. See accompanying file or copy at", ("boost software license version 1 0",)),
    Notice("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("without any express or implied warranty", "arising from the use of this software")),
    Notice("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("unencumbered software released into the public domain",)),
    Notice("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Notice("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0 international license",)),
    Notice("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    Notice("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial",)),
)


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, which are ASCII."""
    return re.findall(WORD, text.lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _listed(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """Number of rows that have each of the words; a number a word of the templates goes to the driver."""
    own = docs.select(words(text_or_empty(F.col(f"`{text_col}`"))).alias("w")).select(F.explode(F.expr(f"array_intersect(w, array({_listed(vocabulary)}))")).alias("word"))
    return {r["word"]: r["count"] for r in own.groupBy("word").count().collect()}


def index_of(notices: tuple[Notice, ...], df: dict[str, int], n: int) -> list[tuple[str, int, int, int]]:
    """Postings (word, template, position, weight) of each template's RARE words of highest weight among those that the corpus
    has, ties by word, without such as have less than TENTHS of the greatest. The weight is the inverse document frequency in
    thousandths. A template with a mandatory word that no file has is in no file, and has no postings.
    """
    out = []
    for number, notice in enumerate(notices):
        own = words_of(notice.text)
        if all(df.get(w) for p in notice.mandatory for w in words_of(p)):
            rare = sorted({w for w in own if df.get(w)}, key=lambda w: (df[w], w))[:RARE]
            weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in rare}
            most = max(weight.values(), default=0)
            out += [(w, number, at, weight[w]) for at, w in enumerate(own) if 10 * weight.get(w, -1) >= TENTHS * most]
    return out


def _places(phrase: str, number: int) -> str:
    """SQL of (start, phrase) of the places in the words ``w`` where a phrase stands; its first word that isn't frequent goes first."""
    own = words_of(phrase)
    rare = max(own, key=lambda x: (x not in ("under", "the", "by", "version", "license"), len(x)))
    same = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(own))
    starts = f"transform(filter(sequence(0, size(w) - {len(own)}), i -> {same}), i -> struct(i as start, {number} as phrase))"
    return f"if(size(w) >= {len(own)} and array_contains(w, '{rare}'), {starts}, cast(array() as array<struct<start:int,phrase:int>>))"


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, found) of each row: ``base`` the places of PHRASES as (start, phrase), ``found`` the notices of
    which LEAST of the indexed weight lines up and whose mandatory phrases the file has, as (label, share), the best of a label.

    Texts are read twice: for the document frequency of the templates' words, a few hundred numbers, and for the words of the
    index with their positions, which go to a table without texts. All their places are looked up, however many a file has;
    votes are summed by file, template and relative position, so a long file is no large group.

    Null or empty text has no words. Repeated rows and null ids give a row each; an empty table gives none; other columns are
    ignored, whatever their names. All is DataFrame functions.
    """
    spark, made = docs.sparkSession, []
    vocabulary = sorted({w for n in notices for w in words_of(n.text)})
    df = frequencies(docs, vocabulary, text_col) if vocabulary else {}
    postings = index_of(notices, df, docs.count())
    phrases = sorted({" ".join(words_of(p)) for n in notices for p in n.mandatory})
    indexed = sorted({p[0] for p in postings})
    none = "cast(array() as array<struct<word:string,pos:int>>)"
    places = f"filter(transform(w, (x, i) -> if(x in ({_listed(indexed)}), struct(x as word, i as pos), null)), x -> x is not null)"
    hits = f"if(size(array_intersect(w, array({_listed(indexed)}))) = 0, {none}, {places})" if indexed else none
    held = f"filter(array({_listed(phrases)}), p -> contains(concat(' ', array_join(w, ' '), ' '), concat(' ', p, ' ')))" if phrases else "cast(array() as array<string>)"
    base = f"array_sort(concat({', '.join(_places(p, i) for i, (p, _) in enumerate(PHRASES))}))"
    facts = F.expr(f"transform(array(w), w -> struct(size(w) as n_words, {base} as base, transform(array({hits}), h -> struct(h as hits, if(size(h) > 0, {held}, null) as phrases))[0] as h))[0]")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), words(text_or_empty(F.col(f"`{text_col}`"))).alias("w"))
    narrow = source.select(F.monotonically_increasing_id().alias("row"), "id", facts.alias("f")).select("row", "id", "f.n_words", "f.base", "f.h.*")
    narrow = written(narrow, made)

    index = spark.createDataFrame(postings, "word string, template int, at int, weight long")
    votes = narrow.select("row", "phrases", F.explode("hits").alias("h")).select("row", "phrases", "h.word", "h.pos").join(F.broadcast(index), "word")  # postings of NOTICES: a few hundred
    placed = votes.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(SLACK // 2)))).withColumn("bin", F.expr(f"(pos - at + {BASE} + shift) div {SLACK}"))
    once = placed.groupBy("row", "phrases", "template", "shift", "bin", "at").agg(F.first("weight").alias("weight"))
    sums = once.groupBy("row", "phrases", "template", "shift", "bin").agg(F.sum("weight").alias("lined"))
    totals = {}
    for _, template, _, weight in postings:
        totals[template] = totals.get(template, 0) + weight
    kinds = spark.createDataFrame([(t, notices[t].label, [" ".join(words_of(p)) for p in notices[t].mandatory], total) for t, total in totals.items() if total], "template int, label string, mandatory array<string>, total long")
    shares = sums.join(F.broadcast(kinds), "template").withColumn("share", F.col("lined") / F.col("total"))
    sure = shares.where((F.col("share") >= LEAST) & (F.size(F.array_except("mandatory", "phrases")) == 0)).groupBy("row", "label").agg(F.max("share").alias("share"))
    found = written(sure.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("found")), made)
    out = narrow.join(broadcast_small(found.select("row", "found"), ROWS, BYTES), "row", "left")
    out = written(out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "base", F.coalesce("found", F.array().cast("array<struct<label:string,share:double>>")).alias("found")), [])
    for folder in made:
        removed(spark, folder)
    return out


def licence_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of what scan() gives. The score is 1 with a fixed
    phrase, else the best share of a notice that was found, else 0."""
    names = F.array(*(F.lit(label) for _, label in PHRASES))
    base = F.transform("base", lambda b: F.element_at(names, b["phrase"] + 1))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)))
    return scanned.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("found", lambda f: f["label"]))).alias("labels"), score.alias("score"),
    )
