"""Licence scanning with a positional rare-token index, DataFrame functions only.

A template is a sequence of words. Its licence words (all but ``COMMON`` ones) are
posted with their relative positions. One pass over the texts notes which licence
words each file holds; their document counts over all files give the IDF. Of each
template the words of highest IDF are its anchors, as many as no place with
``min_mass`` of the template's IDF mass can miss together. The inverted index lists, for an
anchor word, the templates and relative positions it stands at. A file looks up
its occurrences of those words: each one, less its relative position, is a possible
start of a template. At a start the template's postings are intersected with the
file by relative position, and the IDF mass found there must reach ``min_mass`` of the
template's; the template's mandatory key phrase must stand word for word. For a base
phrase the key phrase is the whole phrase and decides alone.

Everything happens inside a row, so nothing is shuffled but document counts (at
most one row per licence word), and a source, a frequent licence or a very long
file affects no other row. The index is one broadcast row that grows with the
templates, not with the files. The pass is written once to the shared folder; only files
that hold the licence words of some key phrase keep their words there.

Defined results: a null or empty text has no words, no places and score 0;
overlapping places all count; repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.llm.common import Scratch

#: The base phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Fixed values, the method's own templates: label, notice, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
        " that the above copyright notice and this permission notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you"
        " may obtain a copy of the license at",
        "apache license version 2",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation",
        "gnu general public license",
    ),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met",
        "redistribution and use in source and binary forms",
    ),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("boost-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "licensed under a creative commons attribution", "creative commons attribution"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0", "waived all copyright"),
)

#: Words that aren't posted, since they stand in most texts.
COMMON = frozenset(
    "a all and any are as at by can except for has in into is it of or that the this to under with without you work use may not provided"
    " possible above following free person files file purpose met author law terms related rights including 0 1 2 3 4 v".split()
)

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_MASS = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)

    @property
    def postings(self) -> list[tuple[str, int]]:
        return [(w, i) for i, w in enumerate(self.words) if w not in COMMON]

    def anchors(self, idf: dict[str, float], min_mass: float) -> list[tuple[str, int]]:
        """The postings of highest IDF; all others together have less than ``min_mass`` of the template's."""
        ranked = sorted(self.postings, key=lambda p: (-idf[p[0]], p[1]))
        if self.base:
            return ranked[:1]
        total, rest, n = sum(idf[w] for w, _ in ranked), 1.0, 0
        while n < len(ranked) and rest >= min_mass - 1e-9:
            rest -= idf[ranked[n][0]] / total
            n += 1
        return ranked[:n]


def templates(own: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    base = [Template(label, tuple(p.split()), tuple(p.split()), True) for label, p in BASE]
    return base + [Template(label, tuple(p.split()), tuple(k.split()), False) for label, p, k in own]


def index_files(docs: DataFrame, id_col: str, text_col: str, found: Sequence[Template]) -> DataFrame:
    """doc_id, n_words, hits (licence words in the file) and, where some key phrase's are all there, the words."""
    spark = docs.sparkSession
    lexicon = sorted({w for t in found for w, _ in t.postings})
    keys = sorted({tuple(sorted(set(t.key) - COMMON)) for t in found})
    one = F.broadcast(spark.createDataFrame([(lexicon, [list(k) for k in keys])], "lexicon array<string>, needed array<array<string>>"))
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.trim(F.regexp_replace(text, SPLIT, " ")).alias("norm"))
        .crossJoin(one)  # one row
        .withColumn("n_words", F.expr("if(norm = '', 0L, CAST(length(norm) - length(replace(norm, ' ', '')) + 1 AS bigint))"))
        .withColumn("hits", F.expr("array_intersect(lexicon, split(norm, ' '))"))
        .select("doc_id", "n_words", "hits", F.expr("if(exists(needed, k -> size(array_except(k, hits)) = 0), norm, NULL)").alias("norm"))
    )


def word_idf(index: DataFrame, found: Sequence[Template]) -> dict[str, float]:
    """Over all files; one row per licence word reaches the driver."""
    n = index.count()
    counts = {r["w"]: r["count"] for r in index.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}
    words = {w for t in found for w, _ in t.postings}
    return {w: max(math.log((n + 1.0) / (counts.get(w, 0) + 0.5)), 1e-3) for w in words}


def index_row(spark: SparkSession, found: Sequence[Template], idf: dict[str, float], min_mass: float) -> DataFrame:
    """The templates with their postings, and the inverted index of their anchor words, as one row."""
    rows, lists = [], {}
    for k, t in enumerate(found):
        post = [(w, r, idf[w]) for w, r in t.postings]
        rows.append((t.label, t.base, post, sum(p[2] for p in post), t.key_at, len(t.key), " ".join(t.key)))
        for w, r in t.anchors(idf, min_mass):
            lists.setdefault(w, []).append((k, r))
    schema = (
        "templates array<struct<label: string, base: boolean, post: array<struct<w: string, r: int, idf: double>>, total: double,"
        " key_at: int, key_size: int, key: string>>, anchors array<string>, posted map<string, array<struct<t: int, r: int>>>"
    )
    return spark.createDataFrame([(rows, sorted(lists), lists)], schema)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_mass: float = MIN_MASS,
    own: Sequence[tuple[str, str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per file: doc_id, n_words, places (label, start, base, mass), base_labels, labels, score.

    ``score`` is 1 with a base place, else the largest share of a template's
    IDF mass among accepted places, else 0. Rounding of the shares is to 9 places.
    """
    spark: SparkSession = docs.sparkSession
    known = templates(own)
    index = Scratch(spark, "license").write(index_files(docs, id_col, text_col, known), "index")
    one = F.broadcast(index_row(spark, known, word_idf(index, known), min_mass))
    out = (
        index.crossJoin(one)  # one row
        .withColumn("words", F.expr("if(norm IS NULL, array(), split(norm, ' '))"))
        .withColumn("rare", F.expr("array_intersect(anchors, hits)"))
        .withColumn("seen", F.expr("filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), x -> array_contains(rare, x.w))"))
        .withColumn("starts", F.expr("array_distinct(flatten(transform(seen, x -> transform(posted[x.w], p -> named_struct('t', p.t, 's', x.i - p.r)))))"))
        # the key phrase stands at its place
        .withColumn(
            "keyed",
            F.expr(
                "filter(transform(starts, c -> named_struct('s', c.s, 'd', templates[c.t])), c -> c.s + c.d.key_at >= 0"
                " AND array_join(slice(words, greatest(c.s + c.d.key_at, 0) + 1, c.d.key_size), ' ') = c.d.key)"
            ),
        )
        .withColumn(
            "massed",
            F.expr(
                "transform(keyed, c -> named_struct('label', c.d.label, 'start', CAST(c.s AS bigint), 'base', c.d.base, 'mass', if(c.d.base, 1D,"
                " round(aggregate(c.d.post, 0D, (m, p) -> m + if(c.s + p.r >= 0 AND get(words, c.s + p.r) <=> p.w, p.idf, 0D)) / c.d.total, 9))))"
            ),
        )
        .withColumn("places", F.expr(f"filter(massed, p -> p.mass >= {min_mass}D)"))
    )
    return out.select(
        "doc_id",
        "n_words",
        "places",
        F.expr("array_sort(array_distinct(transform(filter(places, p -> p.base), p -> p.label)))").alias("base_labels"),
        F.expr("array_sort(array_distinct(transform(places, p -> p.label)))").alias("labels"),
        F.expr("coalesce(array_max(transform(places, p -> p.mass)), 0D)").alias("score"),
    )
