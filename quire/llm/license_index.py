"""Licence scan over a positional rare-token index.

The index holds, for each word of the templates, the templates and the places in them where it stands, and its IDF over
the whole corpus. A template is a licence's name or a passage of its text, with a key phrase inside. For each template
whose key phrase's words a file holds, the file's highest-IDF words of it are looked up; every place of theirs implies
a place where the template would begin, and those on which enough of them agree are kept. There the key phrase must
stand word by word; the rest of a passage may differ. The score is the share of the template's IDF that stands in its
place, the best of a file's templates.

The corpus is read once: words, and the words of files that may hold a key phrase, go to a table; the document counts
of words are taken from it.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned one by one; an
empty table gives an empty result; columns beside the kept ones are ignored, and kept ones must not have the names of
results.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, stored

#: Runs of ASCII digits, a-z and everything beyond ASCII.
LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a file that are looked up for a template, and how many of them must agree in a passage.
RARE, AGREE = 3, 2


@dataclass(frozen=True)
class Template:
    """text: the words of a name or passage. key: the phrase in it that must stand; the whole text if empty."""

    label: str
    text: str
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return (self.key or self.text).split()

    @property
    def at(self) -> int:
        """Where the key phrase begins in the text."""
        n = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.phrase)

    @property
    def places(self) -> dict[str, list[int]]:
        found = defaultdict(list)
        for i, w in enumerate(self.words):
            found[w].append(i)
        return dict(found)

    @property
    def votes(self) -> int:
        """How many looked-up words must agree: all that can, for a name."""
        return min(len(self.places), AGREE if self.key else RARE)


TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("apache-2.0", "apache license version 2 0"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    Template("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template(
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you can redistribute it and or modify it under the terms of the gnu",
    ),
    Template("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software released into the public domain",
    ),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENCE_WORD), 0)


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _may_hold(t: Template) -> str:
    """SQL over held, a file's words that any template has: whether it has all words of the key phrase."""
    need = sorted(set(t.phrase))
    return f"size(array_intersect(held, {_array(need)})) = {len(need)}"


def files_of(docs: DataFrame, text: str, keep: tuple[str, ...], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """keep, n_words, held (the file's words among the templates'), words (null where no key phrase can stand)."""
    rows = docs.select(*keep, words_of(F.col(text)).alias("_words"))
    rows = rows.withColumn("held", F.array_intersect("_words", F.array(*map(F.lit, vocabulary(templates)))))
    possible = F.expr(" OR ".join(f"({c})" for c in dict.fromkeys(map(_may_hold, templates))) or "false")
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), "held", F.when(possible, F.col("_words")).alias("words"))


def licence_idf(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of each template word over all files; as long as the templates' vocabulary."""
    n = files.count()
    seen = {r["w"]: r["count"] for r in files.select(F.explode("held").alias("w")).groupBy("w").count().collect()}
    return {w: math.log((1 + n) / (1 + seen.get(w, 0))) for w in vocabulary(templates)}


def rarest(t: Template, idf: dict[str, float]) -> list[str]:
    """The template's words, highest IDF first."""
    return sorted(t.places, key=lambda w: (-idf[w], w))


def _hits(t: Template, idf: dict[str, float]) -> str:
    """SQL over words and held: the verified places of a template, as (label, base, start, share)."""
    postings = "map(" + ", ".join(f"'{w}', array({', '.join(map(str, at))})" for w, at in t.places.items()) + ")"
    looked = f"slice(filter({_array(rarest(t, idf))}, x -> array_contains(held, x)), 1, {RARE})"
    spots = "filter(transform(words, (x, i) -> struct(x AS x, i AS i)), p -> array_contains(looked, p.x))"
    # each looked-up word votes once for a start
    ballots = f"flatten(transform(looked, x -> array_distinct(flatten(transform(filter(spots, p -> p.x = x), p -> transform({postings}[x], o -> p.i - o))))))"
    agreed = f"filter(ballots, (s, k) -> coalesce(get(ballots, k + {t.votes - 1}) = s, false) AND coalesce(get(ballots, k - 1) <> s, true))"
    n = len(t.phrase)
    verified = f"filter({agreed}, s -> s + {t.at} >= 0 AND slice(words, s + {t.at + 1}, {n}) = {_array(t.phrase)})"
    weights = [idf[w] for w in t.words]
    share = "1.0D"
    if t.key and sum(weights) > 0:
        idfs = f"array({', '.join(f'{x!r}D' for x in weights)})"
        in_place = f"transform({_array(t.words)}, (x, k) -> if(s + k >= 0 AND get(words, s + k) = x, get({idfs}, k), 0.0D))"
        share = f"aggregate({in_place}, 0.0D, (a, b) -> a + coalesce(b, 0.0D)) / {sum(weights)!r}D"
    hit = f"struct('{t.label}' AS label, {str(t.base).lower()} AS base, s AS start, round({share}, 6) AS share)"
    found = f"transform({verified}, s -> {hit})"
    for name, value in (("ballots", f"sort_array({ballots})"), ("spots", spots), ("looked", looked)):
        found = f"transform(array({value}), {name} -> {found})[0]"
    return f"CASE WHEN {_may_hold(t)} THEN {found} ELSE {NO_HITS} END"


NO_HITS = "cast(array() AS array<struct<label: string, base: boolean, start: int, share: double>>)"


def scan_licences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: tuple[Template, ...] = TEMPLATES, idf: dict[str, float] | None = None) -> DataFrame:
    """keep, n_words, hits (label, base, start, share), n_base, first_word, last_word, base_labels, labels and score.

    idf: that of an earlier scan; else it is counted over docs.
    """
    files = stored(files_of(docs, text, keep, templates), "licence-files")
    idf = idf if idf is not None else licence_idf(files, templates)
    hits = f"CASE WHEN words IS NULL THEN {NO_HITS} ELSE concat({', '.join(_hits(t, idf) for t in templates)}) END" if templates else NO_HITS
    labels = lambda found: f"array_join(array_sort(array_distinct(transform({found}, x -> x.label))), ',')"
    base = "filter(hits, x -> x.base)"
    return files.withColumn("hits", F.expr(hits)).selectExpr(
        *(f"`{c}`" for c in keep), "n_words", "hits", f"cast(size({base}) AS bigint) AS n_base", f"cast(array_min(transform({base}, x -> x.start)) AS bigint) AS first_word",
        f"cast(array_max(transform({base}, x -> x.start)) AS bigint) AS last_word", f"{labels(base)} AS base_labels", f"{labels('hits')} AS labels",
        "coalesce(array_max(transform(hits, x -> x.share)), 0.0D) AS score",
    )
