"""License scans with a positional index of rare licence words.

A template is a notice and, in it, a mandatory phrase. The words of the mandatory phrases
are weighed by inverse document frequency over the whole corpus, and each phrase is posted
under its two rarest words with their places. A file's occurrences of posted words say
where a phrase would have to start; the starts on which both words agree are intersected,
and the phrase is verified word by word there. The share of the surrounding notice that
stands at the same relative positions is the score of the match.

Everything is done within the row by array functions; only rows that hold a posted word
build arrays of occurrences. Document frequencies are one count per template word.

Null text is empty: no words, no places, no labels, score 0. Repeated rows get the same
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymix.llm.quality_rules import bind

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2
#: A match on the mandatory phrase names a label from this share of its notice on.
COVERED = 0.4

#: (label, notice, mandatory phrase). Notices are well-known public wordings.
TEMPLATES = [
    ("mit", "released under the mit license", "under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction",
        "hereby granted free of charge to any person",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by", "licensed under cc by 4 0", "under cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute this software"),
]
#: The first templates are the base phrases.
BASE = 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of the words of the mandatory phrases; one row per word."""
    words = sorted({w for _, _, phrase in templates for w in phrase.split()})
    held = F.array_intersect(words_of(F.col("text")), texts(words))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    most = max(found.values(), default=0)
    return {w: math.log((1 + most) / (1 + found.get(w, 0))) for w in words}


def postings(weights: dict[str, float], templates=TEMPLATES) -> list[list[tuple[str, int, int]]]:
    """For the rarest and the next rarest words: (word, template, place in the phrase)."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(ANCHORS)]
    for t, (_, _, phrase) in enumerate(templates):
        words = phrase.split()
        ranked = sorted(range(len(words)), key=lambda i: (-weights[words[i]], i))
        for rank in range(ANCHORS):
            at = ranked[min(rank, len(ranked) - 1)]
            out[rank].append((words[at], t, at))
    return out


def starts(hits: Column, posted: list[tuple[str, int, int]]) -> Column:
    """(template, start) for every occurrence of a posted word."""
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(o).alias("o")) for w, t, o in posted])
    return F.flatten(
        F.transform(
            hits,
            lambda h: F.transform(
                F.filter(table, lambda p: (p["w"] == h["w"]) & (h["i"] >= p["o"])),
                lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("at")),
            ),
        )
    )


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..), with every verified match.

    (doc_id, n_words, matches): matches are (t, at, covered), ``t`` the template's number,
    ``at`` the word its mandatory phrase starts with.
    """
    lists = postings(idf(docs, templates), templates)
    anchors = sorted({w for posted in lists for w, _, _ in posted})
    phrases = F.array(*[texts(p.split()) for _, _, p in templates])
    notices = F.array(*[texts(n.split()) for _, n, _ in templates])
    leads = []
    for _, notice, phrase in templates:
        n, p = notice.split(), phrase.split()
        leads.append(next(i for i in range(len(n)) if n[i : i + len(p)] == p))
    lead = F.array(*map(F.lit, leads))

    def verified(words: Column, hits: Column) -> Column:
        agreed = starts(hits, lists[0])
        for posted in lists[1:]:
            agreed = F.array_intersect(agreed, starts(hits, posted))

        def holds(m: Column) -> Column:
            phrase = F.get(phrases, m["t"])
            return F.slice(words, m["at"] + 1, F.size(phrase)) == phrase

        def match(m: Column) -> Column:
            notice, ahead = F.get(notices, m["t"]), F.get(lead, m["t"])
            same = F.filter(
                F.transform(notice, lambda w, i: F.get(words, m["at"] - ahead + i) == w), lambda x: F.coalesce(x, F.lit(False))
            )
            return F.struct(m["t"].alias("t"), m["at"].alias("at"), (F.size(same) / F.size(notice)).alias("covered"))

        return F.transform(F.filter(agreed, holds), match)

    def matches(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        hits = F.filter(placed, lambda h: h["w"].isin(anchors))
        found = F.when(F.arrays_overlap(words, texts(anchors)), bind(hits, lambda h: verified(words, h)))
        return F.struct(F.size(words).cast("long").alias("n_words"), found.alias("matches"))

    return docs.select("doc_id", bind(words_of(F.col("text")), matches).alias("__m")).select("doc_id", "__m.*")


def labelled(docs: DataFrame, templates=TEMPLATES, base: int = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    rows = scan(docs, templates)
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast(rows.schema["matches"].dataType)))
    base_at = F.filter("matches", lambda m: m["t"] < base)
    names = texts([t[0] for t in templates])

    def joined(found: Column) -> Column:
        own = F.transform(found, lambda m: F.get(names, m["t"]))
        return F.array_join(F.array_sort(F.array_distinct(own)), ",")

    named = F.filter("matches", lambda m: (m["t"] < base) | (m["covered"] >= COVERED))
    places = F.transform(base_at, lambda m: m["at"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base_at).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base_at).alias("base_labels"),
        joined(named).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["covered"])), F.lit(0.0)).alias("score"),
    )
