"""Licence scans: exact phrases, and notices found by a positional index of their rare words."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, split_words, whole

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A licence notice: its text, and the phrases of it that must stand in a file."""

    label: str
    text: str
    keys: tuple[str, ...]


# Short notices of common licences, and what each must contain.
NOTICES = (
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Notice("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Notice(
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        ("general public license",),
    ),
    Notice(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        ("free software", "general public license"),
    ),
    Notice("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Notice(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
)
MAX_NOTICE_WORDS = 20_000  # notices become literals of the projection
RARE_WORDS = 6  # highest-IDF words of a notice that are looked up
MIN_SHARE = 0.6  # share of a notice's rare-word weight that must stand at one offset
SLACK = 2  # words by which places may differ from the notice


def _vocabulary(notices: tuple[Notice, ...]) -> list[str]:
    words = sorted({w for n in notices for w in n.text.split()} | {w for p, _ in PHRASES for w in p.split()})
    if sum(len(n.text.split()) for n in notices) > MAX_NOTICE_WORDS:
        raise ValueError(f"notices of more than {MAX_NOTICE_WORDS} words")
    return words


def file_words(text: str) -> Column:
    return split_words(ascii_lower(whole(text)), BETWEEN)


def document_frequency(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of rows, and of rows with each licence word: one pass over all whole texts.

    At most as many rows as the notices have words reach the driver.
    """
    vocabulary = _vocabulary(notices)
    present = F.array_intersect(file_words(text), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), found


def _rare(notices: tuple[Notice, ...], rows: int, frequency: dict[str, int]) -> list[list[tuple[str, int, float]]]:
    """Of each notice the places and weights of its words of highest IDF: (word, place, idf)."""
    idf = lambda w: math.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-6
    out = []
    for notice in notices:
        words = notice.text.split()
        best = sorted(set(words), key=lambda w: (-idf(w), w))[:RARE_WORDS]
        out.append([(w, i, round(idf(w), 6)) for i, w in enumerate(words) if w in best and words.index(w) == i])
    return out


def _starts(of: dict[str, Column], phrase: str) -> Column:
    """First places of a phrase: the places of its words, each moved back to the phrase's start, intersected."""
    starts = None
    for i, w in enumerate(phrase.split()):
        moved = F.transform(of[w], lambda p: p - i)
        starts = moved if starts is None else F.array_intersect(starts, moved)
    return starts


def scan(
    docs: DataFrame,
    notices: tuple[Notice, ...] = NOTICES,
    text: str = "text",
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """``docs`` with a struct ``licence``: ``n_words n_base first_word last_word base_labels labels score``.

    The places of all licence words of a file form a small index (word to places); every
    test after that reads the index only. A notice is found where its rarest words, at least
    ``min_share`` of their weight, stand at one offset (give or take two words) and all its
    key phrases stand near there. ``score`` is the largest share among found labels, 1 with
    a base phrase, else 0. A null text counts as empty: zero words, no labels, null places.
    Repeated rows get equal results, an empty table an empty one, and a column named
    ``licence`` is replaced. Two passes over the texts and no shuffle of them.
    """
    rows, frequency = document_frequency(docs, notices, text)
    rare = _rare(notices, rows, frequency)
    phrase_words = {w for p, _ in PHRASES for w in p.split()} | {w for n in notices for k in n.keys for w in k.split()}
    wanted = sorted(phrase_words | {w for r in rare for w, _, _ in r})

    def indexed(w: Column) -> Column:
        """(word, place) of licence words only."""
        hits = F.filter(
            F.transform(w, lambda x, i: F.when(x.isin(wanted), F.struct(x.alias("w"), i.alias("i")))),
            lambda h: h.isNotNull(),
        )
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    def by_word(s: Column) -> Column:
        columns = [
            F.transform(F.filter(s["hits"], lambda h: h["w"] == w), lambda h: h["i"]).alias(f"w{i}")
            for i, w in enumerate(wanted)
        ]
        return F.struct(s["n_words"].alias("n_words"), *columns)

    def near(starts: Column, place: Column) -> Column:
        return F.exists(starts, lambda p: F.abs(p - place) <= SLACK)

    def share(of: dict[str, Column], notice: Notice, places: list[tuple[str, int, float]]) -> Column:
        """Largest share of the weight found at one offset that has the key phrases beside it."""
        total = sum(x for _, _, x in places)
        anchors = F.array_distinct(F.concat(*(F.transform(of[w], lambda p: p - i) for w, i, _ in places)))
        words = notice.text.split()

        def at(offset: Column) -> Column:
            weight = F.lit(0.0)
            for w, i, x in places:
                weight = weight + F.when(near(of[w], offset + i), F.lit(x)).otherwise(F.lit(0.0))
            for key in notice.keys:
                k = key.split()
                where = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
                weight = F.when(near(_starts(of, key), offset + where), weight).otherwise(F.lit(0.0))
            return weight / F.lit(total)

        return F.coalesce(F.array_max(F.transform(anchors, at)), F.lit(0.0))

    def verdict(s: Column) -> Column:
        of = {w: s[f"w{i}"] for i, w in enumerate(wanted)}
        starts = [_starts(of, p) for p, _ in PHRASES]
        return let(
            F.struct(
                F.array(*starts).alias("base"),
                F.array(
                    *(
                        # without the first word of a key there is no notice, and nothing to look up
                        F.when(F.size(of[n.keys[0].split()[0]]) > 0, share(of, n, r)).otherwise(F.lit(0.0))
                        for n, r in zip(notices, rare)
                    )
                ).alias("shares"),
            ),
            lambda x: conclusion(s, x),
        )

    def conclusion(s: Column, x: Column) -> Column:
        places = F.flatten(x["base"])
        base = F.array_compact(
            F.array(*(F.when(F.size(x["base"][i]) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))
        )
        found = F.array_compact(
            F.array(*(F.when(x["shares"][i] >= min_share, F.lit(n.label)) for i, n in enumerate(notices)))
        )
        best = F.array_max(F.filter(F.transform(x["shares"], lambda v: v), lambda v: v >= min_share))
        joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
        return F.struct(
            s["n_words"].alias("n_words"),
            F.size(places).cast("long").alias("n_base"),
            F.array_min(places).cast("long").alias("first_word"),
            F.array_max(places).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.concat(base, found)).alias("labels"),
            F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0))).alias("score"),
        )

    return docs.withColumn("licence", let(let(let(file_words(text), indexed), by_word), verdict))


def words_of(text: str | None) -> list[str]:
    """The same words in Python, for tests and single texts."""
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(BETWEEN, lowered) if w]
