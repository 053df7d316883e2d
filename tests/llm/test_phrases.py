"""Phrases against brute force: the index alone, shards and their sums, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import phrases

A_TO_Z = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def grams(rows, most=4):
    """lang -> phrase (tuple of words) -> count, of (lang, text) rows."""
    out = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, most + 1):
                out.setdefault(lang or "und", Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return out


def brute(rows, least, top=2_000):
    out = []
    for lang, f in grams(rows).items():
        n, frequent = sum(c for p, c in f.items() if len(p) == 1), {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {}
        for p, c in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(c, inside.get(p[i : i + k], 0))
        kept = []
        for p, a in frequent.items():
            if 100 * inside.get(p, 0) < 80 * a:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed, n, words=40, vocabulary=9):
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)] + ["Of", "the", "é\x1f", "naïve", "�"]
    ends = [" ", " ", " ", "\t ", ", ", ".", "\n", "? "]
    return ["".join(r.choice(pool) + r.choice(ends) for _ in range(words)) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.c\t", max_size=40), min_size=1, max_size=4))
def test_index_counts_every_phrase(parts):
    shard = phrases.read_shard([t.encode() for t in parts])
    want = grams([("x", t) for t in parts]).get("x", {})
    if not len(shard.words):
        assert not want
        return
    words = shard.words.to_pylist()
    name = lambda row: tuple(words[i - 1] for i in row)
    word, n_word, pair, n_pair = phrases.pair_counts(shard.ids)
    got = {name([w]): n for w, n in zip(word, n_word)} | {name(p): n for p, n in zip(pair, n_pair)}
    real = np.append((shard.ids[:-1] > 0) & (shard.ids[1:] > 0), False)
    for found in phrases.longer_phrases(shard.ids, real, 4):
        got |= {name(p): n for p, n in zip(found.words, found.count)}
    assert got == want


def test_both_directions_give_the_same_phrases():
    ids = phrases.read_shard([t.encode() for t in texts(3, 30)]).ids
    index = phrases.TwoWayIndex(ids, 4)

    def walk(sides):
        now = index.single_words()
        for left in sides:
            now = index.extend(now, left)
        return {tuple(w): int(n) for w, n in zip(now.words, now.count)}

    ways = [walk(s) for s in ((True, True, True), (False, False, False), (True, False, True), (False, True, False))]
    assert ways[0] and all(w == ways[0] for w in ways)


@pytest.mark.parametrize("shard_bytes", [200, 5_000, 6_000_000])
def test_shards_add_up(spark, shard_bytes):
    rows = [(lang, t) for i, lang in enumerate(["en", "de", None]) for t in texts(i, 60, vocabulary=2)] + [("en", "Of the w1 w2. " * 60)] * 3
    got = mined(table(spark, rows).repartition(5), min_count=12, shard_bytes=shard_bytes)
    assert got == brute(rows, 12) and len({r[0] for r in got}) == 3


def test_top_ties_and_repeated_rows(spark):
    rows = [("en", "b a. a b. c d. d c.")] * 40
    want = brute(rows, 30, top=3)
    assert mined(table(spark, rows), top=3) == want and [r[2] for r in want] == ["a b", "b a", "c d"]


def test_a_saturated_filter_loses_nothing(spark):
    rows = [("en", t) for t in texts(7, 60)]
    counts = phrases.phrase_counts(table(spark, rows), min_count=10, bits=64)
    got = {tuple(r["phrase"].split(" ")): r["n"] for r in counts.filter("phrase != ''").collect()}
    assert got == {p: n for p, n in grams(rows)["en"].items() if n >= 10}


def test_odd_rows(spark, odd_texts):
    rows = [(lang, t) for lang in ("en", None) for t in odd_texts] + [("en", ("one two " * 9 + "\n") * 5_000)]
    got = mined(table(spark, rows), min_count=30, shard_bytes=20_000)
    assert got == brute(rows, 30) and got
    extra = table(spark, rows).selectExpr("*", "'x' AS phrase", "1 AS n", "2 AS words", "3 AS size", "4 AS rank")
    assert mined(extra, min_count=30) == got


def test_empty_tables(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [("en", None), (None, ""), ("de", " . ,")])) == []
    assert mined(table(spark, [("en", "too rare to count")])) == []
