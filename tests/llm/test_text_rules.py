"""Quality rules, licences and URLs against plain Python on small fixtures."""

import re
from collections import Counter

import pytest
from texts import prose
from pyspark.sql import functions as F

from riskframe.llm import licences, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in quality.SYMBOLS for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def test_quality_measures(documents, odd_texts):
    texts = odd_texts + ["one\ntwo\none\n\none \n" * 30, "a b a b a b c d e a b " * 9]
    docs = documents(texts)
    got = quality.quality(docs).select("doc_id", "quality.*").collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    for row in got:
        assert tuple(row[c] for c in names) == base_measures(texts[row["doc_id"]]), texts[row["doc_id"]]
        assert row["kept"] == (not row["base_failed"] and not row["failed"])


def test_quality_keeps_prose_and_drops_junk(documents):
    good = prose(7, 200)
    docs = documents([good, good.upper(), " ".join(f"{w}###" for w in good.split()), "xyzzy plugh " * 3, good])
    assert [r["doc_id"] for r in quality.keep_good(docs).collect()] == [0, 4]
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_clashing_and_empty(documents):
    docs = documents([prose(3, 100)]).withColumn("quality", F.lit("mine"))
    assert quality.quality(docs).select("quality.kept").first()[0] is True
    assert quality.keep_good(docs).first()["quality"] == "mine"
    assert quality.quality(docs.filter("doc_id < 0")).count() == 0


def test_quality_is_one_native_projection(documents):
    plan = quality.quality(documents(["x"]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def phrase_places(words):
    found, labels = [], set()
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        found += at
        labels |= {label} if at else set()
    return found, labels


def test_licence_base(documents, odd_texts):
    texts = odd_texts + ["MIT license, mit License! MIT-license " * 3, "Released under the MIT License."]
    for row in licences.scan(documents(texts)).select("doc_id", "licence.*").collect():
        words = licences.words_of(texts[row["doc_id"]])
        found, labels = phrase_places(words)
        assert row["n_words"] == len(words)
        assert row["n_base"] == len(found)
        assert (row["first_word"], row["last_word"]) == ((min(found), max(found)) if found else (None, None))
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


def test_licence_method_adds_labels(documents):
    texts = [
        "Some words first. Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software without restriction.",
        prose(4, 80) + "\nLicensed under CC BY-NC 4.0.\n" + prose(5, 80),
        "granted charge person hereby permission free of software deal restriction without " * 3,
        prose(6, 400),
        "Licensed under the Apache License, Version 2.0.",
    ]
    got = {r["doc_id"]: r for r in licences.scan(documents(texts)).select("doc_id", "licence.*").collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "cc-by-nc", "", "", "apache"]
    assert got[0]["score"] > 0.6 and [got[i]["score"] for i in (2, 3)] == [0.0, 0.0]
    assert got[0]["base_labels"] == "" and got[4]["base_labels"] == "apache"
    assert licences.scan(documents(texts).filter("doc_id < 0")).count() == 0


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def listed(host, path):
    fits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en",
    "http://a.example.com/EN/", "http://com", "http://com/", "http://xcom/", "http://a.net/es/1", "http://net/fr/", "http://b.net/fr",
    "http://ÄÖ.Example.net/es/?q=://x", "http://x.org?a=http://y.com/", "http://x.org#frag/", "http://user@h.com:80/p\nq", "http://www.example.com/en/1",
]


def test_urls_listed(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    labels = spark.createDataFrame([("http://a.org/x", "allow")] * 9, "url string, label string")
    for row in urls.judge(pages, labels).collect():
        host, path = parts(row["url"])
        rule, verdict = listed(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or "allow")
    assert urls.judge(pages.filter("page_id < 0"), labels.filter("url is null")).count() == 0


def test_urls_mined(spark):
    """A pair of tokens that only together mean block; neither alone does."""
    known = []
    for i in range(40):
        known += [(f"http://s{i}.farm.org/win/{i}", "block"), (f"http://s{i}.farm.org/news/{i}", "allow"), (f"http://t{i}.good.org/win/{i}", "allow")]
    labels = spark.createDataFrame(known, "url string, label string")
    pages = spark.createDataFrame([(1, "http://zz.farm.org/win/77"), (2, "http://zz.farm.org/news/1"), (3, "http://q.good.org/win/"), (4, "http://else.io/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels, min_support=0.1).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


@pytest.mark.parametrize("confidence", [0.5, 0.9])
def test_mined_rules_meet_their_thresholds(spark, confidence):
    rows = [(["a", "b"], "block")] * 8 + [(["a"], "allow")] * 4 + [(["b"], "block")] * 3 + [(["c"], "allow")] * 5
    rules = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.1, confidence).collect()
    assert rules
    for r in rules:
        fits = [y for t, y in rows if set(r["tokens"]) <= set(t)]
        share = fits.count(r["verdict"]) / len(fits)
        assert share >= confidence and abs(share - r["confidence"]) < 1e-9
        assert abs(fits.count(r["verdict"]) / len(rows) - r["support"]) < 1e-9
