"""Fingerprints, links and components against brute force."""

import random

import pytest
import xxhash
from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.llm import simhash
from riskframe.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_copies(seed, n, size=150):
    r = random.Random(seed)
    base = prose(seed, size).split()
    out = []
    for _ in range(n):
        w = list(base)
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_components_of_texts(documents, odd_texts):
    texts = odd_texts + near_copies(5, 12) + [prose(8, 90)] * 4 + [prose(9, 90).upper(), prose(9, 90)]
    got = sorted(simhash.near_duplicates(documents(texts)).collect(), key=lambda r: r["doc_id"])
    fps = [fingerprint(t) for t in texts]
    assert [r["fingerprint"] % 2**64 for r in got] == fps
    assert [r["component_id"] for r in got] == classes(fps)


@pytest.mark.parametrize("most", [2, 4, 7])
def test_links_are_complete(spark, most):
    """Dense balls, chains at the exact distance, and noise."""
    r = random.Random(most)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, most + 1)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    got = simhash.link_classes(spark.createDataFrame(signed, "fingerprint long"), most).collect()
    roots = {x["fingerprint"] % 2**64: x["root"] for x in got}
    want = classes(fps, most)
    assert len(roots) == len(fps)
    pairs = {(roots[f], w) for f, w in zip(fps, want)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_some_chain_passes(x, flips):
    """The pigeonring bound: within 4 bits some start keeps all its budgets."""
    y = x
    for b in flips:
        y ^= 1 << b
    parts = simhash.segments(5)
    d = [((x ^ y) >> a & ((1 << w) - 1)).bit_count() for a, w in parts]
    assert any(all(sum(d[(s + k) % 5] for k in range(n + 1)) <= (n + 1) * 4 // 5 for n in range(5)) for s in range(5))


def test_keep_one(documents):
    copies = near_copies(11, 6)
    texts = [prose(20, 100), *copies, prose(20, 100), prose(21, 100), None, ""]
    docs = documents(texts).withColumn("fingerprint", F.lit("clash"))
    docs = docs.unionByName(docs.filter("doc_id = 0")).unionByName(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = set(classes([fingerprint(t) for t in texts]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(docs.filter("doc_id < 0")).count() == 0


def test_null_keys(spark):
    docs = spark.createDataFrame([(None, prose(30, 80)), (None, prose(30, 80)), (5, None), (None, None)], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(5, 5)]
    assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "None", "None"]
    assert simhash.keep_one(docs).count() == 2


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, kind):
    r = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)] + [(100, 99), (99, 99)],
        "star": [(50, i) for i in range(40)] * 2,
        "random": [(r.randrange(90), r.randrange(90)) for _ in range(50)],
        "none": [],
    }[kind]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_no_table_of_all_fingerprints_is_broadcast(documents, monkeypatch):
    """Spark takes the exploded rows of a small file for as few as its own; none of the joins may rely on that."""
    plans, written, joined = [], simhash.written, simhash.components

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "written", lambda df, name: written(planned(df), name))
    monkeypatch.setattr(simhash, "components", lambda edges: joined(planned(edges)))
    monkeypatch.setattr("riskframe.llm.components.written", lambda df, name: written(planned(df), name))
    docs = documents([*near_copies(12, 9), *near_copies(13, 3), prose(14, 60)])
    planned(simhash.near_duplicates(docs))
    planned(simhash.keep_one(docs))
    assert sum("SortMergeJoin" in p for p in plans) > 8
    assert not [p for p in plans if "Broadcast" in p]
