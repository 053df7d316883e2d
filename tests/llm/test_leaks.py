"""Benchmark leaks against brute force, and the pieces of the retrieval."""

from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from riskframe.llm import leaks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    assert leaks.common_subsequence(np.array(a), np.array(b, dtype=int)) == row[-1]


def items(n=12):
    return [(i, prose(5000 + i, 20 + 4 * i)) for i in range(n)] + [(100, "short item here"), (101, None), (102, "?!"), (3, prose(5003, 32))]


def build(spark, documents):
    bench = items()
    words = [t.split() if t else [] for _, t in bench]
    near = list(words[5])
    near[4] = near[11] = "changed"
    texts = [
        prose(1, 100) + " " + bench[0][1] + " " + prose(2, 50),
        bench[7][1].upper().replace(" ", "\n"),
        " ".join(near) + " " + prose(3, 300),
        prose(4, 400),
        " ".join(reversed(words[6])),
        "said: short, item - here!",
        "short here item",
        None,
        "",
        prose(8, 700) + " " + bench[11][1] + " " + prose(9, 400) + " " + bench[1][1],
        " ".join(w for i, w in enumerate(words[8]) if i % 3),  # two thirds of it, with the last words
    ]
    benchmark = spark.createDataFrame(bench, "item_id int, text string")
    return documents(texts), benchmark, texts


def test_leaks_are_found_and_clean_texts_kept(spark, documents):
    docs, benchmark, texts = build(spark, documents)
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in leaks.find_leaks(docs, benchmark).collect()}
    fold = lambda t: " " + " ".join(leaks.folded(t).decode().split()) + " "
    for i, t in enumerate(texts):
        exact = {n for n, x in items() if x and fold(x).strip() and fold(x) in fold(t)}
        assert exact <= got[i]
    assert got[0] == {0} and got[1] == {7} and got[2] == {5} and got[5] == {100} and got[9] == {11, 1}
    assert not any(got[i] for i in (3, 4, 6, 7, 8))
    clean = leaks.without_leaks(docs.withColumnRenamed("source", "leaks"), benchmark)
    assert clean.columns == [c if c != "source" else "leaks" for c in docs.columns]
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(len(texts)) if not got[i]]
    assert {r["leaks"] for r in clean.collect()} == {"src0"}


def test_empty_tables(spark, documents):
    docs, benchmark, _ = build(spark, documents)
    assert leaks.find_leaks(docs.filter("doc_id < 0"), benchmark).count() == 0
    assert not any(r["leaks"] for r in leaks.find_leaks(docs, benchmark.filter("item_id < 0")).collect())


def test_latent_space_holds_the_strongest_directions(spark):
    """The randomised basis holds nearly as much of the passages as the exact one of its rank."""
    rows = spark.createDataFrame([(i, prose(7000 + i, 60)) for i in range(40)], "item_id long, text string").repartition(3)
    block = leaks.read_items(rows.collect())
    weight = np.ones(len(block.vocabulary))
    space = leaks.latent_space(rows, block, weight, rank=10)
    row, column, value, owner = leaks._rows_of(block.words, block.vocabulary, weight)
    dense = np.zeros((len(owner), len(block.vocabulary)))
    np.add.at(dense, (row, column), value)
    exact = np.linalg.svd(dense, compute_uv=False)[:10]
    held = np.linalg.norm(dense @ space.basis)
    assert np.allclose(space.basis.T @ space.basis, np.eye(10), atol=1e-4)
    assert held >= 0.97 * np.linalg.norm(exact)


def test_candidate_recall(spark):
    """Passages that hold a whole item come up as its candidates at any place of a text."""
    bench = [(i, prose(8000 + i, 16 + i)) for i in range(30)]
    block = leaks.read_items([{"item_id": i, "text": t} for i, t in bench])
    weight = np.full(len(block.vocabulary), 3.0)
    space = leaks.latent_space(spark.createDataFrame(bench, "item_id long, text string"), block, weight)
    rare = leaks.rare_words(block, np.zeros(len(weight), dtype=int))
    found = 0
    for k, (i, t) in enumerate(bench):
        text = leaks.folded(f"{prose(k, 3 + k)} {t} {prose(100 + k, 200)}")
        number, hashes = leaks._words([text])
        found += any(c[1] == k for c in leaks.candidates(space, rare, number, hashes))
    assert found == len(bench)


def test_paraphrases_without_the_rarest_words(spark, documents):
    """Items of mostly common words whose rarest words are replaced: candidates as long as the check accepts them."""
    r = np.random.default_rng(11)
    common = [f"word{i}" for i in range(1_000)]  # each in about 6 % of the documents
    rare = [f"rare{i}" for i in range(12 * 8)]
    bench, planted, texts = [], [], []
    for i in range(12):
        words = [common[j] for j in r.integers(0, len(common), 28)]
        own = rare[8 * i : 8 * i + 8]
        for w, at in zip(own, r.permutation(28)[:8]):
            words.insert(int(at), w)
        words += [common[j] for j in r.integers(0, len(common), 3)]
        bench.append((i, " ".join(words)))
        planted.append(" ".join(f"other{i}x{w}" if w in own else w for w in words))
    for i in range(400):
        filler = [common[j] for j in r.integers(0, len(common), 60)] + [f"own{i}x{j}" for j in range(20)]
        texts.append(" ".join(filler[int(j)] for j in r.permutation(80)))
    docs = documents([f"{texts[i]} {p} {texts[i + 12]}" for i, p in enumerate(planted)] + texts[24:])
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = {x["doc_id"]: {y["item_id"] for y in x["leaks"]} for x in leaks.find_leaks(docs, benchmark).collect()}
    assert all(i in got[i] for i in range(12))


def test_no_place_that_could_leak_is_passed_over():
    """Places kept against all places and items: where the check accepts, the counts of rarer words do."""
    r = np.random.default_rng(3)
    word = lambda: f"w{int(60 * r.random() ** 2)}"
    bench = [" ".join(word() for _ in range(int(n))) for n in r.integers(2, 70, 40)]
    block = leaks.read_items([{"item_id": i, "text": t} for i, t in enumerate(bench)])
    rare = leaks.rare_words(block, r.integers(0, 9, len(block.vocabulary)))
    seen = 0
    for _ in range(30):
        part = bench[int(r.integers(40))].split()
        part = [w if r.random() > 0.25 else "other" for w in part]
        text = " ".join([word() for _ in range(int(r.integers(90)))] + part + [word() for _ in range(50)])
        number, hashes = leaks._words([leaks.folded(text), leaks.folded(" ".join(part))])
        begin, end, owner = leaks.passage_halves(number)
        half = np.repeat(np.arange(len(begin)), end - begin)
        centre, item = leaks.promising(rare, half, leaks._numbers(hashes, block.vocabulary), len(begin), number, hashes)
        kept = set(zip(centre.tolist(), item.tolist()))
        assert len(kept) == len(centre)
        for h in range(len(begin)):
            own = np.flatnonzero(number == owner[h])
            last = end[h + 1] if h + 1 < len(begin) and owner[h + 1] == owner[h] else end[h]
            for i, words in enumerate(block.words):
                if leaks.check(hashes[own], begin[h] - own[0], last - own[0], words)[2]:
                    seen += 1
                    assert (h, i) in kept
    assert seen > 100


def test_edited_items_against_all_pairs(spark, documents):
    """Recall of the whole operator against the check at every place of every document, for every item."""
    r = np.random.default_rng(17)
    bench = [(i, prose(300 + i, int(n))) for i, n in enumerate(r.integers(8, 90, 40))]
    texts = []
    for i, t in bench:
        words = [w if r.random() > 0.12 else f"new{int(r.integers(50))}" for w in t.split()]
        texts.append(f"{prose(i, int(r.integers(5, 120)))} {' '.join(words)} {prose(900 + i, 60)}")
    block = leaks.read_items([{"item_id": i, "text": t} for i, t in bench])
    want = set()
    for d, t in enumerate(texts):
        _, hashes = leaks._words([leaks.folded(t)])
        for begin in range(0, len(hashes), leaks.HALF):
            end = min(begin + 2 * leaks.HALF, len(hashes))
            want |= {(d, i) for i, words in enumerate(block.words) if leaks.check(hashes, begin, end, words)[2]}
    found = leaks.find_leaks(documents(texts), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(x["doc_id"], y["item_id"]) for x in found for y in x["leaks"]}
    assert got <= want and len(want) >= 30 and len(got) >= 0.95 * len(want)


def test_repeated_items_are_one_class(spark, documents):
    text = prose(77, 40)
    benchmark = spark.createDataFrame([(i, text) for i in range(9, 400)] + [(500, prose(78, 40))], "item_id long, text string")
    assert {(r["item_id"], r["n_items"]) for r in leaks.item_classes(benchmark).collect()} == {(9, 391), (500, 1)}
    got = leaks.find_leaks(documents([f"before {text} after", "else"]), benchmark).collect()
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got} == {0: [9], 1: []}
