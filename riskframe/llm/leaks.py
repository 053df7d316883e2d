"""Benchmark decontamination: latent semantic retrieval, then common-subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import ship_package
from .common import blocks, shingle_hashes, split_words, word_table, written

HALF = 16  # words of half a passage: passages are two halves, and every half begins one
RANK, EXTRA, POWER_STEPS, SEED = 128, 16, 2, 7
MIN_COSINE = 0.25
MIN_COMMON = 0.8  # share of an item's words in the longest common subsequence
MIN_COMMON_WITH_ANSWER = 0.6  # enough if the item's answer stands there too
ANSWER_WORDS = 3  # an item's last words count as its answer
SLICE = 4_096  # passages folded into the latent space at once
SHORT = 6  # items of fewer words must stand there word by word
RARE_SHARE = 0.5  # share of an item's words, rarest first, that the search for places counts
BLOCK_PASSAGES = 4_000  # half passages of the items searched in one pass over the documents

# Letters (any byte of a longer code too), digits; the rest separates words.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    """Lower case, punctuation to spaces."""
    return (text or "").lower().encode().translate(_FOLD)


@dataclass
class Items:
    """A block of benchmark items: ids, words of each, and the sorted words of all."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray


@dataclass
class Space:
    """The latent space: of each vocabulary word its weight and place, of each passage its direction."""

    vocabulary: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    passages: np.ndarray
    owner: np.ndarray


@dataclass
class RareWords:
    """Inverted lists of the items' rarer words, and how many of them a leak holds at least.

    A leak's common subsequence has at least 80 % of the item's words, so it has all but
    20 % of any subset of them: a place where fewer of the rarest 50 % stand cannot leak.
    Where the item's last words stand, the same holds with 60 % and 40 %.
    """

    start: np.ndarray  # of each vocabulary word, where its list begins
    item: np.ndarray
    times: np.ndarray  # places in the item
    least: np.ndarray  # of each item
    least_with_answer: np.ndarray
    answer: np.ndarray  # sorted hashes of the items' last words
    answer_item: np.ndarray
    reach: np.ndarray  # half passages to each side of a passage that are compared with the item


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    number, _, _, hashes = word_table(texts)
    return number, hashes


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, -1 for others."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def read_items(rows: list) -> Items:
    texts = [folded(r["text"]) for r in rows]
    number, hashes = _words(texts)
    words = np.split(hashes, np.searchsorted(number, np.arange(1, len(rows))))
    return Items([r["item_id"] for r in rows], words, np.unique(hashes))


def word_weights(n: int, frequency: np.ndarray) -> np.ndarray:
    """IDF of each word."""
    return np.log((n + 1) / (frequency + 1)) + 1e-3


def passage_halves(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of each half passage of the words' texts."""
    first = np.flatnonzero(np.diff(number, prepend=-1))
    size = np.diff(np.append(first, len(number)))
    count = -(-size // HALF)
    owner = np.repeat(np.arange(len(first)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[owner] + inner * HALF
    return begin, np.minimum(begin + HALF, (first + size)[owner]), number[begin] if len(begin) else begin


def document_frequency(docs: DataFrame, vocabulary: np.ndarray, text: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each word, over all whole documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            texts = [folded(t) for t in batch.column(0).to_pylist()]
            total += len(texts)
            for block in blocks(texts):
                number, hashes = _words(texts[block])
                place = _numbers(hashes, shared.value)
                hit = np.flatnonzero(place >= 0)
                pairs = np.unique(number[hit] * len(seen) + place[hit])
                seen += np.bincount(pairs % len(seen), minlength=len(seen))
        seen[-1] = total
        word = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen[word])], ["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in counts:
        out[r["word"]] = r["n"]
    return int(out[-1]), out[:-1]


def _rows_of(words: list[np.ndarray], vocabulary: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF passages of items as sparse rows of unit length: row, column, value; and each row's item."""
    number = np.repeat(np.arange(len(words)), [len(w) for w in words])
    if not len(number):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0), none
    place = _numbers(np.concatenate(words), vocabulary)
    begin, end, owner = passage_halves(number)
    half = np.repeat(np.arange(len(begin)), end - begin)
    follows = np.append(False, owner[1:] == owner[:-1])[half]
    row = np.concatenate([half, half[follows] - 1])
    column = np.concatenate([place, place[follows]])
    value = weight[column]
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(begin)))
    return row, column, value / np.maximum(norm[row], 1e-12), owner


def _project(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """The sparse matrix of these cells times the basis, a few thousand cells at a time."""
    out = np.zeros((n, basis.shape[1]))
    for i in range(0, len(row), 2_048):
        part = slice(i, i + 2_048)
        np.add.at(out, row[part], basis[column[part]] * value[part, None])
    return out


def rare_words(items: Items, frequency: np.ndarray) -> RareWords:
    lists: list[tuple[int, int, int]] = []
    least, least_with_answer, answers, reach = [], [], [], []
    for i, words in enumerate(items.words):
        n = len(words)
        place = np.sort(_numbers(words, items.vocabulary))
        rare = place[np.argsort(frequency[place], kind="stable")]
        if n >= SHORT:
            rare = rare[: -(-int(1000 * RARE_SHARE) * n // 1000)]
            answers.append((int(_answers(words, np.zeros(n, dtype=int))[0][-1]), i))
        for share, out in ((MIN_COMMON, least), (MIN_COMMON_WITH_ANSWER, least_with_answer)):
            needed = -(-int(1000 * share) * n // 1000) if n >= SHORT else n
            out.append(max(1, needed - (n - len(rare))))
        reach.append(-(-n // HALF))
        word, times = np.unique(rare, return_counts=True)
        lists += [(w, i, t) for w, t in zip(word.tolist(), times.tolist())]
    table = np.array(sorted(lists), dtype=np.int64).reshape(-1, 3)
    start = np.searchsorted(table[:, 0], np.arange(len(items.vocabulary) + 1))
    answers.sort()
    answer = np.array([h for h, _ in answers], dtype=np.uint64)
    answer_item = np.array([i for _, i in answers], dtype=np.int64)
    return RareWords(
        start, table[:, 1], table[:, 2], np.array(least), np.array(least_with_answer), answer, answer_item, np.array(reach)
    )


def _answers(hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of as many words as an answer has, and its first word."""
    return shingle_hashes(hashes, number, ANSWER_WORDS)


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of several ranges in a row, and the range of each."""
    of = np.repeat(np.arange(len(first)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def promising(
    rare: RareWords, half: np.ndarray, place: np.ndarray, n_halves: int, number: np.ndarray, hashes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(half passage, item): passages around which enough of the item's rarer words stand.

    ``half``, ``place``, ``number`` and ``hashes`` give each word's half passage, its number
    in the vocabulary (-1: none), its text and its hash. Nothing that could leak is left out:
    a word counts in every half it stands in.
    """
    words = len(rare.start)
    hit = np.flatnonzero(place >= 0)
    once = np.unique(half[hit] * words + place[hit])
    at, word = once // words, once % words
    entry, of = _ranges(rare.start[word], rare.start[word + 1] - rare.start[word])
    at, item, times = at[of], rare.item[entry], rare.times[entry]
    # a window of the item's reach lies in two neighbouring cells of that size
    stride, span = n_halves + 2, 2 * rare.reach + 2
    cell, which = np.unique(item * stride + at // span[item], return_inverse=True)
    total = np.bincount(which, times, minlength=len(cell))
    beside = np.zeros(len(cell))
    follows = np.flatnonzero(np.diff(cell) == 1)
    beside[follows] = total[follows + 1]
    beside[follows + 1] = np.maximum(beside[follows + 1], total[follows])
    kept = (total + beside >= rare.least_with_answer[cell // stride])[which]
    # the windows themselves
    key, which = np.unique(item[kept] * stride + at[kept], return_inverse=True)
    sums = np.concatenate([[0], np.cumsum(np.bincount(which, times[kept], minlength=len(key)))])
    item, at = key // stride, key % stride
    low, high = np.maximum(at - 1 - rare.reach[item], 0), np.minimum(at + rare.reach[item], n_halves - 1)
    again = np.flatnonzero(item[1:] == item[:-1]) + 1
    low[again] = np.maximum(low[again], high[again - 1] + 1)
    centre, of = _ranges(low, np.maximum(high - low + 1, 0))
    item = item[of]
    begin = np.searchsorted(key, item * stride + np.maximum(centre - rare.reach[item], 0))
    end = np.searchsorted(key, item * stride + np.minimum(centre + 1 + rare.reach[item], n_halves), side="right")
    around = sums[end] - sums[begin]
    run, first = _answers(hashes, number)
    low = np.searchsorted(rare.answer, run)
    entry, of = _ranges(low, np.searchsorted(rare.answer, run, side="right") - low)
    # an answer may begin in the half before the compared words and end among them
    stands = np.sort(rare.answer_item[entry] * stride + half[first[of]])
    begin = np.searchsorted(stands, item * stride + np.maximum(centre - rare.reach[item] - 1, 0))
    end = np.searchsorted(stands, item * stride + np.minimum(centre + 1 + rare.reach[item], n_halves), side="right")
    enough = (around >= rare.least[item]) | ((around >= rare.least_with_answer[item]) & (end > begin))
    return centre[enough], item[enough]


def _added(blocks_of_rows: pd.DataFrame) -> pd.DataFrame:
    """The tasks' shares of one block of the sum, added up."""
    total = sum(np.frombuffer(v) for v in blocks_of_rows["values"])
    return pd.DataFrame({"block": blocks_of_rows["block"].iloc[:1], "values": [total.tobytes()]})


def latent_space(benchmark: DataFrame, items: Items, weight: np.ndarray, rank: int = RANK) -> Space:
    """Randomised SVD of the items' TF-IDF passages.

    Tasks hold the passages of some items each and add up their share of ``A' (A Q)`` by
    blocks of words; the driver sees sums of the size of the basis only, and makes them
    orthogonal. The range is found from random directions with power steps.
    """
    size = len(items.vocabulary)
    k = max(1, min(rank + EXTRA, size))
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, k)))[0] if size else np.zeros((0, k))
    sc = benchmark.sparkSession.sparkContext
    for _ in range(1 + POWER_STEPS if size else 0):
        shared = sc.broadcast((items.vocabulary, weight, basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, q = shared.value
            total, any_rows = np.zeros_like(q), False
            for batch in batches:
                number, hashes = _words([folded(t) for t in batch.column(0).to_pylist()])
                own = np.split(hashes, np.flatnonzero(np.diff(number)) + 1) if len(hashes) else []
                row, column, value, owner = _rows_of(own, vocabulary, weights)
                total += _project(column, row, value, len(total), _project(row, column, value, len(owner), q))
                any_rows = True
            if any_rows:
                for i in range(0, len(total), 512):
                    part = total[i : i + 512].tobytes()
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i // 512]), "values": pa.array([part], pa.binary())})

        sums = benchmark.select("text").mapInArrow(run, "block long, values binary")
        rows = sums.groupBy("block").applyInPandas(_added, "block long, values binary").collect()
        image = b"".join(bytes(r["values"]) for r in sorted(rows, key=lambda r: r["block"]))
        basis = np.linalg.qr(np.frombuffer(image).reshape(size, k))[0]
        shared.destroy()
    row, column, value, owner = _rows_of(items.words, items.vocabulary, weight)
    projected = _project(row, column, value, len(owner), basis)
    # rotate to the singular directions and keep the strongest
    right = np.linalg.svd(projected, full_matrices=False)[2][:rank] if len(projected) else np.zeros((0, k))
    basis = (basis @ right.T).astype(np.float32)
    placed = (projected @ right.T).astype(np.float32)
    length = np.linalg.norm(placed, axis=1)
    return Space(
        items.vocabulary, weight.astype(np.float32), basis,
        placed / np.maximum(length, 1e-12)[:, None], owner,
    )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of ``a``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b.tolist():
        u = row & masks.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _stands(words: np.ndarray, part: np.ndarray) -> bool:
    n = len(part)
    if not n or n > len(words):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(words, n) == part).all(axis=1).any())


def check(words: np.ndarray, begin: int, end: int, item: np.ndarray) -> tuple[float, bool, bool]:
    """Share of the item in the words around a passage, whether its answer is there, and the verdict."""
    near = words[max(0, begin - len(item)) : end + len(item)]
    answer = _stands(near, item[-ANSWER_WORDS:])
    if len(item) < SHORT:
        whole = _stands(near, item)
        return float(whole), answer, whole
    share = common_subsequence(item, near) / len(item)
    return share, answer, share >= MIN_COMMON or (answer and share >= MIN_COMMON_WITH_ANSWER)


def candidates(space: Space, rare: RareWords, number: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end) of passages near a passage of the item in the latent space.

    Only passages that hold enough of an item's rarer words are folded in and compared.
    """
    if not len(hashes) or not len(space.owner):
        return
    begin, end, text = passage_halves(number)
    half = np.repeat(np.arange(len(begin)), end - begin)
    place = _numbers(hashes, space.vocabulary)
    centre, item = promising(rare, half, place, len(begin), number, hashes)
    order = np.lexsort((item, centre))
    centre, item = centre[order], item[order]
    follows = np.append(text[1:] == text[:-1], False)
    first = np.searchsorted(space.owner, np.arange(len(rare.least) + 1))
    words = np.flatnonzero(place >= 0)
    starts = np.searchsorted(half[words], np.arange(len(begin) + 1))
    for at in range(0, len(centre), SLICE):
        own, back = np.unique(centre[at : at + SLICE], return_inverse=True)
        last = own + 1 + follows[own]
        word, of = _ranges(starts[own], starts[last] - starts[own])
        word = place[words[word]]
        vectors = np.zeros((len(own), space.basis.shape[1]), dtype=np.float32)
        for i in range(0, len(word), 4_096):
            part = slice(i, i + 4_096)
            np.add.at(vectors, of[part], space.basis[word[part]] * space.weight[word[part], None])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
        near = vectors @ space.passages.T >= MIN_COSINE
        for p, row, i in zip(centre[at : at + SLICE].tolist(), back.tolist(), item[at : at + SLICE].tolist()):
            if near[row, first[i] : first[i + 1]].any():
                yield int(text[p]), i, int(begin[p]), int(end[p + 1] if follows[p] else end[p])


LEAK = StructType(
    [
        StructField("item_id", LongType()),
        StructField("common", DoubleType()),
    ]
)
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.float64())]))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """``(text, item_id, n_items)``: each text of the benchmark once, with its least id and its number of rows."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    return rows.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", rank: int = RANK) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items found in each whole text, and their common share.

    ``benchmark`` has ``item_id`` and ``text``. IDF counts cover all documents, in one pass;
    documents are folded into the latent space of the items' passages, so they are never
    shuffled. A passage is compared if it and its surroundings hold enough of an item's
    rarer words, which every leak does. Items are searched in blocks of about 4,000 half
    passages, one pass over the documents each, which bounds what is broadcast.

    A text leaks an item if the longest common subsequence around a passage near it holds
    80 % of the item's words, or 60 % with the item's last words; items of fewer than 6 words
    must stand word by word, and items without a word leak nowhere. Items of one text are
    one class, named by its least id (``item_classes`` has the number of its rows). A null
    text counts as empty and leaks nothing; repeated documents count each; empty tables give
    empty results; a column named ``leaks`` is replaced. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    ship_package(spark)
    classes = written(item_classes(benchmark).withColumn("halves", F.ceil(F.size(split_words(F.col("text"))) / HALF)), "items")
    n_blocks = max(1, -(-(classes.agg(F.sum("halves")).first()[0] or 0) // BLOCK_PASSAGES))
    found = docs.drop("leaks").withColumn("leaks", F.array().cast(ArrayType(LEAK)))
    blocks_of_items = [classes.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b) for b in range(n_blocks)]
    vocabulary = np.unique(np.concatenate([read_items(block.collect()).vocabulary for block in blocks_of_items]))
    if not len(vocabulary):
        return found
    n, frequency = document_frequency(docs, vocabulary, text)
    for block in blocks_of_items:
        items = read_items(block.collect())
        if not len(items.vocabulary):
            continue
        own = frequency[_numbers(items.vocabulary, vocabulary)]
        space = latent_space(block, items, word_weights(n, own), rank)
        shared = spark.sparkContext.broadcast((space, rare_words(items, own), items.words, items.ids))
        found = _searched(found, shared, text)
    return found


def _searched(docs: DataFrame, shared, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, rare, words, ids = shared.value
        for batch in batches:
            texts = [folded(t) for t in batch.column("__text").to_pylist()]
            leaks = batch.column("leaks").to_pylist()
            for block in blocks(texts):
                number, hashes = _words(texts[block])
                first = np.searchsorted(number, np.arange(len(texts[block]) + 1))
                best: dict[tuple[int, int], float] = {}
                for t, i, begin, end in candidates(space, rare, number, hashes):
                    if best.get((t, i), 0) == 1:
                        continue
                    own = hashes[first[t] : first[t + 1]]
                    share, _, leaked = check(own, begin - first[t], end - first[t], words[i])
                    if leaked:
                        best[t, i] = max(share, best.get((t, i), 0))
                for (t, i), share in sorted(best.items()):
                    leaks[block.start + t].append({"item_id": ids[i], "common": share})
            at = batch.schema.get_field_index("leaks")
            yield batch.set_column(at, "leaks", pa.array(leaks, _LEAK_ARROW)).drop_columns(["__text"])

    return docs.withColumn("__text", F.col(text)).mapInArrow(run, docs.schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with their own columns."""
    mine = docs.withColumns({"__own_leaks": F.col("leaks")}) if "leaks" in docs.columns else docs
    clean = find_leaks(mine, benchmark, text).filter(F.size("leaks") == 0)
    return clean.select(*(F.col("__own_leaks" if c == "leaks" else c).alias(c) for c in docs.columns))
