"""Phrase collocations: an FM-index of each shard counts its n-grams, Spark sums them across shards.

A shard is some 600,000 words of one language inside one task. Its index holds the text
sorted by the first few words only (depth-limited), which is all that counts of short
phrases need: a phrase is an interval of that order, and one backward step per word finds
the interval of every phrase that is one word longer. Kept in both directions, intervals
extend to the left and to the right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import LOWER, UPPER, mix, written

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2_000
SCALE = 2_000_000
COVERED_PERCENT = 80  # a longer phrase this frequent against a shorter one inside it replaces it
NO_LANGUAGE = "und"
SHARD_BYTES = 4_000_000  # text indexed at once, about 600,000 words
FILTER_BITS = 1 << 26  # of the Bloom filter of frequent word pairs: 8 MB, whatever the corpus

_KIND = np.zeros(256, dtype=np.uint8)  # 0: part of a word, 1: between words, 2: ends a piece
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Shard:
    """Word ids in text order, 0 after each piece, and the words of ids 1, 2, ..."""

    ids: np.ndarray
    words: pa.Array


def read_shard(texts: list[bytes]) -> Shard:
    joined = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", dtype=np.uint8)
    kind = _KIND[joined]
    inside = kind == 0
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return Shard(np.zeros(1, dtype=np.int64), pa.array([], pa.string()))
    offsets = np.zeros(len(first) + 1, dtype=np.int32)
    np.cumsum(end - first, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(joined[inside].tobytes()))
    coded = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), first)
    gaps = np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
    ids = np.zeros(len(first) + int(gaps[-1]) + 1, dtype=np.int64)
    ids[np.arange(len(first)) + gaps] = coded.indices.to_numpy().astype(np.int64) + 1
    return Shard(ids, coded.dictionary)


class Direction:
    """FM-index of cyclic ids, sorted by ``depth`` of them; a step extends phrases towards the front."""

    def __init__(self, ids: np.ndarray, depth: int):
        n, symbols = len(ids), int(ids.max()) + 1
        order_by, size, covered = ids, symbols, 1
        while covered < depth:  # order of the first 2, 4, ... words
            if covered > 1:
                distinct, order_by = np.unique(order_by, return_inverse=True)
                size = len(distinct)
            order_by = order_by * size + np.roll(order_by, -covered)
            covered *= 2
        order = np.argsort(order_by, kind="stable")
        self.n = n
        self.before = ids[order - 1]  # the Burrows-Wheeler transform
        by_symbol = np.argsort(self.before, kind="stable")
        self.keys = self.before[by_symbol] * n + by_symbol
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=symbols))])

    def step(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All one-word extensions of some phrases' intervals.

        Of each: the phrase, the word, the interval's begin, its size, and how many
        occurrences of the phrase extend by a smaller word or stand at a piece's edge.
        """
        size = high - low
        phrase = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size) + low[phrase]
        symbols = len(self.starts)
        pair, count = np.unique(phrase * symbols + self.before[row], return_counts=True)
        phrase, word = pair // symbols, pair % symbols
        seen = np.cumsum(count) - count
        smaller = seen - seen[np.searchsorted(phrase, phrase)]
        begin = np.searchsorted(self.keys, word * self.n + low[phrase])
        real = word > 0
        return phrase[real], word[real], begin[real], count[real], smaller[real]


class Phrases:
    """Phrases of one length: their words, and their intervals to the left and to the right."""

    def __init__(self, words: np.ndarray, left: np.ndarray, right: np.ndarray, count: np.ndarray):
        self.words, self.left, self.right, self.count = words, left, right, count


class TwoWayIndex:
    """A shard's FM-index in both directions, for phrases of up to ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.to_left, self.to_right = Direction(ids, depth), Direction(ids[::-1].copy(), depth)

    def single_words(self) -> Phrases:
        starts = self.to_left.starts
        word = np.flatnonzero(np.diff(starts[1:]) > 0) + 1
        return Phrases(word[:, None], starts[word], self.to_right.starts[word], starts[word + 1] - starts[word])

    def extend(self, phrases: Phrases, left: bool) -> Phrases:
        """All phrases one word longer at that side; the other side's interval narrows in step."""
        if left:
            own, other, index = phrases.left, phrases.right, self.to_left
        else:
            own, other, index = phrases.right, phrases.left, self.to_right
        which, word, begin, count, smaller = index.step(own, own + phrases.count)
        old, opposite = phrases.words[which], other[which] + smaller
        if left:
            return Phrases(np.column_stack([word, old]), begin, opposite, count)
        return Phrases(np.column_stack([old, word]), opposite, begin, count)


def pair_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and their counts, pairs of words and theirs, by one step to the left of an index of depth 2."""
    index = Direction(ids, 2)
    word = np.flatnonzero(np.diff(index.starts[1:]) > 0) + 1
    low, high = index.starts[word], index.starts[word + 1]
    phrase, before, _, count, _ = index.step(low, high)
    return word, high - low, np.column_stack([before, word[phrase]]), count


def longer_phrases(ids: np.ndarray, frequent: np.ndarray, max_words: int) -> Iterator[Phrases]:
    """Phrases of 3 to ``max_words`` words all of whose pairs are frequent, with their counts.

    ``frequent`` tells of each place whether its word and the next are a frequent pair; the
    text is cut where they are not, which loses none of these phrases.
    """
    at = np.flatnonzero(frequent)
    if not len(at):
        return
    last = np.append(np.diff(at) > 1, True)  # a run of frequent pairs ends here: its second word follows
    out = np.zeros(len(at) + 2 * int(last.sum()), dtype=np.int64)
    place = np.arange(len(at)) + 2 * (np.cumsum(last) - last)
    out[place] = ids[at]
    out[place[last] + 1] = ids[at[last] + 1]
    index = TwoWayIndex(out, max_words)
    now = index.extend(index.single_words(), left=True)
    for length in range(3, max_words + 1):
        now = index.extend(now, left=length % 2 == 0)
        if not len(now.count):
            return
        yield now


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, 0 for the id 0."""
    return np.array([0, *(xxhash.xxh64_intdigest(w) for w in words.to_pylist())], dtype=np.uint64)


def _pair_hash(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    seed = np.uint64(xxhash.xxh64_intdigest(lang))
    return mix(mix(first + seed) * _ODD + second)


def filter_bits(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The three places of each hash in a Bloom filter of ``bits`` bits, a power of two."""
    for shift in (0, 20, 37):
        yield ((hashes >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``shard_bytes`` at a time.

    A text longer than that goes on alone, cut where a piece ends; a piece that is longer
    itself is one shard.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            view = text.as_buffer()
            if view is None or not view.size:
                continue
            raw = bytes(view)
            for part in [raw] if len(raw) <= shard_bytes else _parts(raw, shard_bytes):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= shard_bytes:
                    yield lang, held.pop(lang)
                    del sizes[lang]
        if sum(sizes.values()) >= 3 * shard_bytes:  # many languages at once
            lang = max(sizes, key=sizes.__getitem__)
            yield lang, held.pop(lang)
            del sizes[lang]
    yield from held.items()


def _parts(raw: bytes, limit: int) -> Iterator[bytes]:
    ends = np.flatnonzero(_KIND[np.frombuffer(raw, dtype=np.uint8)] == 2)
    begin = 0
    while begin < len(raw):
        to = np.searchsorted(ends, begin + limit)
        end = int(ends[to]) + 1 if to < len(ends) else len(raw)
        yield raw[begin:end]
        begin = end


_ROWS = "lang string, phrase string, n long"


def _batches(lang: str, words: pa.Array, phrases: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(counts), 100_000):
        part = phrases[i : i + 100_000] - 1
        text = [words.take(pa.array(part[:, j])) for j in range(part.shape[1])]
        joined = pc.binary_join_element_wise(*text, " ") if len(text) > 1 else text[0]
        n = pa.array(counts[i : i + 100_000].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), joined, n], ["lang", "phrase", "n"])


def _short(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Words and pairs of words of each shard; its number of words under the empty phrase."""
    for lang, texts in _shards(batches, shard_bytes):
        shard = read_shard(texts)
        if len(shard.words):
            word, n_word, pair, n_pair = pair_counts(shard.ids)
            total = pa.array([int(n_word.sum())])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), total], ["lang", "phrase", "n"])
            yield from _batches(lang, shard.words, word[:, None], n_word)
            yield from _batches(lang, shard.words, pair, n_pair)


def _long(batches: Iterator[pa.RecordBatch], shared, max_words: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    bits = np.frombuffer(shared.value, dtype=np.uint8)
    for lang, texts in _shards(batches, shard_bytes):
        shard = read_shard(texts)
        if not len(shard.words):
            continue
        ids, hashes = shard.ids, word_hashes(shard.words)
        frequent = np.append((ids[:-1] > 0) & (ids[1:] > 0), False)
        at = np.flatnonzero(frequent)
        for place in filter_bits(_pair_hash(hashes[ids[at]], hashes[ids[at + 1]], lang), 8 * len(bits)):
            frequent[at] &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        for phrases in longer_phrases(ids, frequent, max_words):
            yield from _batches(lang, shard.words, phrases.words, phrases.count)


def _pair_filter(pairs: DataFrame, bits: int) -> bytes:
    """A Bloom filter of the pairs ``(lang, phrase)``: a fixed number of bits, or-ed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            halves = [p.split(" ") for p in batch.column(1).to_pylist()]
            for lang in set(langs):
                own = [h for h, other in zip(halves, langs) if other == lang]
                first, second = (np.array([xxhash.xxh64_intdigest(h[j]) for h in own], dtype=np.uint64) for j in (0, 1))
                for place in filter_bits(_pair_hash(first, second, lang), bits):
                    word, mask = pa.array(place >> 6), pa.array((1 << (place & 63).astype(np.uint64)).view(np.int64))
                    yield pa.RecordBatch.from_arrays([word, mask], ["word", "mask"])

    found = pairs.select("lang", "phrase").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.tobytes()


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES, bits: int = FILTER_BITS,
) -> DataFrame:
    """``(lang, phrase, n)``: all phrases of 1 to ``max_words`` words found ``min_count`` times or more.

    The empty phrase carries the number of all words of the language. Two passes over the
    texts: words and pairs, summed across shards; then longer phrases, of which only those
    made of frequent pairs are enumerated. The tasks know the frequent pairs by a Bloom
    filter of fixed size, so a pair too many costs work and a frequent one is never missed.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("text is not null")

    def summed(local: DataFrame) -> DataFrame:
        total = local.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        return written(total.filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")

    short = summed(rows.mapInArrow(lambda batches: _short(batches, shard_bytes), _ROWS))
    if max_words < 3:
        return short
    shared = docs.sparkSession.sparkContext.broadcast(_pair_filter(short.filter(_length() == 2), bits))
    return short.unionByName(summed(rows.mapInArrow(lambda batches: _long(batches, shared, max_words, shard_bytes), _ROWS)))


def _length() -> Column:
    """Words of a phrase; words hold no space."""
    return F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)


def _words(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def with_extensions(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Counted phrases with ``n_left`` and ``n_right``: the counts of their most frequent one-word extensions."""
    split = counts.filter("phrase != ''").withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    side = lambda begin, name: split.filter("size > 1").select("lang", _words(begin, F.col("size") - 1).alias("phrase"), F.col("n").alias(name))
    longer = side(2, "n_left").unionByName(side(1, "n_right"), allowMissingColumns=True)
    best = longer.groupBy("lang", "phrase").agg(F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right"))
    return split.join(best, ["lang", "phrase"], "left").fillna(0, ["n_left", "n_right"])


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(30,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    top: int = TOP, covered_percent: int = COVERED_PERCENT, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Each language's ``top`` phrases: ``lang rank phrase a l r n score``.

    Words are what stands between spaces and tabs of a piece, A-Z in lower case; pieces end
    at ``. , ; : ! ?`` and line ends. ``a`` counts a phrase of 2 to ``max_words`` words, at
    least ``min_count``; its cut after k words scores floor(2,000,000 a / (l + r)) with the
    counts of the parts, and the lowest cut counts, ties to the smallest k. Phrases inside a
    longer one with at least ``covered_percent`` of their count are dropped: counts only fall
    as phrases grow, so the extensions by one word decide. Ties of a score go to the more
    frequent phrase, then by its bytes. ``n`` counts the language's words.

    A null language is ``und``; null and empty texts, and repeated rows, count as they stand
    (the latter once each); an empty table and languages without a frequent phrase give no
    rows; other columns are ignored, whatever their names. A text of any length is cut into
    shards where a piece ends. A piece beyond 4 MB is a shard of its own.
    """
    counts = written(phrase_counts(docs, text, lang, max_words, min_count, shard_bytes), "phrase-counts")
    known = counts.select("lang", "phrase", "n")
    phrases = with_extensions(counts, max_words).filter("size > 1").filter(
        (F.greatest(_exact("n_left"), _exact("n_right")) * 100 < _exact("n") * covered_percent)
    )
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        _words(1, F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"),
    )
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr(f"({SCALE}BD * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0))"))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")
    ).select("lang", "phrase", "cut.score", "cut.a", "cut.l", "cut.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = counts.filter("phrase = ''").select("lang", "n")
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
