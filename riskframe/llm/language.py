"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import blocks

#: Bounds of the labelled sample: texts of each language, characters of a text (of a longer one
#: a stretch at a place given by its hash), and characters of all languages together, shared evenly.
SAMPLE_TEXTS = 64
SAMPLE_TEXT_CHARS = 4_000
SAMPLE_CHARS = 160_000
MAX_LANGUAGES = 500
DENSE = 62  # most frequent letters of the sample: columns of a table; edges of the others are searched
WINDOW = 1_024  # letters that are parsed in one go
UNKNOWN = "und"
SPACE, OTHER, PAD = 0, DENSE + 1, DENSE + 2
WIDTH = DENSE + 3  # classes from here on are the letters beyond the most frequent


@dataclass(frozen=True)
class Model:
    """Automata of all languages in one table of edges ``(state, letter class, next state)``.

    Row l of ``roots`` is the root of language l; ``cost`` turns a phrase into bits. ``alphabet``
    has every letter of the sample, the most frequent first.
    """

    languages: tuple[str, ...]
    alphabet: str
    roots: np.ndarray
    states: int
    edges: np.ndarray
    cost: np.ndarray


def normalise(text: str) -> str:
    """Lower-cased letters; every run of anything else becomes one space."""
    return " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


def letter_class(place: int) -> int:
    """Class of the letter at a place of the alphabet."""
    return place + 1 if place < DENSE else place - DENSE + WIDTH


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """At most SAMPLE_TEXTS rows ``(lang, text)`` of each language: those of least text hash.

    A text of more than SAMPLE_TEXT_CHARS characters gives a stretch of that length from a
    place that its hash names. Hashes alone are ranked, cut inside the tasks first; the texts
    of the chosen hashes are read after, once for each hash.
    """
    long = F.length(text) - SAMPLE_TEXT_CHARS
    start = F.when(long > 0, F.pmod(F.xxhash64(text), long + 1)).otherwise(0) + 1
    fit = labelled.select(
        F.col(lang).alias("lang"), F.substring(F.col(text), start.cast("int"), F.lit(SAMPLE_TEXT_CHARS)).alias("text")
    )
    fit = fit.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    least = fit.select("lang", "h").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_TEXTS)
    cuts = least.groupBy("lang").agg(F.max("h").alias("cut")).limit(MAX_LANGUAGES + 1).collect()
    if len(cuts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not cuts:
        return fit.select("lang", "text").filter(F.lit(False))
    cut = F.create_map(*(F.lit(x) for r in cuts for x in (r["lang"], r["cut"])))
    chosen = fit.filter(F.col("h") <= F.element_at(cut, F.col("lang")))
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).drop("h")


def learnt_text(texts: set[str], share: int) -> str:
    """The sample of a language: its texts in the order of a hash, cut at ``share`` characters."""
    return " ".join(sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t)))[:share]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Automata from a bounded sample of the labelled rows (see the constants); rows without a language are left out."""
    texts: dict[str, set[str]] = {}
    for r in sample(labelled, text, lang).toLocalIterator():
        texts.setdefault(r["lang"], set()).add(normalise(r["text"]))
    languages = tuple(sorted(texts))
    share = SAMPLE_CHARS // max(1, len(languages))
    learnt = {x: learnt_text(texts[x], share) for x in languages}
    letters = Counter(c for x in learnt.values() for c in x if c != " ")
    alphabet = "".join(sorted(letters, key=lambda c: (-letters[c], c)))
    classes = {c: letter_class(i) for i, c in enumerate(alphabet)} | {" ": SPACE}
    roots, edges, at = [], [], 0
    for x in languages:
        moves = suffix_automaton([classes[c] for c in learnt[x]])
        roots.append(at)
        edges.extend((at + s, c, at + t) for s, m in enumerate(moves) for c, t in m.items())
        at += len(moves)
    cost = np.array([math.log2(len(learnt[x]) + 1) for x in languages])
    return Model(languages, alphabet, np.array(roots, np.int32), at, np.array(edges, np.int32).reshape(-1, 3), cost)


class Parser:
    """A model laid out for array steps: one table of next states for all languages.

    The table has the most frequent letters; edges of all others, and there may be thousands
    of letters, are a sorted list of numbers.
    """

    def __init__(self, model: Model):
        self.model = model
        table = np.full((model.states, WIDTH), -1, dtype=np.int32)
        state, letter, to = model.edges.T
        dense = letter < WIDTH
        table[state[dense], letter[dense]] = to[dense]
        self.classes = WIDTH + max(0, len(model.alphabet) - DENSE)
        keys = state[~dense].astype(np.int64) * self.classes + letter[~dense]
        order = np.argsort(keys)
        # a last key that no letter has, so that every search ends inside
        self.rare_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rare_to = np.append(to[~dense][order], 0).astype(np.int32)
        # where no move exists, a new phrase starts with this letter from the language's root
        sizes = np.diff(np.append(model.roots, model.states))
        for root, size in zip(model.roots, sizes):
            restart = np.where(table[root] >= 0, table[root], root)
            own = table[root : root + size]
            own[:] = np.where(own >= 0, own, ~restart[None, :])
        table[:, PAD] = np.arange(model.states)
        self.table = table.ravel()
        self.letters = np.full(0x110000, SPACE, dtype=np.int32)
        classes = {c: letter_class(i) for i, c in enumerate(model.alphabet)}
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.letters[code] = classes.get(c.lower()[0], OTHER)

    def _rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states by letters beyond the table; where no edge exists, the complement of the new phrase's state."""

        def follow(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = states.astype(np.int64) * self.classes + letter
            at = np.searchsorted(self.rare_keys, key)
            return self.rare_keys[at] == key, self.rare_to[at]

        root = np.broadcast_to(self.model.roots[:, None], state.shape)
        known, to = follow(state)
        begun, first = follow(root)
        return np.where(known, to, ~np.where(begun, first, root))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language (texts x languages), and its letters and spaces.

        Whole texts, in windows of WINDOW letters; a phrase ends where its language's sample
        has no such continuation.
        """
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype="<u4")
        letter = self.letters[codes]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(-1, ends)))[: len(codes)]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (letter[1:] != SPACE) | (letter[:-1] != SPACE)
        keep[:1] = letter[:1] != SPACE
        letter, owner = letter[keep], owner[keep]
        size = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(size) - size
        windows = -(-size // WINDOW)
        of_text = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(letter)) - begin[owner]
        grid = np.full((WINDOW, len(of_text)), PAD, dtype=np.int32)
        grid[place % WINDOW, (np.cumsum(windows) - windows)[owner] + place // WINDOW] = letter
        state = np.repeat(self.model.roots[:, None], len(of_text), axis=1)
        breaks = np.zeros(state.shape, dtype=np.int32)
        rare = grid >= WIDTH
        with_rare = rare.any(axis=1)
        for row, step in enumerate(grid):
            if with_rare[row]:
                moved = self.table[state * WIDTH + np.where(rare[row], OTHER, step)]
                at = np.flatnonzero(rare[row])
                moved[:, at] = self._rare(state[:, at], step[at])
            else:
                moved = self.table[state * WIDTH + step]
            failed = moved < 0
            breaks += failed
            state = np.where(failed, ~moved, moved)
        count = np.zeros((len(texts), len(self.model.roots)), dtype=np.int64)
        np.add.at(count, of_text, breaks.T + 1)
        return count, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return names, scores
        full = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for block in blocks([texts[i] for i in full]):
            own = full[block]
            count, size = self.phrases([texts[i] for i in own])
            bits = count * self.model.cost / np.maximum(size, 1)[:, None]
            best = np.argmin(bits, axis=1)
            ordered = np.sort(bits, axis=1)
            margin = 1 - ordered[:, 0] / ordered[:, 1] if bits.shape[1] > 1 else np.ones(len(own))
            for i, b, m in zip(own, best, margin):
                names[i], scores[i] = self.model.languages[b], float(m)
        return names, scores


_PARSERS: dict[str, Parser] = {}


def _parser_of(name: str, shared) -> Parser:
    """The parser of a worker, laid out once for a model and not for every task."""
    if name not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[name] = Parser(shared.value)
    return _PARSERS[name]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` of every whole text; only the text is looked at.

    The language whose automaton cuts a text into the fewest phrases, each weighed by the
    bits that name a place in its sample, wins (of equal ones the first by name). The score
    is 1 minus the ratio of the least bits to the second least; 1 if one language is known.
    A text that is null or has no letter is ``und`` with score 0, and so is everything if no
    language was learnt. Repeated rows get equal results; columns named like the results
    are replaced; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    content = kept.withColumn("__text", F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser_of(name, shared)
        for batch in batches:
            names, scores = parser.predict(batch.column("__text").to_pylist())
            yield (
                batch.drop_columns(["__text"])
                .append_column("lang_pred", pa.array(names, pa.string()))
                .append_column("score", pa.array(scores, pa.float64()))
            )

    schema = content.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return content.mapInArrow(run, schema)
