"""Quality rules: a table of thresholds compiled into one projection (no user functions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, split_words, whole

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as be at by this from or an have not "
    "der die das und ist von den mit zu ein eine im für auf dem des sich nicht "
    "le la les de et un une est que qui dans pour sur du pas par avec ce "
    "el los las y en del se con por una lo su al es"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text if ``low <= 1000 * numerator / denominator <= high`` (an open end: None).

    Both sides are compared as integers, so no rounding decides; with a zero denominator
    the rule holds.
    """

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def holds(self, measures: Column) -> Column:
        top, base = measures[self.numerator] * 1000, measures[self.denominator]
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (top >= base * self.low)
        if self.high is not None:
            inside = inside & (top <= base * self.high)
        return inside


# Length, symbol, stop-word and line ratios, in thousandths.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2500, high=12_000),
    Rule("symbols per word", "n_symbols", "n_words", high=200),
    Rule("exclamation marks per word", "n_exclamations", "n_words", high=300),
    Rule("stop words per word", "n_stop_words", "n_words", low=50),
    Rule("capitals per character", "n_capitals", "word_chars", high=400),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", high=500),
)


def _without(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has at least twice."""

    def covered(windows: Column) -> Column:
        """Sort the windows; equal neighbours repeat; add up what their places cover."""
        ordered = F.array_sort(F.transform(windows, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

        def places(s: Column) -> Column:
            marked = F.transform(
                s,
                lambda x, k: F.when(
                    x["t"].eqNullSafe(F.get(s, k - 1)["t"]) | x["t"].eqNullSafe(F.get(s, k + 1)["t"]), x["i"]
                ),
            )
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        def words(p: Column) -> Column:
            steps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

        return let(let(ordered, places), words)

    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return let(
        windows,
        lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), covered(t)).otherwise(F.lit(0).cast("long")),
    )


def _measure(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def joined(by_word: Column, by_line: Column) -> Column:
        return F.struct(
            *(by_word[c].alias(c) for c in ("n_words", "n_repeat_words", "n_stop_words")),
            *(by_line[c].alias(c) for c in ("n_lines", "n_dup_lines")),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            _without(text, SYMBOLS).cast("long").alias("n_symbols"),
            _without(text, "!").cast("long").alias("n_exclamations"),
            _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        )

    return let(let(split_words(text), of_words), lambda a: let(let(lines, of_lines), lambda b: joined(a, b)))


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: the measures, ``base_failed``, ``failed`` (names) and ``kept``.

    One projection: no shuffle, no user function. Base: at least 50 words, and at most half
    of them in 3-word windows that repeat. A null text counts as empty and fails; repeated
    rows are judged alike; an empty table gives an empty result; a column named like
    ``into`` is replaced, every other column stays.
    """

    def judged(m: Column) -> Column:
        base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
        failed = F.array_compact(F.array(*(F.when(~r.holds(m), F.lit(r.name)) for r in rules)))
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines n_exclamations n_capitals"
        return F.struct(
            *(m[c].alias(c) for c in names.split()),
            base.alias("base_failed"),
            failed.alias("failed"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    return docs.withColumn(into, let(_measure(whole(text)), judged))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that meet every rule, with their own columns."""
    verdict = "__quality"
    return quality(docs, text, rules, verdict).filter(F.col(verdict)["kept"]).drop(verdict)
