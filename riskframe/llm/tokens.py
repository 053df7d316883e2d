"""Token counts; huge texts are cut into overlapping chunks whose encodings are spliced exactly."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import written

CHUNK = 32_768  # characters of a chunk; longer texts are cut
OVERLAP = 256  # characters that a chunk shares with the next, at first
#: A boundary counts if so many characters follow it in its chunk: more than any look-ahead
#: of the splitting pattern (1) and any special token's length.
MARGIN = 32
CACHE_WORDS = 400_000  # pieces that a worker remembers, twice

# What the tokenizers' patterns call white space. Python adds four control characters to these.
_SPACE_CODES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACES = "".join(map(chr, _SPACE_CODES))
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")

Count = Callable[[list[str]], list[int]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is a
    visible Latin-1 character, else the next free code from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# One word of Latin-1 letters, perhaps after a space and before punctuation without apostrophes.
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class PieceEncoder:
    """Values of pieces of text, remembered by a worker: ``keep(ids)`` of the tokenizer's ids.

    A plain word is what the tokenizer's pattern matches first (with its space) and its
    punctuation second, and nothing in it changes by normalisation but the case (``fold``),
    so the model's merges give its ids. Anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str, keep: Callable[[list[int]], object], fold: bool = False):
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.keep, self.fold = keep, fold
        self.letters = _byte_letters()
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def ids(self, piece: str) -> list[int]:
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        space, word, marks = plain.groups()
        if self.fold:
            space, word = "", word.lower()
        spelled = "".join(map(self.letters.__getitem__, (space + word).encode()))
        out = [t.id for t in self.model.tokenize(spelled)]
        return out + [t.id for t in self.model.tokenize(marks)] if marks else out

    def __call__(self, pieces: list[str]) -> list:
        for p in set(pieces):
            if p not in self.known:
                value = self.older.get(p)
                self.known[p] = self.keep(self.ids(p)) if value is None else value
        out = [self.known[p] for p in pieces]
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Count:
    """``count(pieces)`` of one worker."""
    return PieceEncoder(path, len)


def pieces_of(text: str) -> list[str]:
    """Cut after each run of non-space. The pattern never joins a non-space with a space after
    it, and special tokens hold no space, so a piece is encoded alone as in its text."""
    return _PIECE.findall(text)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each row with the tokens of its ``__text`` in place of the text."""
    count = counter(path)
    for batch in batches:
        totals: list[int] = []
        texts = batch.column("__text")
        for begin in range(0, len(texts), 200):
            split = [pieces_of(t.as_py()) for t in texts[begin : begin + 200]]
            counts, at = count([p for s in split for p in s]), 0
            for s in split:
                totals.append(sum(counts[at : at + len(s)]))
                at += len(s)
        yield batch.drop_columns(["__text"]).append_column("n_tokens", pa.array(totals, pa.int64()))


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            starts = range(0, len(text), chunk)
            parts = [text[i : i + chunk + overlap] for i in starts]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [key] * len(parts),
                    "number": pa.array(range(len(parts)), pa.int32()),
                    "offset": pa.array(starts, pa.int64()),
                    "length": pa.array([len(text)] * len(parts), pa.int64()),
                    "text": parts,
                }
            )


CUT = "key string, number int, offset long, length long, text string"


def _boundaries(text: str, offset: int, ended: bool, count: Count) -> tuple[list[int], list[int]]:
    """Places in the document where a piece of this chunk begins, and the tokens before each.

    Only places with enough text after them count, unless the document ends in this chunk;
    then its end is the last place.
    """
    pieces = pieces_of(text)
    places, tokens, at, total = [], [], 0, 0
    for piece, n in zip(pieces, count(pieces)):
        if ended or at + MARGIN <= len(text):
            places.append(offset + at)
            tokens.append(total)
        at += len(piece)
        total += n
    if ended:
        places.append(offset + at)
        tokens.append(total)
    return places, tokens


def _encoded(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its boundaries in the parts shared with the chunk before and the one after."""
    count = counter(path)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            offset = r["offset"]
            ended = offset + len(r["text"]) >= r["length"]
            places, tokens = _boundaries(r["text"], offset, ended, count)
            # a later chunk's first place is where it was cut, not a boundary of the document
            skip = 1 if offset else 0
            head = [(p, t) for p, t in zip(places[skip:], tokens[skip:]) if p <= offset + overlap]
            tail = [] if ended else [(p, t) for p, t in zip(places, tokens) if p >= offset + chunk]
            rows.append(
                {
                    "key": r["key"],
                    "number": r["number"],
                    "head": [p for p, _ in head],
                    "head_tokens": [t for _, t in head],
                    "tail": [p for p, _ in tail],
                    "tail_tokens": [t for _, t in tail],
                    "total": tokens[-1] if ended else None,
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_ENCODED_ARROW)


_LONGS = pa.list_(pa.int64())
_ENCODED_ARROW = pa.schema(
    [("key", pa.string()), ("number", pa.int32())]
    + [(c, _LONGS) for c in ("head", "head_tokens", "tail", "tail_tokens")]
    + [("total", pa.int64())]
)
ENCODED = (
    "key string, number int, head array<long>, head_tokens array<long>, "
    "tail array<long>, tail_tokens array<long>, total long"
)


def count_huge(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, n_tokens)`` of rows ``(key string, text string)`` with unique keys, by overlapping chunks.

    A chunk starts every ``chunk`` characters and reads ``overlap`` more. From a boundary on
    that a chunk and its successor share, both are encoded alike: it lies where non-space
    meets white space, so what stands before it does not matter, and enough text follows it
    in the earlier chunk. The splice is the first such boundary. Texts without one (a run of
    non-space longer than the overlap) take another round with a four times wider overlap,
    until a chunk reaches the end of the text.
    """
    done, left = None, texts
    while True:
        cut = left.mapInArrow(lambda batches, n=overlap: _cut(batches, chunk, n), CUT)
        encoded = written(
            cut.repartition("key", "number").mapInArrow(
                lambda batches, n=overlap: _encoded(batches, path, chunk, n), ENCODED
            ),
            "token-chunks",
        )
        following = encoded.select("key", (F.col("number") - 1).alias("number"), "head", "head_tokens")
        joined = encoded.drop("head", "head_tokens").join(following, ["key", "number"], "left")
        tokens_at = lambda side, place: F.element_at(
            f"{side}_tokens", F.array_position(side, place).cast("int")
        )
        splice = F.array_min(F.array_intersect("tail", "head"))
        parts = joined.withColumn("splice", splice).select(
            "key",
            F.struct(
                "number",
                F.when(F.col("total").isNotNull(), F.col("total"))
                .when(F.col("splice").isNotNull(), tokens_at("tail", F.col("splice")) - tokens_at("head", F.col("splice")))
                .alias("tokens"),
                F.col("total").isNotNull().alias("ended"),
            ).alias("part"),
        )
        # the first chunk that reaches the end closes the text; later ones only repeat its rest
        last = F.array_min(F.transform(F.filter("parts", lambda p: p["ended"]), lambda p: p["number"]))
        used = F.filter("parts", lambda p: p["number"] <= F.col("last"))
        totals = written(
            parts.groupBy("key")
            .agg(F.collect_list("part").alias("parts"))
            .withColumn("last", last)
            .select(
                "key",
                # an open splice makes the sum null
                F.aggregate(used, F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("n_tokens"),
            ),
            "token-totals",
        )
        closed = totals.filter("n_tokens is not null")
        done = closed if done is None else done.unionByName(closed)
        opened = totals.filter("n_tokens is null").select("key")
        if opened.isEmpty():
            return done
        left, overlap = left.join(opened, "key", "left_semi"), overlap * 4


def token_counts(
    docs: DataFrame, text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    A null text counts as empty: 0 and 0. Texts of at most ``chunk`` characters are encoded
    whole, longer ones in overlapping chunks dealt to all tasks; equal long texts are
    counted once. Repeated rows get equal counts, an empty table an empty result, columns
    named like the results are replaced.
    """
    ship_package(docs.sparkSession)
    path = path or default_tokenizer()
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    content = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(*kept, F.octet_length(content).cast("long").alias("n_bytes"), content.alias("__text"))
    schema = StructType([*plain.drop("__text").schema.fields]).add("n_tokens", "long")
    short = plain.filter(F.length("__text") <= chunk)
    counted = short.mapInArrow(lambda batches: _counted(batches, path), schema)
    huge = plain.filter(F.length("__text") > chunk).withColumn("__key", F.md5(F.col("__text").cast("binary")))
    texts = written(
        huge.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"]), "token-texts"
    )
    if texts.isEmpty():
        return counted
    totals = count_huge(texts, path, chunk, overlap).withColumnRenamed("key", "__key")
    return counted.unionByName(huge.drop("__text").join(totals, "__key").select(*counted.columns))
