"""URL filters: listed host and path rules, and rules mined by FP-growth, matched by inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written

ALLOW, BLOCK = "allow", "block"
LABEL = "label="
# The listed rules, host and path in one string.
LISTED = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)
MAX_LISTED = 1_000  # listed rules become literals of the projection
MAX_BROADCAST_RULES = 20_000


def _parts(url: Column) -> Column:
    """Struct of host (A-Z lower-cased) and path; both empty for a null or a text without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))

    def cut(r: Column) -> Column:
        host = F.regexp_extract(r, r"^[^/?#]*", 0)
        return let(
            host,
            lambda h: F.struct(
                ascii_lower(h).alias("host"),
                F.regexp_extract(F.substring(r, F.length(h) + 1, F.length(r)), r"^[^?#]*", 0).alias("path"),
            ),
        )

    return let(F.coalesce(rest, F.lit("")), cut)


def _listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins its path."""
    if len(rules) > MAX_LISTED:
        raise ValueError(f"{len(rules)} listed rules, more than {MAX_LISTED}")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own_host, slash, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + own_path)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels, path segments and query keys; runs of digits become 0."""
    plain = lambda x: F.regexp_replace(ascii_lower(x), r"[0-9]+", "0")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    marked = [
        F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))
        for mark, values in (("h:", F.split(host, r"\.")), ("p:", F.split(path, "/")), ("q:", keys))
    ]
    return F.array_distinct(F.concat(*marked))


def parse(pages: DataFrame, rules: Sequence[tuple[str, str]] = LISTED, url: str = "url") -> DataFrame:
    """``pages`` with a struct ``__url``: host, path, tokens, listed rule and its verdict."""
    address = F.coalesce(F.col(url), F.lit(""))

    def of(p: Column) -> Column:
        return let(
            _listed(p["host"], p["path"], rules),
            lambda b: F.struct(
                p["host"].alias("host"),
                p["path"].alias("path"),
                _tokens(address, p["host"], p["path"]).alias("tokens"),
                b["rule"].alias("rule"),
                b["verdict"].alias("verdict"),
            ),
        )

    return pages.withColumn("__url", let(_parts(F.col(url)), of))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int = 3
) -> DataFrame:
    """Rules ``(rule_id, tokens, verdict, confidence, support)`` from rows of ``tokens`` and ``label``.

    FP-growth over all labelled rows: the label is an item of its own, and rules that end in
    it survive if support and confidence suffice, they have at most ``max_tokens`` tokens and
    no rule with fewer of their tokens says the same at least as surely.
    """
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(
        F.col("consequent")[0].startswith(LABEL)
        & (F.size("antecedent") <= max_tokens)
        & ~F.exists("antecedent", lambda x: x.startswith(LABEL))
    ).select(
        F.array_sort("antecedent").alias("tokens"),
        F.substring(F.col("consequent")[0], len(LABEL) + 1, 1_000).alias("verdict"),
        "confidence",
        "support",
    )
    found = written(found.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "url-rules")
    shorter = found.select(
        F.col("tokens").alias("__less"), F.col("verdict").alias("__verdict"), F.col("confidence").alias("__confidence")
    )
    # A shorter rule is looked up by the tokens left when one or two go; no rules are paired freely.
    parts = found.select(
        "rule_id",
        "verdict",
        "confidence",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        "tokens",
                        lambda a: F.transform(
                            F.col("tokens"), lambda b: F.filter(F.col("tokens"), lambda x: (x != a) & (x != b))
                        ),
                    )
                )
            )
        ).alias("__less"),
    )
    useless = (
        parts.join(shorter, "__less")
        .filter((F.col("verdict") == F.col("__verdict")) & (F.col("__confidence") >= F.col("confidence")))
        .select("rule_id")
        .distinct()
    )
    return found.join(useless, "rule_id", "left_anti")


def fired(parsed: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``(key, verdict, confidence)`` of the surest mined rule all of whose tokens a row has.

    Rows meet rules in an inverted index, token to rules; a rule fires when as many of its
    tokens were met as it has. The index is broadcast while it has at most 20,000 rules, and
    joined by token beyond that.
    """
    index = rules.select(
        "rule_id", "verdict", "confidence", F.size("tokens").alias("__needs"), F.explode("tokens").alias("__token")
    )
    if rules.count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    met = (
        parsed.select(key, F.explode("__url.tokens").alias("__token"))
        .join(index, "__token")
        .groupBy(key, "rule_id")
        .agg(F.count(F.lit(1)).alias("__met"), F.first("__needs").alias("__needs"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"))
        .filter("__met >= __needs")
    )
    surest = F.max(F.struct("confidence", (F.col("verdict") == ALLOW).alias("ties_allow"), "verdict"))
    return met.groupBy(key).agg(surest.alias("__best")).select(
        key, F.col("__best.verdict").alias("__mined"), F.col("__best.confidence").alias("__confidence")
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = LISTED,
    url: str = "url",
    min_support: float = 0.01,
    min_confidence: float = 0.8,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict of every url.

    ``labels`` has ``url`` and ``label`` (allow or block) of known addresses; rules are mined
    from those that no listed rule decides. A listed rule decides first, then the surest
    mined one (of equal ones, allow), and without either the url is allowed. A null url, or one without ``://``, has an empty host and path, fits no
    rule and is allowed. Equal urls are judged once, so a hot one costs one row; columns of
    ``pages`` named like the results are replaced; empty tables give empty results.
    """
    known = parse(labels.select(F.col("url"), F.col("label")).filter("label is not null"), rules)
    mined = mine_rules(known.filter("__url.rule is null").select("__url.tokens", "label"), min_support, min_confidence)
    distinct = parse(pages.select(F.coalesce(url, F.lit("")).alias("__key")).distinct(), rules, "__key")
    best = fired(distinct.filter("__url.rule is null"), mined, "__key")
    plain = pages.drop("host", "path", "rule", "verdict", "mined_confidence")
    judged = parse(plain, rules, url).withColumn("__key", F.coalesce(url, F.lit("")))
    return judged.join(best, "__key", "left").select(
        *plain.columns,
        F.col("__url.host").alias("host"),
        F.col("__url.path").alias("path"),
        F.col("__url.rule").alias("rule"),
        F.coalesce("__url.verdict", "__mined", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("__url.rule").isNull(), F.col("__confidence")).alias("mined_confidence"),
    )
