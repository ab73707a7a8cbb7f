"""URL filters: rules by host and path, and boosted trees on lexical features.

The rules judge the URLs they fit. Those judged URLs are the labelled ones:
gradient-boosted trees learn from them what a blocked URL looks like, and give
the verdict on URLs that no rule fits. Features and rules are built-in
functions; the trees are trained and applied by Spark's own library.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundledger.llm.shared import ASCII_LOWER, ASCII_UPPER, stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# The trees are fitted on about this many labelled URLs at most, drawn by hash.
TRAINING_URLS = 50_000
TREES, DEPTH = 12, 3
# Rates of suffixes are drawn towards the overall rate by so many URLs.
SMOOTHING = 20.0
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_rate", "entropy",
    "parameters", "query_length", "hyphens", "is_secure", "has_fragment", "suffix_rate",
    "domain_rate",
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    on_host = (host == rule.host) | host.endswith(f".{rule.host}")
    return on_host & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, NULL without one."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    none = F.lit(None).cast("string")
    return reduce(
        lambda rest, rule: F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(rest),
        reversed(ordered),
        none,
    )


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(df: DataFrame, url: str = "_url") -> DataFrame:
    """Adds the lexical features of a URL with ``host`` and ``path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    length = F.length(text)
    some = F.greatest(length, F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    letters = F.array_distinct(F.split(text, ""))
    # Shannon entropy in bits of the URL's characters.
    entropy = F.aggregate(
        letters,
        F.lit(0.0),
        lambda total, letter: total
        - F.when(letter == "", 0.0).otherwise(
            (lambda p: p * F.log2(p))(
                F.greatest(
                    (length - F.length(F.replace(text, letter, F.lit("")))) / some,
                    F.lit(1e-12),
                )
            )
        ),
    )
    values = {
        "url_length": length,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "labels": F.length("host") - F.length(F.translate("host", ".", "")),
        "digit_rate": (length - F.length(F.translate(text, "0123456789", ""))) / some,
        "entropy": entropy,
        "parameters": F.size(F.filter(F.split(query, "&"), lambda part: part != "")),
        "query_length": F.length(query),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "is_secure": text.startswith("https").cast("int"),
        "has_fragment": text.contains("#").cast("int"),
    }
    return df.withColumns({name: value.cast("double") for name, value in values.items()})


def suffix_rates(labelled: DataFrame, name: str, labels: int, overall: float) -> DataFrame:
    """Smoothed share of blocked URLs by the last labels of the host.

    A URL's own label counts in its rate; the smoothing keeps rare suffixes
    from telling it.
    """
    return labelled.groupBy(suffix(F.col("host"), labels).alias(f"_{name}")).agg(
        (
            (F.sum("label") + F.lit(SMOOTHING * overall)) / (F.count("*") + F.lit(SMOOTHING))
        ).alias(name)
    )


def with_rates(df: DataFrame, rates: dict[str, tuple[int, DataFrame]], overall: float):
    for name, (labels, table) in rates.items():
        df = df.withColumn(f"_{name}", suffix(F.col("host"), labels))
        df = df.join(table, f"_{name}", "left").drop(f"_{name}")
        df = df.withColumn(name, F.coalesce(name, F.lit(overall)))
    return df


def fit_trees(labelled: DataFrame, seed: int = 5) -> GBTClassificationModel:
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(labelled)
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
        maxBins=64, stepSize=0.3, seed=seed,
    )
    return trees.fit(assembled.select("_features", "label"))


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    page_id: str = "page_id",
    rules: tuple[Rule, ...] = RULES,
    training_urls: int = TRAINING_URLS,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``.

    NULL and texts without ``://`` have an empty host and path, which no rule
    fits. URLs without a rule get the trees' verdict; where the labelled URLs
    are of one kind or none, there is nothing to learn and they are allowed or
    get the only verdict seen. Repeated rows are judged each. An empty table
    gives an empty result.
    """
    parts = pages.select(
        F.col(page_id).alias("_id"),
        F.col(url).alias("_url"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    host, path = F.col("host"), F.col("path")
    judged = parts.select(
        "*",
        longest_rule(rules, host, path, lambda r: r.host + r.path).alias("rule"),
        longest_rule(rules, host, path, lambda r: r.verdict).alias("_verdict"),
    )
    label = (F.col("_verdict") == "block").cast("double")
    known = judged.where("rule is not null").withColumn("label", label)
    seen = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    out = [F.col("_id").alias(page_id), "host", "path", "rule"]
    if not seen.n or seen.blocked in (0, seen.n):
        verdict = "block" if seen.n and seen.blocked == seen.n else "allow"
        return judged.select(*out, F.coalesce("_verdict", F.lit(verdict)).alias("verdict"))
    overall = seen.blocked / seen.n
    rates = {
        name: (labels, stored(suffix_rates(known, name, labels, overall), f"url-{name}"))
        for name, labels in (("suffix_rate", 1), ("domain_rate", 2))
    }
    # The sample is drawn by a hash of the URL: every row of a URL or none.
    share = min(1.0, training_urls / seen.n)
    drawn = F.pmod(F.xxhash64("_url"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = with_rates(lexical(known.where(drawn)), rates, overall)
    model = fit_trees(stored(sample.select(*FEATURES, "label"), "url-sample"))
    unknown = with_rates(lexical(judged.where("rule is null")), rates, overall)
    assembled = VectorAssembler(
        inputCols=list(FEATURES), outputCol=model.getFeaturesCol()
    ).transform(unknown)
    predicted = model.transform(assembled).select(
        *out, F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("verdict")
    )
    return known.select(*out, F.col("_verdict").alias("verdict")).unionByName(predicted)
