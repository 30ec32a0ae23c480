"""URL filters: rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import importlib.resources

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.llm.common import literal_array

#: Lengths of the n-grams, and the number of features that they are hashed to.
NGRAMS, FEATURES = (3, 4, 5), 1 << 13
RIDGE, STEPS, RATE = 0.02, 400, 2.0
#: Most labelled URLs that are taken to train on: those of the smallest hash.
MOST_LABELLED = 5_000

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The small labelled table: URLs of common kinds of junk (gambling, pharmacies, replicas, adult, fraud, advertising, link farms) and of public sites, written by hand; 1 for junk.
LABELS = "url_labels.tsv"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, junk): the labelled table that comes with this module."""
    lines = importlib.resources.files(__package__).joinpath(LABELS).read_text("utf-8").splitlines()
    values = ", ".join(f"('{url}', {int(junk)})" for url, junk in (line.split("\t") for line in lines))  # no quotes in these
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, junk)")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; empty for null or where there is no ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What stands after the host up to ? # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams (0 to FEATURES - 1) of host and path, whose ends are marked."""
    text = F.concat(F.lit("^"), host, F.lit("|"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(n))), F.lit(FEATURES)).cast("int"))
        return F.when(F.length(text) >= n, grams).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*map(of, NGRAMS)))


def score(weights: np.ndarray, bias: float, host: Column, path: Column) -> Column:
    """Log-odds of junk: the mean weight of the features, scaled by the root of their number, and the bias."""
    table, grams = literal_array(weights), features(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return total / F.sqrt(F.size(grams)) + F.lit(float(bias))


def train(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the logistic loss with a ridge, over at most MOST_LABELLED labelled URLs. No rows, or one label only: weights of zero, and a bias for that label (none: allow)."""
    rows = (
        labelled.filter(F.col("junk").isNotNull())
        .select(F.col("junk").cast("double").alias("junk"), F.col("url"), features(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
        .orderBy(F.xxhash64("url"), "url", "junk")
        .limit(MOST_LABELLED)
        .select("junk", "grams")
        .collect()
    )
    y = np.array([r["junk"] for r in rows])
    if len(set(y)) < 2:
        return np.zeros(FEATURES), 1.0 if len(y) and y[0] else -1.0
    at = np.concatenate([np.array(r["grams"], int) for r in rows])
    size = np.array([len(r["grams"]) for r in rows])
    row, value = np.repeat(np.arange(len(rows)), size), np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    w, bias = np.zeros(FEATURES), 0.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(np.bincount(row, w[at] * value, len(rows)) + bias))) - y
        w -= RATE * (np.bincount(at, error[row] * value, FEATURES) / len(rows) * 8 + RIDGE * w / 8)
        bias -= RATE * error.mean()
    return w, bias


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, and the url's path starts with its path. Null if none does."""
    chain = F.lit(None).cast("string")
    for rule, _ in sorted(set(rules), key=lambda r: (len(r[0]), r[0])):
        its_host, slash, its_path = rule.partition("/")
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(slash + its_path)
        chain = F.when(fits, F.lit(rule)).otherwise(chain)
    return chain


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, log_odds): verdict `allow` or `block` of each url, by the longest rule that fits, else by logistic regression on hashed character n-grams of host and path (block above 0).

    A null url, or one without ://, has an empty host and path; the regression judges it like any other. Repeated rows and null ids are kept as they are. An empty table gives an empty one. Other columns are not looked at.
    """
    weights, bias = train(labelled)
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("log_odds", score(weights, bias, F.col("host"), F.col("path")))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
