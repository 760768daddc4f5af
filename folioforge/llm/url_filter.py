"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions: the training table is gathered into one row of arrays (at most ``MAX_TRAINING``
addresses), a fold over that row runs the gradient steps, and its weights are a literal of the scoring expression,
which is evaluated where the pages lie, without a shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end. Host and path n-grams are hashed with different salts; each of the two gives the mean weight of its n-grams.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and the verdict of the model's
intercept; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import url_examples

BUCKETS = 2048
SIZES = (3, 4)
MAX_TRAINING = 2000
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """[rule, verdict] of the longest rule that fits, else null."""
    tests = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, under = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + under)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        tests = F.when(fits, hit) if tests is None else tests.when(fits, hit)
    return F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")) if tests is None else tests


def buckets(part: Column, salt: str) -> Column:
    """Hash buckets of the character n-grams of ``^part$``; an empty part has none."""
    letters = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")

    def grams(cs: Column) -> Column:
        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(cs) - n + 1, F.lit(1)))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(salt), F.array_join(F.slice(cs, i, F.lit(n)), "")), F.lit(BUCKETS)).cast("int"))

        return F.concat(*(of_size(n) for n in SIZES))

    found = F.get(F.transform(F.array(letters), grams), F.lit(0))  # the letters are split once
    return F.when(F.length(part) > 0, found).otherwise(F.array().cast("array<int>"))


def _mean(grams: Column, weights: Column) -> Column:
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(weights, b))
    return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)


def train(examples: DataFrame, rounds: int = 20, ridge: float = 2e-5) -> list[float]:
    """Weights of host and path buckets and the intercept, from [url, label]; label 1 is block.

    Full gradient steps. Each bucket's rate is the inverse of its bound on the curvature, so no step overshoots: an
    example's features sum to at most 2, and p(1 - p) is at most a quarter.
    """
    host, path = host_and_path(F.col("url"))
    e = examples.filter("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_TRAINING)
    e = e.select(F.col("label").cast("double").alias("y"), buckets(host, "host").alias("h"), F.transform(buckets(path, "path"), lambda b: b + BUCKETS).alias("p"))
    e = e.withColumn("i", F.monotonically_increasing_id())
    one = lambda c: F.transform(F.col(c), lambda b: F.struct(b.alias("b"), (1.0 / F.size(c)).alias("x")))
    grams = e.select("i", "y", F.explode(F.concat(one("h"), one("p"))).alias("g")).groupBy("i", "y", "g.b").agg(F.sum("g.x").alias("x"))
    rows = grams.groupBy("i", "y").agg(F.sort_array(F.collect_list(F.struct("b", "x"))).alias("f"))
    rows = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "f"))).alias("rows"))
    size = 2 * BUCKETS + 1
    # each example knows its place in the row, so that a bucket can look up the residuals of those that hold it
    placed = F.transform("rows", lambda r, k: F.struct(k.alias("k"), r.y.alias("y"), r.f.alias("f")))
    flat = F.flatten(F.transform(placed, lambda r: F.transform(r.f, lambda g: F.struct(g.b.alias("b"), r.k.alias("k"), g.x.alias("x")))))
    table = rows.select(placed.alias("rows"), flat.alias("flat"))
    held = table.select(F.explode("flat").alias("t")).groupBy("t.b").agg(F.sort_array(F.collect_list(F.struct("t.k", "t.x"))).alias("own"))
    held = held.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("b", "own"))).alias("held"))
    table = table.select("rows").join(F.broadcast(held))  # one row each
    empty = F.array().cast("array<struct<k: int, x: double>>")
    n = F.greatest(F.size("rows"), F.lit(1))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda b: F.coalesce(F.try_element_at("held", b), empty))
    dense = F.transform(dense, lambda own: F.struct(own.alias("own"), (F.aggregate(own, F.lit(0.0), lambda a, g: a + g.x) * 0.5 / n + ridge).alias("curve")))
    table = table.select("rows", dense.alias("by_bucket"))

    def step(w: Column, _: Column) -> Column:
        def residual(r: Column) -> Column:
            z = F.aggregate(r.f, F.get(w, F.lit(size - 1)), lambda a, g: a + g.x * F.get(w, g.b))
            return (1.0 / (1.0 + F.exp(-z)) - r.y) / n

        def moved(res: Column) -> Column:
            grad = F.transform("by_bucket", lambda at, b: F.get(w, b) - (F.aggregate(at.own, F.lit(0.0), lambda a, g: a + g.x * F.get(res, g.k)) + ridge * F.get(w, b)) / at.curve)
            bias = F.get(w, F.lit(size - 1)) - F.aggregate(res, F.lit(0.0), lambda a, r: a + r)
            return F.concat(grad, F.array(bias))

        return F.get(F.transform(F.array(F.transform("rows", residual)), moved), F.lit(0))  # the residuals are evaluated once

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), size), step)
    found = table.select(fitted.alias("w")).first()
    return list(found.w) if found and found.w else [0.0] * size


def default_examples(spark: SparkSession) -> DataFrame:
    rows = F.from_json(F.lit(json.dumps([{"url": u, "label": y} for u, y in url_examples.examples()])), "array<struct<url: string, label: int>>")
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.4) -> DataFrame:
    """[page_id, host, path, rule, verdict, probability]; probability is the model's that the page is to be blocked."""
    host, path = host_and_path(F.col("url"))
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    z = _mean(buckets(F.col("host"), "host"), w) + _mean(F.transform(buckets(F.col("path"), "path"), lambda b: b + BUCKETS), w) + F.lit(weights[-1])
    seen = cut.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("probability", 1.0 / (1.0 + F.exp(-z)))
    modelled = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return seen.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", modelled).alias("verdict"), "probability")
