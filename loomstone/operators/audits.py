"""Integrity checks and overlap audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete(df: DataFrame, group: list[str], key: str, first: int, last: int) -> DataFrame:
    """(group, key, problem): ids missing from first..last, ids beyond, and ids that come twice."""
    every = df.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(key))
    absent = every.join(df, [*group, key], "left_anti").withColumn("problem", F.lit("missing"))
    beyond = df.where(~F.col(key).between(first, last)).select(*group, key).distinct().withColumn("problem", F.lit("unexpected"))
    twice = df.groupBy(*group, key).count().where("count > 1").select(*group, key, F.lit("duplicate").alias("problem"))
    return absent.unionByName(beyond).unionByName(twice)


def require_none(problems: DataFrame, what: str) -> None:
    """Raises if a table of problems has a row; names the first few."""
    found = problems.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def gold_conflicts(df: DataFrame, keys: list[str], gold: str, method: str, methods: int) -> DataFrame:
    """Samples whose gold differs between methods, or that some method lacks."""
    seen = df.groupBy(*keys).agg(F.countDistinct(gold).alias("golds"), F.countDistinct(method).alias("methods"))
    return seen.where((F.col("golds") != 1) | (F.col("methods") != methods))


def verified(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, predicted, expected, missing, extra, error, matched): answers against gold; an error is never a match. ``predicted`` has (qid, answer, error)."""
    both = expected.join(predicted, "qid", "left")
    empty = F.array().cast("array<bigint>")
    p, g = F.coalesce("answer", empty), F.coalesce("gold", empty)
    return both.select("qid", p.alias("predicted"), g.alias("expected"), F.array_sort(F.array_except(g, p)).alias("missing"), F.array_sort(F.array_except(p, g)).alias("extra"), "error", (F.col("error").isNull() & (F.array_sort(p) == F.array_sort(g))).alias("matched"))


def constant_offset(a: Column, b: Column) -> Column:
    """An aggregate: the one difference b - a; null if there are several."""
    return F.when(F.min(b - a) == F.max(b - a), F.min(b - a))


def overlap(train: DataFrame, test: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """One row: distinct keys on each side, those on both, rates and Jaccard. Sides are folded before they meet."""
    one = train.select(*keys).distinct().withColumn("train", F.lit(1)).withColumn("test", F.lit(0))
    two = test.select(*keys).distinct().withColumn("train", F.lit(0)).withColumn("test", F.lit(1))
    met = one.union(two).groupBy(*keys).agg(F.max("train").alias("train"), F.max("test").alias("test"))
    sums = met.agg(F.sum("train").alias("train_unique"), F.sum("test").alias("test_unique"), F.sum(F.col("train") * F.col("test")).alias("overlap"))
    rate = lambda n: F.coalesce(F.try_divide("overlap", n), F.lit(0.0))
    return sums.select(F.lit(metric).alias("metric"), "train_unique", "test_unique", "overlap", rate("test_unique").alias("test_overlap_rate"), rate("train_unique").alias("train_overlap_rate"), rate(F.col("train_unique") + F.col("test_unique") - F.col("overlap")).alias("jaccard"))


def overlaps(train: DataFrame, test: DataFrame, views: dict[str, list[str]]) -> DataFrame:
    """The overlap of each named view of the key columns."""
    return reduce(DataFrame.union, [overlap(train, test, name, keys) for name, keys in views.items()])


def exposure(samples: DataFrame, seen: DataFrame, sample: str, key: str) -> DataFrame:
    """(sample, total, seen, rate, any_seen, all_seen): how many of a sample's distinct keys the training side has."""
    keys = samples.select(sample, key).distinct()
    flagged = keys.join(seen.select(key).distinct().withColumn("known", F.lit(1)), key, "left")
    out = flagged.groupBy(sample).agg(F.count("*").alias("total"), F.count("known").alias("seen"))
    return out.select(sample, "total", "seen", (F.col("seen") / F.col("total")).alias("rate"), (F.col("seen") > 0).cast("int").alias("any_seen"), (F.col("seen") == F.col("total")).cast("int").alias("all_seen"))


def exact_signatures(train: DataFrame, test: DataFrame, signature: list[str]) -> DataFrame:
    """Test rows whose whole signature occurs in training."""
    return test.join(train.select(*signature).distinct(), signature, "left_semi")


def anomalies(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each check that a record fails: the record and ``anomaly``."""
    named = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    return df.withColumn("anomaly", F.explode(F.filter(named, lambda x: x.isNotNull())))


def reconciled(stated: DataFrame, parts: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Stated totals against sums of parts: for each total the sum and whether they agree."""
    total = parts.groupBy(*keys).agg(*[F.sum(part).alias(f"sum_{name}") for name, part in sums.items()])
    both = stated.join(total, keys, "left")
    return both.select(*keys, *[c for name in sums for c in (F.col(name), F.col(f"sum_{name}"), F.coalesce(F.col(name) == F.col(f"sum_{name}"), F.lit(False)).cast("int").alias(f"{name}_ok"))])


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    return a.select(*keys).join(b, keys, "left_anti").withColumn("absent_in", F.lit("right")).unionByName(b.select(*keys).join(a, keys, "left_anti").withColumn("absent_in", F.lit("left")))
