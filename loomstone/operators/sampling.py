"""Samples and splits by hash order: the same rows on any cluster, with any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(seed: str, *keys: str) -> Column:
    """A row's place: SHA-256 of the seed and its keys."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def unit(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from a row's keys."""
    return F.conv(F.substring(order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def group_seed(seed: int, group: str) -> Column:
    """A seed of its own for each group: the seed and the codes of the group's letters added up."""
    letters = F.transform(F.split(F.col(group), ""), lambda c: F.ascii(c))
    return F.lit(seed) + F.aggregate(letters, F.lit(0), lambda a, x: a + x)


def per_group_seeded(df: DataFrame, group: str, k: int, seed: int, keys: list[str]) -> DataFrame:
    """At most k rows of each group, the first in hash order under the group's own seed, with their place ``n``."""
    place = F.sha2(F.concat_ws("|", group_seed(seed, group).cast("string"), *[F.col(c).cast("string") for c in keys]), 256)
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(place, *keys))).where(F.col("n") <= k)


def per_group(df: DataFrame, group: list[str], k: int, seed: str, keys: list[str]) -> DataFrame:
    """At most k rows of each group, the first in hash order, with their place ``n``. The window's limit is applied before the shuffle too."""
    w = Window.partitionBy(*group).orderBy(order(seed, *keys), *keys)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def split(df: DataFrame, group: list[str], share: float, seed: str, keys: list[str]) -> DataFrame:
    """Adds ``part``: train for the first floor(share * n) rows of each group in hash order, else test."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy(order(seed, *keys), *keys))
    return df.withColumn("part", F.when(n <= F.floor(F.lit(share) * F.count("*").over(w)), "train").otherwise("test"))


def shuffled(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    return df.orderBy(order(seed, *keys), *keys)


def top_k(df: DataFrame, value: str, k: int, first_seen: str) -> DataFrame:
    """The k most frequent values; ties go to the value seen first."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(first_seen).alias("seen")).orderBy(F.desc("n"), "seen").limit(k)


def local_ids(df: DataFrame, group: str, by: str) -> DataFrame:
    """Adds ``local_id``, group_0001 and so on, in the order of ``by``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(by))
    return df.withColumn("local_id", F.format_string("%s_%04d", F.col(group), n))
