"""Paired tests: sums and ranks in SQL, tails of the distributions in a small function.

Ranks come from a histogram of the sizes |d| of each group: a size's rank is the number of smaller ones plus half of its
own and a half.  The numbers of smaller ones are running sums over ranges of (group, size), so a group may be of any
length; nothing but the distinct sizes of one range stands in a task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.staged import written


def t_tail(t: float, df: int) -> float:
    """P(|T| > |t|) by Simpson's rule in the angle, where the density is a power of a cosine."""
    if math.isnan(t) or df < 1:
        return math.nan
    if math.isinf(t):
        return 0.0
    top, n = math.atan(abs(t) / math.sqrt(df)), 2000
    area = lambda a, b: (b - a) / n / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(a + (b - a) * i / n) ** (df - 1) for i in range(n + 1))
    half = math.pi / 2
    return max(0.0, min(1.0, area(top, half) / area(0.0, half)))


def t_quantile(p: float, df: int) -> float:
    """The t with P(T < t) = p, for p over one half."""
    low, high = 0.0, 1.0
    while 1 - t_tail(high, df) / 2 < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def normal_tail(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, int(b)) if pd.notna(a) and pd.notna(b) else math.nan for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    found = {d: t_quantile(0.975, int(d)) for d in set(df.dropna()) if d >= 1}
    return df.map(found)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_tail(a) if pd.notna(a) else math.nan for a in z])


@lru_cache(256)
def signed_rank_tails(n: int) -> np.ndarray:
    """P(W <= w) for w = 0 .. n (n + 1) / 2, W the sum of those of the ranks 1 .. n that a fair coin picks: a rank shifts and halves the distribution."""
    chance = np.zeros(n * (n + 1) // 2 + 1)
    chance[0] = 1.0
    for rank in range(1, n + 1):
        chance = (chance + np.concatenate([np.zeros(rank), chance[:-rank]])) / 2
    return np.cumsum(chance)


def signed_rank_p(w: float, n: int) -> float:
    """P of a sum of signed ranks 1 .. n at least as far from its mean as ``w``."""
    tails, at = signed_rank_tails(n), int(w)
    return min(1.0, 2 * float(min(tails[at], tails[len(tails) - 1 - at])))


@F.pandas_udf(T.DoubleType())
def exact_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """Null where either is: a UDF is run for every row, whatever CASE it stands in."""
    return pd.Series([signed_rank_p(a, int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(w, n, strict=True)], dtype="float64")


def planned(tests: DataFrame, expected: int) -> DataFrame:
    """(found, planned): the number of tests; another number than planned fails."""
    found = tests.agg(F.count("*").alias("found"))
    wrong = F.raise_error(F.format_string(f"%d tests where {expected} were planned", F.col("found"))).cast("bigint")
    return found.select(F.when(F.col("found") == expected, F.col("found")).otherwise(wrong).alias("found"), F.lit(expected).alias("planned"))


def paired(records: DataFrame, contrasts: list[tuple[str, str]], keys: list[str], sample: str, value: str) -> DataFrame:
    """(keys, contrast, sample, a, b, d): both values of two methods on the same samples and their difference b - a. Methods stand side by side after one fold; a sample that lacks one of them has no difference."""
    names = sorted({m for pair in contrasts for m in pair})
    side = records.groupBy(*keys, sample).agg(*[F.max(F.when(F.col("method") == m, F.col(value))).alias(f"m{i}") for i, m in enumerate(names)])
    of = lambda m: F.col(f"m{names.index(m)}")
    pairs = F.array(*[F.struct(F.lit(f"{a} -> {b}").alias("contrast"), of(a).alias("a"), of(b).alias("b"), (of(b) - of(a)).alias("d")) for a, b in contrasts])
    return side.select(*keys, sample, F.inline(pairs)).where("d IS NOT NULL").select(*keys, "contrast", sample, "a", "b", "d")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet null keys."""
    other = right.select(*[F.col(k).alias(f"other_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(F.col(f"other_{k}"))
    return left.join(other, same, how).drop(*[f"other_{k}" for k in keys])


def running(counts: DataFrame, group: list[str], by: str, n: str) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the rows of the same group with a smaller ``by``.

    Rows are dealt out by ranges of (group, by) and written; a range adds up its own rows, and the sums of whole ranges, one
    number for each range and group, are added up beside.
    """
    parts = written(counts.repartitionByRange(*group, by).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*group, "part").agg(F.sum(n).alias("held")).select(*group, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group, "part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    both = _matched(parts.withColumn("inside", F.coalesce(F.sum(n).over(inside), F.lit(0))), starts, [*group, "part"])
    return both.withColumn("before", F.col("start") + F.col("inside")).drop("start", "inside", "part")


def _size() -> Column:
    """Differences of one size share their ranks."""
    return F.round(F.abs("d"), 12)


def sizes(pairs: DataFrame, group: list[str], eps: float = 1e-12) -> DataFrame:
    """(group, size, n, plus, zero, rank): how many differences have a size, how many of them are above 0 or 0, and their mean rank in the group, zeros ranked too."""
    counts = pairs.groupBy(*group, _size().alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > eps).alias("plus"), F.count_if(F.abs("d") <= eps).alias("zero"))
    return running(counts, group, "size", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).drop("before")


def wilcoxon_ranks(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``rank``: the mean rank of |d| in its group, zeros ranked too."""
    return _matched(pairs.withColumn("size", _size()), sizes(pairs, group).select(*group, "size", "rank"), [*group, "size"]).drop("size")


def signed_ranks(pairs: DataFrame, group: list[str], eps: float = 1e-12) -> DataFrame:
    """(group, sizes, w_plus, w_minus, z, exact): sums of ranks above and below 0, zeros dropped after ranking, the normal deviate under the variance of the ranks that are there, and whether the exact distribution holds: up to 50 differences, none 0, no two of one size."""
    found = sizes(pairs, group, eps)
    rank, left = F.col("rank"), F.col("n") - F.col("zero")
    sums = found.groupBy(*group).agg(
        F.count("*").alias("sizes"), F.sum(F.col("plus") * rank).alias("w_plus"), F.sum(left * rank).alias("w_all"), F.sum(left * rank * rank).alias("w_squares"), F.sum("n").alias("of"), F.sum("zero").alias("zeros")
    )
    z = F.coalesce(F.try_divide(F.col("w_plus") - F.col("w_all") / 2, F.sqrt(F.col("w_squares") / 4)), F.lit(0.0))
    exact = (F.col("of") <= 50) & (F.col("zeros") == 0) & (F.col("sizes") == F.col("of"))
    return sums.select(*group, "sizes", "w_plus", (F.col("w_all") - F.col("w_plus")).alias("w_minus"), z.alias("z"), exact.alias("exact"))


def paired_tests(pairs: DataFrame, group: list[str], family: int = 6, eps: float = 1e-12, alpha: float = 0.05) -> DataFrame:
    """Mean difference with its 95 % interval, effect size, paired t, signed ranks with zeros dropped after ranking, wins, ties and losses; p values times ``family``, at most 1, and what is significant by them, in which direction.

    Up to 50 differences without zeros and without two of one size have the exact distribution of signed ranks, others the
    normal one.  Means of both methods stand beside where ``pairs`` has their values.

    One sample gives no interval; equal differences give an interval of no width and an effect of 0 or an
    infinity; identical pairs give p = 1.  Groups with a null key are groups of their own.
    """
    n = F.count("*")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("a", "b") if c in pairs.columns]
    moments = pairs.groupBy(*group).agg(
        n.alias("n"), *means, F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > eps).alias("wins"), F.count_if(F.abs("d") <= eps).alias("ties"), F.count_if(F.col("d") < -eps).alias("losses")
    )
    agg = _matched(moments, signed_ranks(pairs, group, eps), group)
    agg = agg.withColumn("sd", F.when(F.col("sd") <= eps, 0.0).otherwise(F.col("sd"))).withColumn("df", (F.col("n") - 1).cast("double"))
    half = t_critical(F.when(F.col("sd") > 0, F.col("df"))) * F.col("sd") / F.sqrt("n")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    even = F.abs("delta") <= eps
    dz = F.when(F.col("n") < 2, nan).when(F.col("sd") == 0, F.when(even, F.lit(0.0)).otherwise(inf * F.signum("delta"))).otherwise(F.try_divide("delta", "sd"))
    t = F.when(F.col("n") < 2, nan).when(F.col("sd") == 0, F.when(even, F.lit(0.0)).otherwise(inf * F.signum("delta"))).otherwise(F.try_divide(F.col("delta") * F.sqrt("n"), F.col("sd")))
    out = agg.withColumn("ci_low", F.when(F.col("n") < 2, nan).otherwise(F.col("delta") - F.coalesce(half, F.lit(0.0)))).withColumn("ci_high", F.when(F.col("n") < 2, nan).otherwise(F.col("delta") + F.coalesce(half, F.lit(0.0))))
    out = out.withColumn("dz", dz).withColumn("t", t)
    same = F.col("ties") == F.col("n")
    tail = t_p(F.when(~same, F.col("t")), F.when(~same, F.col("df")))
    exact = exact_p(F.when(F.col("exact"), F.col("w_plus")), F.when(F.col("exact"), F.col("n")))
    normal = normal_p(F.when(~F.col("exact") & ~same, F.col("z")))
    out = out.withColumn("t_p", F.when(same, 1.0).otherwise(F.coalesce(tail, nan))).withColumn("wilcoxon_p", F.when(same, 1.0).when(F.col("exact"), exact).otherwise(normal))  # pandas has one value for NaN and null, so a UDF's NaN comes back as null
    times = lambda p: F.when(F.isnan(p), nan).otherwise(F.least(F.lit(1.0), F.col(p) * family))
    out = out.withColumn("t_p_corrected", times("t_p")).withColumn("wilcoxon_p_corrected", times("wilcoxon_p")).withColumn("statistic", F.least("w_plus", "w_minus"))
    below = lambda p: (~F.isnan(p) & (F.col(p) < alpha)).cast("int")
    out = out.withColumn("t_significant", below("t_p_corrected")).withColumn("wilcoxon_significant", below("wilcoxon_p_corrected"))
    direction = F.when((F.col("t_significant") == 1) & (F.col("delta") > eps), "better").when((F.col("t_significant") == 1) & (F.col("delta") < -eps), "worse").otherwise("none")
    return out.select(
        *group, "n", *[f"mean_{c}" for c in ("a", "b") if c in pairs.columns], "delta", "ci_low", "ci_high", "dz", "t", "t_p", "t_p_corrected", "t_significant", "statistic", "z", "wilcoxon_p", "wilcoxon_p_corrected", "wilcoxon_significant",
        "wins", "ties", "losses", direction.alias("direction"),
    )


def significance(tests: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts and shares of significant tests over several groupings at once."""
    from .summaries import scopes

    share = lambda c: F.avg(F.col(c).cast("double"))
    return scopes(tests, sets, {
        "n": F.count("*"), "t_significant": F.sum("t_significant"), "t_rate": share("t_significant"), "better": F.count_if(F.col("direction") == "better"), "worse": F.count_if(F.col("direction") == "worse"),
        "wilcoxon_significant": F.sum("wilcoxon_significant"), "wilcoxon_rate": share("wilcoxon_significant"),
    })
