"""Grouped summaries of score records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of topologies; a topology is in several.
GROUPS = {"all": ("1p", "2p", "2i", "3i", "2u"), "complex": ("2p", "2i", "3i", "2u"), "path": ("1p", "2p"), "set": ("2i", "3i", "2u"), "intersection": ("2i", "3i")}


def by_method(records: DataFrame) -> DataFrame:
    """Means and failure rates of each (model, qtype, method)."""
    return records.groupBy("model", "qtype", "method").agg(
        F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.col("exact_match").cast("double")).alias("em_rate"), F.avg(F.col("parse_failed").cast("double")).alias("parse_failure_rate")
    )


def failure_rates(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, parse_failure_rate, status_failure_rate, any_failure_rate) of samples: shares of those with a parse failure at some stage, with a status other than ok, and with either. ``records`` has (keys, sample, parse_failed, status), one row for each stage."""
    failed = F.when(F.coalesce(F.col("status"), F.lit("")) != "ok", 1).otherwise(0)
    per_sample = records.groupBy(*keys, "sample").agg(F.max(F.coalesce(F.col("parse_failed").cast("int"), F.lit(0))).alias("parse"), F.max(failed).alias("status"))
    rate = lambda c: F.avg(c.cast("double"))
    return per_sample.groupBy(*keys).agg(F.count("*").alias("n"), rate(F.col("parse")).alias("parse_failure_rate"), rate(F.col("status")).alias("status_failure_rate"), rate(F.greatest("parse", "status")).alias("any_failure_rate"))


def scopes(records: DataFrame, sets: list[list[str]], measures: dict) -> DataFrame:
    """One pass over several groupings; ``scope`` tells which, and a column outside it is null."""
    columns = sorted({c for s in sets for c in s})
    grouped = records.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    named = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return grouped.agg(F.when(named == "", "overall").otherwise(named).alias("scope"), *[m.alias(n) for n, m in measures.items()])


def macro(per_type: DataFrame, measures: list[str], ratios: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """For each group of topologies: the mean of the topologies' means, and ratios of their sums."""
    spark = per_type.sparkSession
    pairs = spark.createDataFrame([(g, q) for g, qs in GROUPS.items() for q in qs], "group string, qtype string")
    aggregates = [F.avg(m).alias(m) for m in measures] + [F.try_divide(F.sum(a), F.sum(b)).alias(n) for n, (a, b) in (ratios or {}).items()]
    return per_type.join(F.broadcast(pairs), "qtype").groupBy("model", "method", "group").agg(F.count("*").alias("n_types"), *aggregates)  # 16 fixed pairs


def differences(records: DataFrame, keys: list[str], left: str, right: str, measures: list[str]) -> DataFrame:
    """right minus left of two methods that have one row each for the keys, side by side after one fold; keys that only one of them has are left out."""
    of = lambda method, m: F.max(F.when(F.col("method") == method, F.col(m)))
    both = records.groupBy(*keys).agg(*[(of(right, m) - of(left, m)).alias(f"delta_{m}") for m in measures])
    return both.where(F.col(f"delta_{measures[0]}").isNotNull())


def directions(differences_: DataFrame, value: str, sets: list[list[str]], eps: float = 1e-12) -> DataFrame:
    """Better, worse and equal differences and their shares, over several groupings at once."""
    d = F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    return scopes(differences_, sets, {"n": F.count("*"), "better": F.count_if(d > eps), "worse": F.count_if(d < -eps), "equal": F.count_if(F.abs(d) <= eps), "better_rate": share(d > eps), "worse_rate": share(d < -eps)})


def complete(summary: DataFrame, expected: int) -> DataFrame:
    """A summary whose every group has ``expected`` records; another number fails."""
    return summary.withColumn("n", F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.format_string("a group of %d records", F.col("n"))).cast("bigint")))


def stage_metrics(stages: DataFrame) -> DataFrame:
    """Means of each (run, method, qtype, stage, role) over stage rows; the mean predicted size skips rows without a prediction."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return stages.groupBy("run", "method", "qtype", "stage", "role").agg(
        F.count("*").alias("n"), mean("f1").alias("f1"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("exact_match").alias("em_rate"), mean("contained").alias("containment_rate"), mean("parse_ok").alias("parse_ok_rate"), mean("pred_size").alias("pred_size"), mean("gold_size").alias("gold_size")
    )


def places(orders: dict[str, list]) -> list[Column]:
    """What to sort by for an order of one's own: the places of values in given lists, column after column; unknown values come last, by value."""
    out = []
    for column, values in orders.items():
        at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
        out += [F.when(at > 0, at).otherwise(len(values) + 1), F.col(column)]
    return out


def in_order(df: DataFrame, orders: dict[str, list], *then: str) -> DataFrame:
    """Rows in an order of one's own."""
    return df.orderBy(*places(orders), *then)


def conditional(stages: DataFrame, keys: list[str]) -> DataFrame:
    """From stage rows (keys, sample, stage, exact, contained, final_exact): rates over samples, some only over those where a condition holds. A rate over no samples is NaN."""
    per_sample = stages.groupBy(*keys, "sample").agg(F.min("exact").alias("all_exact"), F.min("contained").alias("all_contained"), F.max("final_exact").alias("final_exact"))
    recoverable = (F.col("all_contained") == 1) & (F.col("all_exact") == 0)
    rate = lambda value, where: F.coalesce(F.avg(F.when(where, value.cast("double"))), F.lit(float("nan")))
    return per_sample.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.col("all_exact").cast("double")).alias("all_exact_rate"),
        F.avg(F.col("all_contained").cast("double")).alias("all_contained_rate"),
        F.count_if(recoverable).alias("recoverable"),
        rate(F.col("final_exact"), recoverable).alias("recovery_rate"),
        rate(F.col("final_exact"), F.col("all_contained") == 1).alias("final_given_contained"),
    )


def mechanism(stages: DataFrame, keys: list[str], measures: list[str], groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """(keys, level, name, stages, measures, samples, rates): means over stage rows beside rates over samples, for each topology and each group of topologies, in one pass.

    ``stages`` has (keys, qtype, sample, stage, exact, contained, final_exact, measures).  Stage rows are folded to samples with
    their sums, each sample is counted under its topology and under every group that has it, and both grains come from the
    same sums.  Rates given a condition are NaN where no sample meets it.  Only groups of which a topology is there have rows.
    """
    per_sample = stages.groupBy(*keys, "qtype", "sample").agg(
        F.count("*").alias("rows"), *[F.sum(F.col(m).cast("double")).alias(m) for m in measures], *[F.count(m).alias(f"n_{m}") for m in measures],
        F.min("exact").alias("all_exact"), F.min("contained").alias("all_contained"), F.max("final_exact").alias("final_exact"),
    )
    name = lambda level, n: F.struct(F.lit(level).alias("level"), n.alias("name"))
    mine = F.array(name("qtype", F.col("qtype")), *[F.when(F.col("qtype").isin(*types), name("group", F.lit(g))) for g, types in groups.items()])
    counted = per_sample.select("*", F.inline(F.filter(mine, lambda x: x.isNotNull())))
    recoverable = (F.col("all_contained") == 1) & (F.col("all_exact") == 0)
    rate = lambda value, where: F.coalesce(F.avg(F.when(where, value.cast("double"))), F.lit(float("nan")))
    return counted.groupBy(*keys, "level", "name").agg(
        F.sum("rows").alias("stages"), *[F.try_divide(F.sum(m), F.sum(f"n_{m}")).alias(m) for m in measures], F.count("*").alias("samples"), F.avg(F.col("all_exact").cast("double")).alias("all_exact_rate"), F.avg(F.col("all_contained").cast("double")).alias("all_contained_rate"),
        F.count_if(recoverable).alias("recoverable"), rate(F.col("final_exact"), recoverable).alias("recovery_rate"), rate(F.col("final_exact"), F.col("all_contained") == 1).alias("final_given_contained"),
    )


def compared(records: DataFrame, keys: list[str], left: str, right: str, measures: list[str], eps: float = 1e-12, groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """(keys, level, name, n, means of both methods, difference of the means, mean difference, better, worse, equal) of two methods on the same samples, for each topology and each group, in one pass."""
    of = lambda method, m: F.max(F.when(F.col("method") == method, F.col(m)))
    both = records.groupBy(*keys, "qtype", "sample").agg(*[c for m in measures for c in (of(left, m).cast("double").alias(f"left_{m}"), of(right, m).cast("double").alias(f"right_{m}"))])
    both = both.where(" AND ".join(f"left_{m} IS NOT NULL AND right_{m} IS NOT NULL" for m in measures))
    name = lambda level, n: F.struct(F.lit(level).alias("level"), n.alias("name"))
    mine = F.array(name("qtype", F.col("qtype")), *[F.when(F.col("qtype").isin(*types), name("group", F.lit(g))) for g, types in groups.items()])
    d = F.col(f"right_{measures[0]}") - F.col(f"left_{measures[0]}")
    return both.select("*", F.inline(F.filter(mine, lambda x: x.isNotNull()))).groupBy(*keys, "level", "name").agg(
        F.count("*").alias("n"), *[c for m in measures for c in (F.avg(f"left_{m}").alias(f"left_{m}"), F.avg(f"right_{m}").alias(f"right_{m}"), (F.avg(f"right_{m}") - F.avg(f"left_{m}")).alias(f"delta_{m}"))],
        F.count_if(d > eps).alias("better"), F.count_if(d < -eps).alias("worse"), F.count_if(F.abs(d) <= eps).alias("equal"),
    )
