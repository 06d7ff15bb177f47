"""Accuracy against cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("model", "method", "qtype")


def efficiency(calls: DataFrame, queries: str = "sample") -> DataFrame:
    """Costs of each (model, method, qtype) from calls (keys, sample, input_tokens, output_tokens, seconds, batch): totals, and what falls to a query and to a call. Null token counts, of skipped calls, add nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = calls.groupBy(*KEYS).agg(
        F.countDistinct(queries).alias("num_queries"), F.count("*").alias("total_calls"), total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("inference_seconds"), F.countDistinct("batch").alias("num_batches")
    )
    per = lambda a, b: F.try_divide(a, b)
    return sums.select(
        *KEYS, "num_queries", "total_calls", per("total_calls", "num_queries").alias("calls_per_query"), "total_input_tokens", per("total_input_tokens", "num_queries").alias("input_tokens_per_query"), per("total_input_tokens", "total_calls").alias("input_tokens_per_call"),
        "total_output_tokens", per("total_output_tokens", "num_queries").alias("output_tokens_per_query"), per(F.col("total_input_tokens") + F.col("total_output_tokens"), "num_queries").alias("total_tokens_per_query"),
        "inference_seconds", per("inference_seconds", "num_queries").alias("amortized_seconds_per_query"), per("num_queries", "inference_seconds").alias("queries_per_second"), "num_batches",
    )


def accuracy_cost(accuracy: DataFrame, costs: DataFrame) -> DataFrame:
    """Accuracy (keys, f1, em_rate) beside costs, and F1 for each thousand input tokens; NaN where a query has none. A row of either side without its partner fails."""
    a = accuracy.select(*KEYS, "f1", "em_rate", F.lit(1).alias("a"))
    both = a.join(costs.withColumn("c", F.lit(1)), list(KEYS), "full_outer")
    whole = F.when(F.col("a").isNull() | F.col("c").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *KEYS))).otherwise(F.col("model"))
    ratio = F.when(F.col("input_tokens_per_query") > 0, 1000 * F.col("f1") / F.col("input_tokens_per_query")).otherwise(F.lit(float("nan")))
    return both.withColumn("model", whole).select(*KEYS, "f1", "em_rate", "calls_per_query", "input_tokens_per_query", "input_tokens_per_call", "output_tokens_per_query", "total_tokens_per_query", "amortized_seconds_per_query", "queries_per_second", ratio.alias("f1_per_1k_input_tokens"))
