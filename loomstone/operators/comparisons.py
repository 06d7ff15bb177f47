"""One set of records against another: scores before and after a change of ids, gold, prompts, namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def side_by_side(source: DataFrame, mapped: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, source_m, mapped_m, delta_m): mapped minus source. A key that only one side has fails."""
    a = source.select(*keys, *[F.col(m).alias(f"source_{m}") for m in measures], F.lit(1).alias("in_a"))
    b = mapped.select(*keys, *[F.col(m).alias(f"mapped_{m}") for m in measures], F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    whole = F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *[F.col(k).cast("string") for k in keys]))).otherwise(F.col(keys[0]))
    return both.withColumn(keys[0], whole).select(*keys, *[c for m in measures for c in (F.col(f"source_{m}"), F.col(f"mapped_{m}"), (F.col(f"mapped_{m}") - F.col(f"source_{m}")).alias(f"delta_{m}"))])


def retained(cells: DataFrame, groups: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Means over groups of topologies of cells that stand side by side, and what share of the source is kept; NaN where the source has nothing. ``groups`` has (group, qtype), a few rows."""
    means = cells.join(groups, "qtype").groupBy(*keys, "group").agg(F.count("*").alias("n_types"), F.avg(f"source_{measure}").alias(f"source_{measure}"), F.avg(f"mapped_{measure}").alias(f"mapped_{measure}"))
    s, m = F.col(f"source_{measure}"), F.col(f"mapped_{measure}")
    return means.withColumn("delta", m - s).withColumn("ratio", F.when(s > 0, m / s).otherwise(F.lit(float("nan"))))


def gold_alignment(old: DataFrame, new: DataFrame, keys: list[str], offset: int) -> DataFrame:
    """(keys, problem): samples whose new gold isn't the old one moved by the offset, or that one side lacks."""
    both = old.select(*keys, F.col("gold").alias("old")).join(new.select(*keys, F.col("gold").alias("new")), keys, "full_outer")
    moved = F.array_sort(F.transform("old", lambda t: t + offset))
    problem = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "unexpected").when(moved != F.array_sort("new"), "different")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def prompt_alignment(source: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): prompts (keys, triples array) that have no partner, or one with another number of triples."""
    both = source.select(*keys, F.size("triples").alias("a")).join(mapped.select(*keys, F.size("triples").alias("b")), keys, "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "count")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def shared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(shared, least_a, most_a, least_b, most_b): how many values two namespaces have in common, and their ranges. Disjoint ones share none."""
    both = a.select(F.col(key).alias("x")).distinct().withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).union(b.select(F.col(key).alias("x")).distinct().withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    each = both.groupBy("x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    of = lambda f, side: f(F.when(F.col(side) == 1, F.col("x")))
    return each.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("shared"), of(F.min, "a").alias("least_a"), of(F.max, "a").alias("most_a"), of(F.min, "b").alias("least_b"), of(F.max, "b").alias("most_b"))


def zipped(gold: DataFrame, pred: DataFrame, keys: list[str], also: str) -> DataFrame:
    """Gold and predictions by key, never by place; records of one key that disagree about ``also``, or that one side lacks, fail."""
    left = gold.withColumnRenamed(also, "also_gold").withColumn("in_gold", F.lit(1))
    right = pred.withColumnRenamed(also, "also_pred").withColumn("in_pred", F.lit(1))
    both = left.join(right, keys, "full_outer")
    bad = F.col("in_gold").isNull() | F.col("in_pred").isNull() | ~F.col("also_gold").eqNullSafe(F.col("also_pred"))
    return both.withColumn(also, F.when(bad, F.raise_error(F.lit(f"records that disagree about {also}"))).otherwise(F.col("also_gold").cast("string"))).drop("also_gold", "also_pred", "in_gold", "in_pred")


def gold_of(samples: DataFrame, gold: DataFrame, key: str, also: str, answer: str) -> DataFrame:
    """``samples`` with their gold answer by id; null without one. Gold of the same id and another ``also`` fails."""
    found = gold.select(key, F.col(also).alias("also_gold"), answer)
    both = samples.join(found, key, "left")
    bad = F.col("also_gold").isNotNull() & (F.col("also_gold") != F.col(also))
    return both.withColumn(answer, F.when(bad, F.raise_error(F.lit(f"gold of another {also}"))).otherwise(F.col(answer).cast("string"))).drop("also_gold")


def remapped_faults(old: DataFrame, new: DataFrame, keys: list[str], entity_offset: int, relation_offset: int) -> DataFrame:
    """(keys, problems): what of each sample isn't its original in the new namespace; an empty array where all is.

    Both sides have (keys, stages array<(triples array<(h, r, t)>, question)>, answer array<long>), one row a sample.  Stages are
    compared one by one: triples in their order, the question's entities and relations in their order.  Fixed values:
    ``missing``, ``stage_count``, ``triples``, ``question_ids``, ``answer``; where the stages' number differs, stages aren't compared.
    """
    a, b = old.select(*keys, F.col("stages").alias("was"), F.col("answer").alias("gave")), new.select(*keys, F.col("stages").alias("is"), F.col("answer").alias("gives"), F.lit(True).alias("there"))
    both = a.join(b, keys, "left")
    moved = lambda triples: F.transform(triples, lambda x: F.struct((x["h"] + entity_offset).cast("long"), (x["r"] + relation_offset).cast("long"), (x["t"] + entity_offset).cast("long")))
    plain = lambda triples: F.transform(triples, lambda x: F.struct(x["h"].cast("long"), x["r"].cast("long"), x["t"].cast("long")))
    ids = lambda q, by, f: F.transform(f(q), lambda x: x.cast("long") + by)
    same_triples = F.transform("was", lambda s: moved(s["triples"])) == F.transform("is", lambda s: plain(s["triples"]))
    names = lambda stages, e, r: F.transform(stages, lambda s: F.struct(ids(s["question"], e, lambda q: X.question_entities(q, True)), ids(s["question"], r, X.question_relations)))
    same_questions = names("was", entity_offset, relation_offset) == names("is", 0, 0)
    same_answer = F.transform("gave", lambda t: t + entity_offset).eqNullSafe(F.col("gives"))
    counted = F.size("was") == F.size("is")
    faults = F.array(F.when(~counted, "stage_count"), F.when(counted & ~same_triples, "triples"), F.when(counted & ~same_questions, "question_ids"), F.when(~same_answer, "answer"))
    found = F.when(F.col("there").isNull(), F.array(F.lit("missing"))).otherwise(F.filter(faults, lambda x: x.isNotNull()))
    return both.select(*keys, found.alias("problems"))
