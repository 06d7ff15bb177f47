"""Overlap of training and test records, in all and by topology, from one fold of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audits import anomalies

#: What is compared over all records, and which of it by topology as well.
MEASURES = (
    "prompt_entity", "target_answer_entity", "relation", "all_numeric_upper_bound", "exact_triple_train_input_only", "exact_triple_full_train_exposure", "head_relation_pair", "relation_tail_pair", "head_tail_pair",
)
BY_TYPE = ("prompt_entity", "target_answer_entity", "relation", "exact_triple_train_input_only", "exact_triple_full_train_exposure")
TYPES = ("1p", "2p", "2i", "2u", "3i")


def _keys(triples: Column, every: Column) -> Column:
    """(measure, key) of a record's features; ``every`` has the triples that count beyond those of the prompt."""
    text = lambda items: F.transform(items, lambda x: x.cast("string"))
    joined = lambda items, *names: F.transform(items, lambda x: F.concat_ws(",", *[x[n].cast("string") for n in names]))
    lists = [text(F.col("entities")), text(F.col("answers")), text(F.col("relations")), text(F.col("numbers")), joined(triples, "h", "r", "t"), joined(every, "h", "r", "t"), joined(every, "h", "r"), joined(every, "r", "t"), joined(every, "h", "t")]
    named = lambda measure, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(measure).alias("measure"), k.alias("key")))
    return F.concat(*map(named, MEASURES, lists))


def overlap_table(train: DataFrame, test: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(scope, qtype, measure, train_unique, test_unique, overlap, test_overlap_rate, train_overlap_rate, jaccard): all MEASURES over all records, and BY_TYPE for each topology.

    Both sides have (qtype, triples, entities, relations, numbers, answers), training also output_triples.  Every key is
    folded once to a mask with a bit for each side and topology, and all rows are sums over these masks.  Records
    of other topologies, and of none, count in all.  Measures without any key have rows of zeros.
    """
    if len(types) > 30:
        raise ValueError("a mask holds thirty topologies")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, types)), F.col("qtype")), F.lit(0)).cast("int")
    bit = lambda side: F.get(F.array(*[F.lit(1 << 2 * i + side).cast("long") for i in range(len(types) + 1)]), place)
    none = F.array().cast("array<struct<h:bigint,r:int,t:bigint>>")
    here = F.coalesce(F.col("triples"), none)
    one = train.select(bit(0).alias("bit"), F.inline(_keys(here, F.array_union(here, F.coalesce(F.col("output_triples"), none)))))
    two = test.select(bit(1).alias("bit"), F.inline(_keys(here, here)))
    masks = one.union(two).where("key IS NOT NULL").groupBy("measure", "key").agg(F.bit_or("bit").alias("mask"))
    scopes = [("overall", None, sum(1 << 2 * i for i in range(len(types) + 1)))] + [("qtype", t, 1 << 2 * i) for i, t in enumerate(types, 1)]
    has = lambda bits: F.col("mask").bitwiseAND(F.lit(bits).cast("long")) != 0
    counts = [c for i, (_, _, b) in enumerate(scopes) for c in (F.count_if(has(b)).alias(f"a{i}"), F.count_if(has(2 * b)).alias(f"b{i}"), F.count_if(has(b) & has(2 * b)).alias(f"c{i}"))]
    every = train.sparkSession.createDataFrame([(m,) for m in MEASURES], "measure string")
    wide = every.join(masks.groupBy("measure").agg(*counts), "measure", "left").na.fill(0)
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(t).cast("string").alias("qtype"), F.col(f"a{i}").alias("train_unique"), F.col(f"b{i}").alias("test_unique"), F.col(f"c{i}").alias("overlap")) for i, (s, t, _) in enumerate(scopes)])
    long = wide.select("measure", F.inline(rows)).where(F.col("scope").eqNullSafe("overall") | F.col("measure").isin(*BY_TYPE))
    rate = lambda n: F.coalesce(F.try_divide("overlap", n), F.lit(0.0))
    return long.select("scope", "qtype", "measure", "train_unique", "test_unique", "overlap", rate(F.col("test_unique")).alias("test_overlap_rate"), rate(F.col("train_unique")).alias("train_overlap_rate"), rate(F.col("train_unique") + F.col("test_unique") - F.col("overlap")).alias("jaccard"))


def incomplete_records(train: DataFrame, test: DataFrame, *keys: str) -> DataFrame:
    """(keys, anomaly): records that lack triples, relations or an answer, three kinds for each side. The names of the kinds."""
    lacks = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    of_train = anomalies(train.select(*keys, "triples", "answers", "relations"), {"train_no_triple": lacks("triples"), "train_no_final_answer": lacks("answers"), "train_no_relation": lacks("relations")})
    of_test = anomalies(test.select(*keys, "triples", "answers", "relations"), {"test_no_triple": lacks("triples"), "test_no_gold": lacks("answers"), "test_no_relation": lacks("relations")})
    return of_train.select(*keys, "anomaly").union(of_test.select(*keys, "anomaly"))
