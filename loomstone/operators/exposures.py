"""How much of each test sample a training set has shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summaries import scopes

#: Kinds of keys that samples have, in order of the result's columns.
KINDS = ("query_entity", "query_entity_any", "gold", "gold_any", "relation", "triple", "head_relation", "relation_tail")


def _keys(kind: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("key")))


def sample_keys(test: DataFrame, *by: str) -> DataFrame:
    """(by, kind, key): everything of a test record (triples, entities, relations, gold) that training may have shown."""
    pair = lambda a, b: F.transform("triples", lambda x: F.concat_ws(",", x[a].cast("string"), x[b].cast("string")))
    whole = F.transform("triples", lambda x: F.concat_ws(",", x["h"].cast("string"), x["r"].cast("string"), x["t"].cast("string")))
    lists = [_keys("query_entity", F.col("entities")), _keys("query_entity_any", F.col("entities")), _keys("gold", F.col("gold")), _keys("gold_any", F.col("gold")), _keys("relation", F.col("relations")), _keys("triple", whole), _keys("head_relation", pair("h", "r")), _keys("relation_tail", pair("r", "t"))]
    return test.select(*by, F.inline(F.array_distinct(F.concat(*lists))))


def training_keys(train: DataFrame) -> DataFrame:
    """(kind, key): what training has shown: entities of prompts, final answers, every number (for the ``any`` kinds), relations, triples and their halves."""
    triples = train.select(F.inline("triples")).distinct()
    text = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") for x in c])
    of = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    parts = [
        of(train.select(F.explode("entities").alias("x")), "query_entity", F.col("x")), of(train.select(F.explode("numbers").alias("x")), "query_entity_any", F.col("x")), of(train.select(F.explode("answers").alias("x")), "gold", F.col("x")), of(train.select(F.explode("numbers").alias("x")), "gold_any", F.col("x")),
        of(train.select(F.explode("relations").alias("x")), "relation", F.col("x")), of(triples, "triple", text("h", "r", "t")), of(triples, "head_relation", text("h", "r")), of(triples, "relation_tail", text("r", "t")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def exposures(test: DataFrame, train: DataFrame, *by: str) -> DataFrame:
    """One row for each test sample: of entities, gold, relations and triples how many there are, how many and what share training has shown, and whether any and whether all. A sample without a kind of key has a share of 0, and not all of them."""
    shown = sample_keys(test, *by).join(training_keys(train).withColumn("seen", F.lit(1)), ["kind", "key"], "left")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    hit = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("seen") == 1))
    sums = shown.groupBy(*by).agg(*[c for k in KINDS for c in (count(k).alias(f"n_{k}"), hit(k).alias(f"s_{k}"))])
    rows = test.select(*by).join(sums, list(by), "left").na.fill(0)
    rate = lambda k: F.coalesce(F.try_divide(f"s_{k}", f"n_{k}"), F.lit(0.0))
    any_ = lambda k: (F.col(f"s_{k}") > 0).cast("int")
    all_ = lambda k: ((F.col(f"n_{k}") > 0) & (F.col(f"s_{k}") == F.col(f"n_{k}"))).cast("int")
    c = F.col
    return rows.select(
        *by, c("n_query_entity").alias("query_entities"), c("s_query_entity").alias("query_entities_seen"), rate("query_entity").alias("query_entity_rate"), c("s_query_entity_any").alias("query_entities_seen_anywhere"),
        c("n_gold").alias("golds"), c("s_gold").alias("golds_seen"), rate("gold").alias("gold_rate"), c("s_gold_any").alias("golds_seen_anywhere"), c("n_relation").alias("relations"), c("s_relation").alias("relations_seen"), rate("relation").alias("relation_rate"),
        c("n_triple").alias("triples"), c("s_triple").alias("triples_seen"), c("s_head_relation").alias("head_relations_seen"), c("s_relation_tail").alias("relation_tails_seen"),
        any_("query_entity").alias("any_query_entity"), all_("query_entity").alias("all_query_entities"), any_("gold").alias("any_gold"), all_("gold").alias("all_golds"), any_("relation").alias("any_relation"), all_("relation").alias("all_relations"),
        any_("triple").alias("any_triple"), any_("head_relation").alias("any_head_relation"), any_("relation_tail").alias("any_relation_tail"),
    )


#: Measures whose means a summary has.
MEASURES = ("query_entity_rate", "any_query_entity", "all_query_entities", "gold_rate", "any_gold", "all_golds", "relation_rate", "any_relation", "all_relations", "any_triple", "any_head_relation", "any_relation_tail")


def exposure_summary(rows: DataFrame, by: str = "qtype") -> DataFrame:
    """Means of the samples' measures, over all and for each topology."""
    return scopes(rows, [[], [by]], {"n": F.count("*")} | {m: F.avg(F.col(m).cast("double")) for m in MEASURES})
