"""Loaders of saved prompts, scores, costs and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .files import literal_json, numbered_texts

#: Fields that a score and a cost record must have.
SCORE_FIELDS = ("exact_match", "precision", "recall", "f1", "parse_failed", "status_failed")
COST_FIELDS = (
    "num_queries", "total_calls", "calls_per_query", "total_input_tokens", "input_tokens_per_query", "input_tokens_per_call", "total_output_tokens",
    "output_tokens_per_query", "total_tokens_per_query", "inference_seconds", "amortized_seconds_per_query", "queries_per_second", "num_batches",
)
_WHOLE = ("num_queries", "total_calls", "total_input_tokens", "total_output_tokens", "num_batches")


def single_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(qtype, sample_id, prompt, answer) of saved one-shot prompts: <qtype>/<n>.txt with a literal of query and answer."""
    r = F.from_json(literal_json(F.col("text")), "query string, answer string")
    return numbered_texts(spark, path).withColumn("r", r).select("qtype", "sample_id", F.col("r.query").alias("prompt"), "r.answer")


def step_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(qtype, sample_id, step, prompt, answer) of saved staged prompts: each step's evidence, its question of the folder's topology and the words around it, put together."""
    kind = "query struct<premise:array<string>,question:struct<question_tag:string,question:map<string,array<string>>,explain_tag:string>>, answer string"
    rows = numbered_texts(spark, path).withColumn("r", F.from_json(literal_json(F.col("text")), kind))
    both = F.arrays_zip(F.col("r.query.premise").alias("premise"), F.try_element_at(F.col("r.query.question.question"), F.col("qtype")).alias("question"))
    steps = rows.select("qtype", "sample_id", "r", F.posexplode(both).alias("at", "z")).where("z.premise IS NOT NULL AND z.question IS NOT NULL")
    return steps.select("qtype", "sample_id", (F.col("at") + 1).alias("step"), F.concat("z.premise", "r.query.question.question_tag", "z.question", "r.query.question.explain_tag").alias("prompt"), "r.answer")


def premises(prompts: DataFrame, marker: str, keys: tuple[str, ...] = ("qtype", "sample_id")) -> DataFrame:
    """(keys, h, r, t): the distinct triples that stand before the question in saved prompts."""
    return prompts.select(*keys, F.inline(X.triples(X.before(F.col("prompt"), marker)))).distinct()


def _required(df: DataFrame, fields: tuple[str, ...], what: str) -> DataFrame:
    lacking = F.concat_ws(", ", *[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    return df.withColumn(fields[0], F.when(lacking == "", F.col(fields[0])).otherwise(F.raise_error(F.concat(F.lit(f"a {what} without "), lacking)).cast("double")))


def scores(records: DataFrame, keys: tuple[str, ...] = ("model", "method", "qtype", "sample")) -> DataFrame:
    """(keys, the score fields as doubles) from JSON records ``text``; a record that lacks a field fails."""
    r = F.from_json("text", ", ".join(f"{f} double" for f in SCORE_FIELDS))
    return _required(records.select(*keys, r.alias("r")).select(*keys, "r.*"), SCORE_FIELDS, "score")


def efficiencies(records: DataFrame, expected: int | None = None) -> DataFrame:
    """(model, method, qtype, the cost fields) from JSON records ``text`` found under ``model``, ``method`` and ``qtype``.

    A record that lacks a field, names another model, method or topology than its place, or has another number of queries than expected fails.
    """
    keys = ("model", "method", "qtype")
    r = F.from_json("text", ", ".join([f"{k} string" for k in keys] + [f"{f} double" for f in COST_FIELDS]))
    rows = records.select(*keys, r.alias("r"))
    wrong = F.lit(False)
    for k in keys:
        wrong = wrong | ~F.col(k).eqNullSafe(F.col(f"r.{k}"))
    rows = rows.withColumn("model", F.when(wrong, F.raise_error(F.lit("a cost record in another's place"))).otherwise(F.col("model")))
    out = _required(rows.select(*keys, *[F.col(f"r.{f}").alias(f) for f in COST_FIELDS]), COST_FIELDS, "cost record")
    if expected is not None:
        out = out.withColumn("num_queries", F.when(F.col("num_queries") == expected, F.col("num_queries")).otherwise(F.raise_error(F.lit("another number of queries")).cast("double")))
    return out.select(*keys, *[F.col(f).cast("long").alias(f) if f in _WHOLE else F.col(f) for f in COST_FIELDS])


def _features(text: Column, whole: Column, answer: Column) -> list[Column]:
    found = X.triples(text)
    said = X.question_relations(text)
    return [
        F.array_distinct(found).alias("triples"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["h"], x["t"]))))).alias("entities"),
        F.array_sort(F.array_union(F.transform(found, lambda x: x["r"]), said)).alias("relations"),
        X.numbers(whole).alias("numbers"),
        F.array_join(F.transform(said, lambda x: x.cast("string")), ",").alias("signature"),
        answer.alias("answers"),
    ]


def training_records(df: DataFrame, *keys: str) -> DataFrame:
    """Features of training records (instruction, output): triples, entities, relations, numbers, the question's relations in order, the final answer's entities and the output's triples."""
    return df.select(*keys, *_features(F.col("instruction"), F.concat_ws("\n", "instruction", "output"), X.lenient_set(X.final_answer(F.col("output")))), F.array_distinct(X.triples(F.col("output"))).alias("output_triples"))


def test_records(df: DataFrame, *keys: str) -> DataFrame:
    """Features of test records (query, answer), as ``training_records`` has them."""
    return df.select(*keys, *_features(F.col("query"), F.concat_ws("\n", "query", "answer"), X.lenient_set(F.col("answer"))))


def source_split(spark: SparkSession, path: str, label: str, schema: str) -> DataFrame:
    """One split's records of a JSON file; labels other than train and val fail."""
    if label not in ("train", "val"):
        raise ValueError(f"no split {label!r}")
    return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("split", F.lit(label))
