"""Evidence and prompts from a directed knowledge base whose ids and relations are text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.programs import PATHS, grounded, parsed_output
from ..streaming.staged import written
from .batch import Batch, typed_nodes
from .evidence import query_texts, step_rows, step_texts
from .ir import topology
from .lowering import Lowered
from .prompts import decomposed_prompts, isolated_prompts, single_prompts


def bare_id(text: Column) -> Column:
    """An id without the letters Q at its ends."""
    return F.regexp_replace(text, "^Q+|Q+$", "")


def evidence(plan: DataFrame, edges: DataFrame, ids: DataFrame, qtype: str) -> tuple[DataFrame, DataFrame]:
    """(triples (qid, h, r, t), steps (qid, step, h, r, t)) of a batch of directed queries, mapped to bare ids and relation numbers.

    ``plan`` has (qid, e1, ..., r1, ...) with text ids and relation keys, ``edges`` (h, predicate, direction, t),
    ``ids`` (rel_key, rel_id).  A relation without a number is an error.
    """
    kg = edges.select("h", F.concat_ws("::", "predicate", "direction").alias("r"), "t")
    found = Lowered(topology(qtype), plan, kg).evidence()
    number = F.coalesce("rel_id", F.raise_error(F.concat(F.lit("no number for "), F.col("r"))).cast("int"))

    def mapped(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("h", "r", "t")]
        return df.join(ids.withColumnRenamed("rel_key", "r"), "r", "left").select(*keep, bare_id(F.col("h")).alias("h"), number.alias("r"), bare_id(F.col("t")).alias("t"))

    return mapped(found), mapped(step_rows(plan, found, qtype))


def mapped_plan(plan: DataFrame, ids: DataFrame, entities: list[str], relations: list[str]) -> DataFrame:
    """The plan with bare ids and relation numbers, for prompts."""
    out = plan
    for r in relations:
        out = out.withColumnRenamed(r, "rel_key").join(ids, "rel_key", "left").drop("rel_key").withColumnRenamed("rel_id", r)
    return out.select("qid", *[bare_id(F.col(e)).alias(e) for e in entities], *relations)


def plans_of(parses: DataFrame) -> DataFrame:
    """(qid, qtype, e1, ..., r1, ...) of grounded parses (qid, type, branches array<(branch, hop, value)>): anchors and hops in reading order fill the slots."""
    anchors, hops = F.filter("branches", lambda x: x["hop"] < 0), F.filter("branches", lambda x: x["hop"] >= 0)
    slots = [F.get(anchors, i)["value"].alias(f"e{i + 1}") for i in range(max(map(len, PATHS.values())))]
    return parses.select("qid", F.col("type").alias("qtype"), *slots, *[F.get(hops, i)["value"].alias(f"r{i + 1}") for i in range(max(map(sum, PATHS.values())))])


def parse_prompts(outputs: DataFrame, names: DataFrame, relations: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, qtype, kind, step, prompt, failure): a parser's outputs (qid, text) to prompts of the three kinds, all topologies in one batch.

    An output is read strictly, its names are grounded in ``names`` (key, ids) and ``relations`` (key, spellings), its evidence is
    found in ``edges`` (h, predicate, direction, t) and mapped to bare ids and relation numbers of ``ids`` (rel_key, rel_id).
    An output that fails at a stage has one row with its reason and no prompt.  Kind ``single`` has step 0; a query
    without answers has prompts without evidence; a relation without a number is an error.
    """
    read = written(outputs.select("qid", parsed_output("text").alias("p")).select("qid", "p.*"), "parses")
    known = written(grounded(read, names, relations).join(read.select("qid", "type"), "qid"), "grounded")
    failed = known.where("status <> 'ok'").select("qid", F.lit(None).cast("string").alias("qtype"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("string").alias("prompt"), F.col("failure_reason").alias("failure"))
    plan = written(plans_of(known.where("status = 'ok'")), "plans")
    kg = edges.select("h", F.concat_ws("::", "predicate", "direction").alias("r"), "t")
    number = F.coalesce("rel_id", F.raise_error(F.concat(F.lit("no number for "), F.col("r"))).cast("int"))
    triples = Batch(typed_nodes(plan), kg).evidence().join(ids.withColumnRenamed("rel_key", "r"), "r", "left")
    bare = lambda c: bare_id(F.col(c)).cast("long").alias(c)
    found = written(triples.select("qid", bare("h"), number.alias("r"), bare("t")), "triples")
    asked = [c for c in plan.columns if c[0] == "e"], [c for c in plan.columns if c[0] == "r"]
    numbered = written(mapped_plan(plan, ids, *asked).join(plan.select("qid", "qtype"), "qid"), "numbered")
    out = failed
    for qtype in PATHS:
        p = numbered.where(F.col("qtype") == qtype)
        p = p.select("qid", *[F.col(c).cast("long").alias(c) for c in asked[0]], *asked[1])
        mine = found.join(p.select("qid"), "qid", "left_semi")
        whole = query_texts(p, mine)
        kinds = [("single", single_prompts(p, whole, qtype).withColumn("step", F.lit(0))), ("decomposed", decomposed_prompts(p, whole, qtype)), ("isolated", isolated_prompts(p, step_texts(p, mine, qtype), qtype))]
        for kind, rows in kinds:
            out = out.unionByName(rows.select("qid", F.lit(qtype).alias("qtype"), F.lit(kind).alias("kind"), F.col("step").cast("int").alias("step"), "prompt", F.lit(None).cast("string").alias("failure")))
    return out
