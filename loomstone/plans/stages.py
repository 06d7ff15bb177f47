"""Stage operations: what each step of a decomposed query does, run on any triples.

The bounds that this gives tell what a perfect reader could answer from a prompt's text alone, or from what a
staged run has retrieved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .prompts import QUESTION

#: Each step's operation: a hop from its anchor, a hop from the answers of the step before, or a set operation on the steps before.
OPERATIONS = {"1p": ("hop",), "2p": ("hop", "hop on"), "2i": ("hop", "hop", "and"), "3i": ("hop", "hop", "hop", "and"), "2u": ("hop", "hop", "or")}


def stage_answers(triples: DataFrame, plan: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, ent): the answers of every step, from ``triples`` (qid, h, r, t), or (qid, step, h, r, t) where each step has its own.

    ``plan`` has (qid, e1, ..., r1, ...).  Step n hops by relation n.
    """
    own = "step" in triples.columns
    at: list[DataFrame] = []
    for n, kind in enumerate(OPERATIONS[qtype], 1):
        here = (triples.where(F.col("step") == n) if own else triples).select("qid", "h", "r", "t")
        if kind.startswith("hop"):
            heads = plan.select("qid", F.col(f"e{n}").alias("h"), F.col(f"r{n}").alias("r")) if kind == "hop" else at[-1].withColumnRenamed("ent", "h").join(plan.select("qid", F.col(f"r{n}").alias("r")), "qid")
            found = here.join(heads, ["qid", "h", "r"], "left_semi").select("qid", F.col("t").alias("ent")).distinct()
        elif kind == "and":
            found = at[0]
            for other in at[1:]:
                found = found.join(other, ["qid", "ent"], "left_semi")
        else:
            found = at[0].union(at[1]).distinct()
        at.append(found)
    out = at[0].withColumn("step", F.lit(1))
    for n, found in enumerate(at[1:], 2):
        out = out.union(found.withColumn("step", F.lit(n)))
    return out.select("qid", "step", "ent")


def bound(triples: DataFrame, plan: DataFrame, qtype: str) -> DataFrame:
    """(qid, ent): the answers of the last step."""
    return stage_answers(triples, plan, qtype).where(F.col("step") == len(OPERATIONS[qtype])).select("qid", "ent")


def read_back(prompts: DataFrame, qtype: str) -> tuple[DataFrame, DataFrame]:
    """(triples, plan) of one-shot prompts (qid, prompt), from their text alone. A prompt without a question fails."""
    section, question = X.before(F.col("prompt"), QUESTION), X.after(F.col("prompt"), QUESTION)
    triples = prompts.select("qid", F.inline(X.triples(section))).distinct()
    asked = prompts.select("qid", X.question_entities(question).alias("e"), X.question_relations(question).alias("r"))
    hops = [n for n, kind in enumerate(OPERATIONS[qtype], 1) if kind.startswith("hop")]
    anchors = [n for n, kind in enumerate(OPERATIONS[qtype], 1) if kind == "hop"]
    return triples, asked.select("qid", *[F.get("e", n - 1).alias(f"e{n}") for n in anchors], *[F.get("r", n - 1).alias(f"r{n}") for n in hops])


def retrieved(plan: DataFrame, kg: DataFrame, entities: list[int], relations: list[int], others: list[int]) -> DataFrame:
    """(qid, h, r, t): candidates of a query: triples that its anchors are part of, all of its relations, and all but those of its negated ones.

    ``entities``, ``relations`` and ``others`` are slots.  Queries need no such set here, for hops reach what they need by
    joins; it is what a search over text or an index would be given.
    """
    anchors = plan.select("qid", F.explode(F.array(*[F.col(f"e{i}") for i in entities])).alias("e")).distinct()
    out = anchors.join(kg, F.col("e") == F.col("h")).select("qid", "h", "r", "t").union(anchors.join(kg, F.col("e") == F.col("t")).select("qid", "h", "r", "t"))
    if relations:
        named = plan.select("qid", F.explode(F.array(*[F.col(f"r{i}") for i in relations])).alias("r")).distinct()
        out = out.union(named.join(kg, "r").select("qid", "h", "r", "t"))
    for i in others:
        out = out.union(plan.select("qid", F.col(f"r{i}").alias("not")).join(kg, F.col("r") != F.col("not")).select("qid", "h", "r", "t"))
    return out.distinct()
