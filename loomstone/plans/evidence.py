"""Evidence to steps and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each step of a topology, which triples it gets: by head (anchor slot), by relation (slot), or by any other relation (slot). A triple may get to several steps; a step without a rule gets none.
STEPS = {
    "1p": ("all",),
    "2p": ("h1 r1", "r2"),
    "3p": ("h1 r1", "r2", "r3"),
    "2i": ("h1 r1", "h2 r2", ""),
    "2u": ("h1 r1", "h2 r2", ""),
    "3i": ("h1 r1", "h2 r2", "h3 r3", ""),
    "2in": ("h1 r1", "h2 n2", ""),
    "3in": ("h1 r1", "h2 r2", "h3 n3", ""),
    "inp": ("h1 r1", "h2 n2", "", "r3"),
    "pin": ("h1 r1", "r2", "h2 n3", ""),
    "pni": ("h1 r1", "n2", "h2 r3", ""),
    "ip": ("h1 r1", "h2 r2", "", "r3"),
    "up": ("h1 r1", "h2 r2", "", "r3"),
    "pi": ("h1 r1", "r2", "h2 r3", ""),
}


def _rule(rule: str) -> Column:
    if rule == "all":
        return F.lit(True)
    out = F.lit(False)
    for word in rule.split():
        slot = int(word[1:])
        out = out | (F.col("h") == F.col(f"e{slot}") if word[0] == "h" else F.col("r") == F.col(f"r{slot}") if word[0] == "r" else F.col("r") != F.col(f"r{slot}"))
    return out


def step_rows(plan: DataFrame, evidence: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, h, r, t): evidence under each step whose rule it meets."""
    steps = F.array(*[F.when(_rule(rule), F.lit(i)) for i, rule in enumerate(STEPS[qtype], 1)])
    met = evidence.join(plan, "qid").withColumn("step", F.explode(F.filter(steps, lambda s: s.isNotNull())))
    return met.select("qid", "step", "h", "r", "t")


def evidence_text(h: str = "h", r: str = "r", t: str = "t") -> Column:
    """An aggregate: the distinct triples of a group as text, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(h, r, t))), lambda x: F.format_string("(%d,%d,%d)", x[h], x[r], x[t])), ",")


def step_texts(plan: DataFrame, evidence: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, triples): one row for every step of every query, with empty text where a step has no triples."""
    return step_texts_of(plan, step_rows(plan, evidence, qtype), qtype)


def step_texts_of(plan: DataFrame, rows: DataFrame, qtype: str) -> DataFrame:
    """``step_texts`` from rows (qid, step, h, r, t) that have their steps already."""
    every = plan.select("qid", F.explode(F.sequence(F.lit(1), F.lit(len(STEPS[qtype])))).alias("step"))
    texts = rows.groupBy("qid", "step").agg(evidence_text().alias("triples"))
    return every.join(texts, ["qid", "step"], "left").select("qid", "step", F.coalesce("triples", F.lit("")).alias("triples"))


def query_texts(plan: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, triples): the evidence of every query as text."""
    texts = evidence.groupBy("qid").agg(evidence_text().alias("triples"))
    return plan.select("qid").join(texts, "qid", "left").select("qid", F.coalesce("triples", F.lit("")).alias("triples"))


def by_provenance(kept) -> DataFrame:
    """(qid, step, h, r, t): evidence under the projection that used it and no other, numbered in reading order; an isolation stricter than the rules above."""
    out = None
    for node, edges in kept:
        part = edges.withColumn("step", F.lit(node.slot))
        out = part if out is None else out.unionByName(part)
    return out.select("qid", "step", "h", "r", "t").distinct()


def phase_evidence(frontier: DataFrame, kg: DataFrame, relation: Column) -> DataFrame:
    """(qid, h, r, t): the triples that go out from a predicted frontier (qid, ent) by one relation, supported or not."""
    return frontier.join(kg, (F.col("ent") == F.col("h")) & (F.col("r") == relation)).select("qid", "h", "r", "t").distinct()


def phase_heads(steps: DataFrame) -> DataFrame:
    """(qid, step, heads): the distinct heads of a step's triples, sorted."""
    return steps.groupBy("qid", "step").agg(F.array_sort(F.collect_set("h")).alias("heads"))
