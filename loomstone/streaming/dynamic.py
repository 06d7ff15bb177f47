"""Staged runs with retrieval in the loop: each step's evidence is what goes out from the answers before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import parsed_answer
from ..functions.text import checked_set
from ..plans.evidence import evidence_text, phase_evidence
from ..plans.lowering import only
from ..plans.prompts import INSTRUCTION, QUESTION, STEP_PREMISE, step_questions, with_answers
from ..plans.stages import OPERATIONS
from .staged import SKIPPED, TERMINAL, generated, written


def run_dynamic(plan: DataFrame, qtype: str, kg: DataFrame, model: Callable[[list[str]], list[str]], context: int | None = None, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, premises) of a batch of queries of one topology.

    Records are (qid, answers, raw_answers, confidences, statuses, input_chars, total_input_chars, status), a list with
    an entry for each step; premises (qid, step, h, r, t), what each step was given.  A step hops from its anchor, or
    from the entities of the answer before, predicted or not; set operations get no triples.  A reply that can't be
    parsed counts as no answer and the sample goes on; a terminal reply ends it, its later steps are skipped and have no
    input.  Samples in ``done`` are left out.  Each step is written before the next.
    """
    todo = plan if done is None else plan.join(done.select("qid").distinct(), "qid", "left_anti")
    todo = written(todo, "plan")
    questions = step_questions(todo, qtype)
    texts = F.array().cast("array<string>")
    state = todo.select("qid", texts.alias("answers"), texts.alias("raw_answers"), texts.alias("confidences"), texts.alias("statuses"), F.array().cast("array<int>").alias("input_chars"), F.array().cast("array<bigint>").alias("last"), F.lit(False).alias("ended"))
    premises = None
    for n, kind in enumerate(OPERATIONS[qtype], 1):
        here = state.join(questions.where(F.col("step") == n).select("qid", "question"), "qid")
        live = here.where("NOT ended")
        facts = None
        if kind != "and" and kind != "or":
            relation = todo.select("qid", F.col(f"r{n}").alias("want"))
            heads = live.select("qid").join(todo.select("qid", F.col(f"e{n}").alias("ent")), "qid") if kind == "hop" else live.select("qid", F.explode("last").alias("ent"))
            facts = written(phase_evidence(heads.join(relation, "qid"), only(kg, relation.select("want")), F.col("want")), "premises")
            part = facts.select("qid", F.lit(n).alias("step"), "h", "r", "t")
            premises = part if premises is None else premises.union(part)
            live = live.join(facts.groupBy("qid").agg(evidence_text().alias("triples")), "qid", "left")
        else:
            live = live.withColumn("triples", F.lit(None).cast("string"))
        known = F.when(F.col("triples").isNull(), F.lit("\n")).otherwise(F.concat("triples", F.lit(".\n")))
        asked = F.concat(F.lit(QUESTION), with_answers(F.col("question"), F.col("answers")), F.lit(INSTRUCTION))
        ready = live.withColumn("prompt", F.concat(F.lit(STEP_PREMISE), known, asked)).select(*state.columns, "prompt")
        replied = generated(ready, model, context=context).withColumn("p", parsed_answer("raw_answer"))
        over, failed = F.col("raw_answer").isin(*TERMINAL), F.col("p.confidence") == "failed"
        push = lambda c, x: F.concat(F.col(c), F.array(x)).alias(c)
        answer = F.when(failed, "None").otherwise(F.col("p.answer"))
        ran = replied.select(
            "qid", push("answers", answer), push("raw_answers", F.col("raw_answer")), push("confidences", F.col("p.confidence")), push("statuses", F.when(over, F.lower("raw_answer")).when(failed, "parse_failed").otherwise("ok")),
            push("input_chars", F.length("prompt")), checked_set(answer).alias("last"), over.alias("ended"),
        )
        empty = F.array().cast("array<bigint>")
        skipped = here.where("ended").select("qid", push("answers", F.lit("None")), push("raw_answers", F.lit(SKIPPED)), push("confidences", F.lit("failed")), push("statuses", F.lit("skipped_previous_failure")), push("input_chars", F.lit(None).cast("int")), empty.alias("last"), "ended")
        state = written(ran.unionByName(skipped), "stage")
    total = F.aggregate("input_chars", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    status = F.when(F.array_contains("confidences", "failed"), "failed").otherwise("ok")
    return state.select("qid", "answers", "raw_answers", "confidences", "statuses", "input_chars", total.alias("total_input_chars"), status.alias("status")), premises
