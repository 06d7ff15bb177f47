"""Questions, prompts and their inverse."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ir import slots, topology

#: The one-shot questions. {e1} is an anchor, {r1} a relation.
QUESTIONS = {
    "1p": "Which entities are connected to {e1} by relation {r1}?",
    "2p": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. Then, what are the entities connected to E by relation {r2}?",
    "3p": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. The set of entities F is connected to entities in E by relation {r2}. Then, what are the entities connected to F by relation {r3}?",
    "2i": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. The set of entities F is connected to entity {e2} by relation {r2}. Then, which entities exist in both E and F?",
    "3i": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. The set of entities F is connected to entity {e2} by relation {r2}. The set of entities G is connected to entity {e3} by relation {r3}. Then, which entities exist in both E, F and G?",
    "2in": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. And F is the set of entities connected to entity {e2} by any relation other than relation {r2}. Then, which entities exist in both E and F?",
    "3in": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. F is the set of entities connected to entity {e2} by relation {r2}. And G is the set of entities connected to entity {e3} by any relation other than relation {r3}. Then, which entities exist in both E, F and G?",
    "inp": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. And F is the set of entities connected to entity {e2} by any relation other than relation {r2}. Then, which entities are connected to the entities that exist in both E and F through the relationship {r3}?",
    "pin": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. F is the set of entities connected to entities in E by relation {r2}. And G is the set of entities connected to entity {e2} by any relation other than relation {r3}. Then, which entities exist in both F and G?",
    "pni": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}, F is the set of entities connected to entities in E by any relation other than {r2}. And G is the set of entities connected to entity {e2} by relation {r3}. Then, which entities exist in both F and G?",
    "ip": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}, F is the set of entities connected to entity {e2} by relation {r2}. And G is the set of entities exist in both E and F. Then, what are the entities connected to entities in set G by relation {r3}?",
    "pi": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. F is the set of entities connected to entities in E by relation {r2}. And G is the set of entities connected to entity {e2} by relation {r3}. Then, which entities exist in both F and G?",
    "2u": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. F is the set of entities connected to entity {e2} by relation {r2}. Then, what entities exist in either E or F?",
    "up": "Let us assume that the set of entities E is connected to entity {e1} by relation {r1}. F is the set of entities connected to entity {e2} by relation {r2}. And G is the set of entities exist in either E or F. Then, what are the entities connected to entities in G by relation {r3}?",
}
_ONE, _TWO, _THREE = (f"Which entities are connected to {{e{i}}} by relation {{r{i}}}?" for i in (1, 2, 3))
_BOTH12, _BOTH23 = "Which entities exist in both sets [PP1] and [PP2]?", "Which entities exist in both sets [PP2] and [PP3]?"
_BOTH123 = "Which entities exist in both sets [PP1], [PP2] and [PP3]?"
_EITHER = "What entities exist in either sets [PP1] or [PP2]?"
#: The questions of each step; [PPn] is the answer of step n.
STEP_QUESTIONS = {
    "1p": [_ONE],
    "2p": [_ONE, "Which entities are connected to entities in [PP1] by relation {r2}?"],
    "3p": [_ONE, "Which entities are connected to entities in [PP1] by relation {r2}?", "Which entities are connected to entities in [PP2] by relation {r3}?"],
    "2i": [_ONE, _TWO, _BOTH12],
    "3i": [_ONE, _TWO, _THREE, _BOTH123],
    "2in": [_ONE, "Which entities are connected to {e2} by any relation other than {r2}?", _BOTH12],
    "3in": [_ONE, _TWO, "Which entities are connected to {e3} by any relation other than {r3}?", _BOTH123],
    "inp": [_ONE, "Which entities are connected to {e2} by any relation other than {r2}?", _BOTH12, "What are the entities connected to any entity in [PP3] by relation {r3}?"],
    "pin": [_ONE, "Which entities are connected to entity set in [PP1] by relation {r2}?", "Which entities are connected to {e2} by any relation other than {r3}?", _BOTH23],
    "pni": [_ONE, "Which entities are connected to any entity in [PP1] by any relation other than {r2}?", "Which entities are connected to {e2} by relation {r3}?", _BOTH23],
    "ip": [_ONE, _TWO, _BOTH12, "What are the entities connected to any entity in [PP3] by relation {r3}?"],
    "pi": [_ONE, "Which entities are connected to [PP1] by relation {r2}?", "Which entities are connected to {e2} by relation {r3}?", _BOTH23],
    "2u": [_ONE, _TWO, _EITHER],
    "up": [_ONE, _TWO, _EITHER, "Which entities are connected to any entity in [PP3] by relation {r3}?"],
}
#: What stands around evidence and question.
PREMISE = "Given the following (h,r,t) triplets where entity h is related to entity t by relation r;\n"
STEP_PREMISE = "If any (h, r, t) triplets are provided below, they indicate that entity h is related to entity t by relation r. Otherwise, ignore this section.\n"
QUESTION = "Answer the question:\n"
INSTRUCTION = "\nReturn only the answer entities separated by commas with no other text."
#: What the model is told about its task.
SYSTEMS = {
    "plain": "You are an expert in deductive reasoning over the supplied knowledge graph facts. Use only the provided facts. Output only the answer entities separated by English commas, without brackets, labels, or explanations. If no entity satisfies the query, output only 'None'.",
    "CoT": "You are an expert in deductive reasoning over the supplied knowledge graph facts. Use only the provided facts and solve the problem step by step. Clearly derive the intermediate entity sets. After completing the reasoning, the last non-empty line must contain only the final answer entities separated by English commas, without brackets, labels, or explanations. If no entity satisfies the query, the last non-empty line must be exactly 'None'.",
    "FewShot_CoT": 'You are an expert in deductive reasoning over the supplied knowledge graph facts. Follow the reasoning style and output format demonstrated in the examples. The last non-empty line must be a valid answer object in exactly this form: Answer: {"answer": ["entity1", "entity2"]}. If there is no answer, use Answer: {"answer": []}. Do not write anything after the final answer line.',
}


def filled(template: str) -> Column:
    """A template with its slots taken from the plan's columns."""
    parts = re.split(r"\{([er]\d)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def questions(plan: DataFrame, qtype: str) -> DataFrame:
    """(qid, question)."""
    return plan.select("qid", filled(QUESTIONS[qtype]).alias("question"))


def step_questions(plan: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, question)."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), filled(q).alias("question")) for i, q in enumerate(STEP_QUESTIONS[qtype], 1)])
    return plan.select("qid", F.inline(steps))


def prompt(premise: Column, question: Column, tag: str = PREMISE) -> Column:
    """Evidence, question and instruction as one prompt."""
    return F.concat(F.lit(tag), premise, F.lit("\n\n"), F.lit(QUESTION), question, F.lit(INSTRUCTION))


def single_prompts(plan: DataFrame, texts: DataFrame, qtype: str) -> DataFrame:
    """(qid, prompt): all evidence, one question."""
    return questions(plan, qtype).join(texts, "qid").select("qid", prompt(F.col("triples"), F.col("question")).alias("prompt"))


def decomposed_prompts(plan: DataFrame, texts: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, prompt): all evidence with each step's question."""
    return step_questions(plan, qtype).join(texts, "qid").select("qid", "step", prompt(F.col("triples"), F.col("question"), STEP_PREMISE).alias("prompt"))


def isolated_prompts(plan: DataFrame, steps: DataFrame, qtype: str) -> DataFrame:
    """(qid, step, prompt): each step's evidence with its question."""
    return step_questions(plan, qtype).join(steps, ["qid", "step"]).select("qid", "step", prompt(F.col("triples"), F.col("question"), STEP_PREMISE).alias("prompt"))


def with_answers(text: Column, answers: Column) -> Column:
    """A question with every [PPn] replaced by {answer n}; a null answer reads None, and a placeholder beyond the answers fails. Placeholders inside answers stay."""
    parts, numbers = F.split(text, r"\[PP[0-9]+\]", -1), F.regexp_extract_all(text, F.lit(r"\[PP([0-9]+)\]"), 1)

    def answer(i: Column) -> Column:
        n = F.get(numbers, i).try_cast("int")
        known = F.coalesce((n >= 1) & (n <= F.size(answers)), F.lit(False))
        value = F.concat(F.lit("{"), F.coalesce(F.get(answers, n - 1), F.lit("None")), F.lit("}"))
        return F.when(known, value).otherwise(F.raise_error(F.concat(F.lit("no answer for [PP"), F.get(numbers, i), F.lit("]"))))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(numbers), F.concat(p, answer(i))).otherwise(p)), "")


def with_premise(text: Column, premise: Column, tag: str = PREMISE) -> Column:
    """A prompt with its evidence section replaced; a prompt without the question tag fails."""
    tail = F.substring_index(text, QUESTION, -1)
    ok = F.contains(text, F.lit(QUESTION))
    return F.when(ok, F.concat(F.lit(tag), premise, F.lit("\n\n" + QUESTION), tail)).otherwise(F.raise_error(F.lit("a prompt without a question")))


def system_prompt(task: Column) -> Column:
    """What a model is told for a task; tasks without words of their own get the plain ones."""
    out = F.lit(SYSTEMS["plain"])
    for name in ("CoT", "FewShot_CoT"):
        out = F.when(task == name, F.lit(SYSTEMS[name])).otherwise(out)
    return out


def turns(*said: tuple[str, Column]) -> Column:
    """array<struct<role,content>>: a conversation, as chat templates take it."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


def chat(system: Column, prompt_: Column) -> Column:
    """A prompt with what stands before it."""
    return turns(("system", system), ("user", prompt_))


def training_chat(instruction: Column, input_: Column, output: Column) -> Column:
    """A training record as a conversation; an input that isn't blank stands on a line of its own."""
    user = F.when(F.trim(F.coalesce(input_, F.lit(""))) != "", F.concat(instruction, F.lit("\n"), input_)).otherwise(instruction)
    return turns(("user", user), ("assistant", output))


def literal(qtype: str) -> Column:
    """A query as its literal, from the plan's columns."""
    from .ir import SHAPES

    e = r = 0
    parts = []
    for word in re.split(r"('e'|'r')", SHAPES[qtype]):
        if word == "'e'":
            e += 1
            parts.append(F.col(f"e{e}").cast("string"))
        elif word == "'r'":
            r += 1
            parts.append(F.col(f"r{r}").cast("string"))
        elif word:
            parts.append(F.lit(word.replace(" ", "")))
    assert (e, r) == slots(topology(qtype))
    return F.concat(*parts)
