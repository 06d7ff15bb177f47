"""Controlled changes: distractors, corrupted relations, swapped topologies, remapped ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.staged import written
from .sampling import order, unit


def noise_size(size: Column, ratio: float, least: int, most: int) -> Column:
    """How many distractors a phase gets: a share of its evidence, within bounds; none for ratio 0."""
    return F.lit(0) if not ratio else F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(size * F.lit(ratio)).cast("int")))


def _number(seed: str, *keys: str) -> Column:
    """A whole number below 2^32 from a row's keys."""
    return F.conv(F.substring(order(seed, *keys), 1, 8), 16, 10).cast("long")


#: Buckets that a phase looks into before it looks into all.
SPAN = 2


def _counts(kg: DataFrame, most: int) -> DataFrame:
    """(r, rn, gn): how many buckets each relation has and how many all triples have; a bucket has some 8 * most triples."""
    sizes = kg.groupBy("r").agg(F.count("*").alias("own"))
    every = sizes.agg(F.sum("own").alias("all"))  # one row
    count = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / (8 * most))).cast("long")
    return sizes.crossJoin(F.broadcast(every)).select("r", count("own").alias("rn"), count("all").alias("gn"))


def _dealt(kg: DataFrame, counts: DataFrame, seed: str) -> DataFrame:
    """(h, r, t, rb, gb): triples with their bucket among those of their relation and among all."""
    x = kg.join(counts, "r").withColumn("x", _number(f"{seed}|pool", "h", "r", "t"))
    return x.select("h", "r", "t", F.pmod("x", "rn").alias("rb"), F.pmod("x", "gn").alias("gb"))


def _starts(want: DataFrame, counts: DataFrame, same: bool, seed: str) -> DataFrame:
    """Phases that take any, with the number of buckets that they may look into and the first of them: those of their relation (``same``) or of all triples."""
    total = counts.select(F.col("r").alias("relation"), F.col("rn").alias("buckets")) if same else F.broadcast(counts.agg(F.first("gn").alias("buckets")))  # one row
    phases = want.where("take > 0")
    phases = phases.join(total, "relation") if same else phases.crossJoin(total)
    return phases.withColumn("first", F.pmod(_number(f"{seed}|start", "qid", "step"), "buckets"))


def _looked(phases: DataFrame, last: Column) -> DataFrame:
    """Each phase with the buckets ``at`` from its first to the ``last`` one away."""
    return phases.withColumn("away", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("at", F.pmod(F.col("first") + F.col("away"), F.col("buckets")))


def _last() -> Column:
    return F.least(F.lit(SPAN), F.col("buckets")) - 1


def _near(dealt: DataFrame, same: DataFrame, any_: DataFrame) -> DataFrame:
    """The triples of the buckets that phases look into before they look into all, and no other: ``same`` by relation, ``any_`` of all triples."""
    one = _looked(same, _last()).select(F.col("relation").alias("r"), F.col("at").alias("rb"), F.lit(True).alias("own")).distinct()
    every = _looked(any_, _last()).select(F.col("at").alias("gb"), F.lit(True).alias("all")).distinct()
    return dealt.join(one, ["r", "rb"], "left").join(every, "gb", "left").where("own OR all").select("h", "r", "t", "rb", "gb")


def _drawn(phases: DataFrame, near: DataFrame, dealt: DataFrame, heads: DataFrame, same: bool, seed: str, barred: DataFrame | None = None) -> DataFrame:
    """(qid, step, n, h, r, t): the first ``take`` triples of each phase, numbered, by how many buckets they are away from the phase's first and then in hash order.

    ``same``: of the phase's relation from other heads; else from other heads by other relations.  With ``barred``,
    triples of phases that were drawn before, anything but the phase's own evidence counts that wasn't.  Phases look
    into SPAN buckets, of which ``near`` has the triples; those that find too little there look into all of ``dealt``, so
    what a phase draws is what it would draw from the whole graph.
    """
    bucket = "rb" if same else "gb"

    def met(of: DataFrame, pool: DataFrame, last: Column) -> DataFrame:
        looked = _looked(of, last)
        on = (F.col("at") == F.col(bucket)) & (F.col("relation") == F.col("r")) if same else F.col("at") == F.col(bucket)
        found = looked.join(pool.select("h", "r", "t", bucket), on).select("qid", "step", "relation", "take", "away", "h", "r", "t")
        if barred is None:
            found = found.join(heads, ["qid", "step", "h"], "left_anti")
            found = found if same else found.where("r <> relation")
        else:
            own = heads.withColumn("own", F.lit(True))
            found = found.join(own, ["qid", "step", "h"], "left").where("own IS NULL OR r <> relation").drop("own").join(barred, ["qid", "step", "h", "r", "t"], "left_anti")
        w = Window.partitionBy("qid", "step").orderBy("away", order(seed, "qid", "step", "h", "r", "t"), "h", "r", "t")
        return found.withColumn("n", F.row_number().over(w)).where("n <= take").select("qid", "step", "n", "h", "r", "t")

    first = written(met(phases, near, _last()), "first")
    enough = first.groupBy("qid", "step").agg(F.count("*").alias("got"))
    short = written(phases.join(enough, ["qid", "step"], "left").where(f"coalesce(got, 0) < take AND buckets > {SPAN}").drop("got"), "short")
    if not short.limit(1).count():
        return first
    return first.join(short.select("qid", "step"), ["qid", "step"], "left_anti").unionByName(met(short, dealt, F.col("buckets") - 1))


def _sized(steps: DataFrame, phases: DataFrame) -> DataFrame:
    """(qid, step, relation, size): phases with evidence, and how many triples of it."""
    own = steps.groupBy("qid", "step").agg(F.countDistinct("h", "r", "t").alias("size"))
    return phases.where("relation IS NOT NULL").select("qid", "step", "relation").join(own, ["qid", "step"]).select("qid", "step", "relation", "size")


def _quota(c: int) -> Column:
    """How many of ``n`` distractors class ``c`` gives: a third, what is left over one by one to the first classes."""
    return (F.floor(F.col("n") / 3) + F.when(F.col("n") % 3 >= c, 1).otherwise(0)).cast("int")


def _ranked(sized: DataFrame, steps: DataFrame, kg: DataFrame, most: int, seed: str, repeated: DataFrame | None = None) -> DataFrame:
    """(qid, step, class, n, h, r, t): distractors of phases (qid, step, relation, n), numbered within phase and class; see ``distractors``.

    The graph is counted and then read for the phases' heads and buckets; what is written of it is what those hold.
    """
    keys = ["qid", "step", "h", "r", "t"]
    want = written(sized.where("n > 0").select("qid", "step", "relation", "n", *[_quota(c).alias(f"take{c}") for c in (1, 2, 3)]), "phases")
    of = lambda c: want.select("qid", "step", "relation", F.col(f"take{c}").alias("take"))
    heads = written(steps.select("qid", "step", "h").distinct().join(want.select("qid", "step"), ["qid", "step"], "left_semi"), "heads")
    source, once = (kg, lambda df: df) if repeated is None else (repeated, DataFrame.distinct)
    counts = written(_counts(kg, most), "counts")
    every = _dealt(source, counts, seed)
    # A phase that lacks some looks into the buckets of all triples from the same first one on.
    near = written(once(_near(every, _starts(of(2), counts, True, seed), _starts(want.withColumn("take", F.col("n")), counts, False, seed))), "near")
    dealt = once(every)
    same_head = once(heads.join(of(1), ["qid", "step"]).join(source.select("h", "r", "t"), "h").where("r <> relation"))
    w = Window.partitionBy("qid", "step").orderBy(order(seed, *keys), "h", "r", "t")
    first = same_head.withColumn("n", F.row_number().over(w)).where("n <= take").select(F.lit(1).alias("class"), "n", *keys)
    classes = [first] + [_drawn(_starts(of(c), counts, c == 2, seed), near, dealt, heads, c == 2, seed).select(F.lit(c).alias("class"), "n", *keys) for c in (2, 3)]
    drawn = written(reduce(DataFrame.unionByName, classes), "drawn")
    got = drawn.groupBy("qid", "step").agg(F.count("*").alias("got"))
    lack = want.join(got, ["qid", "step"], "left").select("qid", "step", "relation", (F.col("n") - F.coalesce("got", F.lit(0))).cast("int").alias("take"))
    rest = _drawn(_starts(lack, counts, False, seed), near, dealt, heads, False, seed, barred=drawn.select(*keys)).select(F.lit(0).alias("class"), "n", *keys)
    return drawn.unionByName(rest)


def distractors(steps: DataFrame, kg: DataFrame, phases: DataFrame, ratio: float, least: int = 1, most: int = 30, seed: str = "42", repeated: DataFrame | None = None) -> DataFrame:
    """(qid, step, class, h, r, t): triples that look like a phase's evidence and aren't.

    ``phases`` has (qid, step, relation); a phase without a relation gets none.  A third each, what is left over one
    by one to the first, comes from: the same heads by another relation (1); the same relation from other heads
    (2); any other heads by any other relation (3).  What a class lacks is filled with anything that isn't the
    phase's own heads by its relation (0).  Everything is drawn in hash order, from buckets of the graph, so a phase
    meets some triples and not the whole graph, and finds whatever the graph has.  ``kg`` has each triple once;
    ``repeated``, if given, is the same graph in which a triple may come several times, and only its triples that a phase meets are made distinct.
    """
    sized = _sized(steps, phases).withColumn("n", noise_size(F.col("size"), ratio, least, most))
    return _ranked(sized, steps, kg, most, seed, repeated).select("qid", "step", "class", "h", "r", "t")


def noise_log(steps: DataFrame, kg: DataFrame, phases: DataFrame, ratios: list[float], least: int = 1, most: int = 30, seed: str = "42", repeated: DataFrame | None = None) -> DataFrame:
    """(ratio, qid, step, class, h, r, t): the distractors of several ratios from one draw.

    The largest ratio is drawn, numbered within phase and class; a smaller ratio takes the first of each class, and of
    the fillers as many as its classes lack.  So each ratio's distractors are among those of the next, and at the
    largest they are those of ``distractors``.  A ratio of 0 has no rows.
    """
    asked = sorted(set(ratios))
    sized = written(_sized(steps, phases), "sizes")
    size = lambda x: noise_size(F.col("size"), x, least, most)
    drawn = written(_ranked(sized.withColumn("n", size(asked[-1])), steps, kg, most, seed, repeated), "ranked")
    each = sized.select("qid", "step", F.inline(F.array(*[F.struct(F.lit(float(x)).alias("ratio"), size(x).cast("int").alias("n")) for x in asked])))
    each = each.select("ratio", "qid", "step", "n", *[_quota(c).alias(f"take{c}") for c in (1, 2, 3)])
    held = drawn.groupBy("qid", "step").agg(*[F.count_if(F.col("class") == c).alias(f"held{c}") for c in (1, 2, 3)])
    short = each.join(held, ["qid", "step"]).withColumn("take0", F.col("n") - sum(F.least(f"take{c}", f"held{c}") for c in (1, 2, 3)))
    takes = short.select("ratio", "qid", "step", F.array(*[F.col(f"take{c}").cast("int") for c in range(4)]).alias("takes"))
    return takes.join(drawn, ["qid", "step"]).where(F.col("n") <= F.get("takes", F.col("class"))).select("ratio", "qid", "step", "class", "h", "r", "t")


def noisy_prompts(plan: DataFrame, steps: DataFrame, log: DataFrame, ratios: list[float], qtype: str) -> DataFrame:
    """(ratio, qid, kind, step, prompt): the three kinds of prompts at every ratio, their evidence and its distractors in one order. ``single`` has step 0; a ratio of 0 has the evidence alone."""
    from ..plans.evidence import query_texts, step_texts_of
    from ..plans.prompts import decomposed_prompts, isolated_prompts, single_prompts

    each = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(ratios))]))
    by = lambda df: df.withColumn("qid", F.struct("ratio", "qid")).drop("ratio")  # noqa: E731  a query at a ratio is a query of its own
    p = written(by(plan.withColumn("ratio", each)), "plans")
    clean = steps.select("qid", "step", "h", "r", "t").withColumn("ratio", each)
    rows = written(by(clean.unionByName(log.select("ratio", "qid", "step", "h", "r", "t"))), "noisy")
    whole = query_texts(p, rows.select("qid", "h", "r", "t").distinct())
    kinds = [("single", single_prompts(p, whole, qtype).withColumn("step", F.lit(0))), ("decomposed", decomposed_prompts(p, whole, qtype)), ("isolated", isolated_prompts(p, step_texts_of(p, rows, qtype), qtype))]
    return reduce(DataFrame.union, [rows_.select("qid.ratio", "qid.qid", F.lit(kind).alias("kind"), F.col("step").cast("int").alias("step"), "prompt") for kind, rows_ in kinds])


def reretrieved(qtype: str, plan: DataFrame, changed: DataFrame, kg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers (qid, before, after), evidence (qid, h, r, t)) of a plan whose relations were changed: gold stays that of the old plan, evidence is that of the new one.

    Only queries of which a slot has changed are run again; the others keep what the old plan found.
    """
    from ..plans.ir import topology
    from ..plans.lowering import Lowered, answer_sets

    slots = [c for c in plan.columns if c != "qid"]
    was, now = written(plan, "plan"), written(changed.select(*plan.columns), "changed")
    new = now.join(was.select("qid", *[F.col(c).alias(f"was_{c}") for c in slots]), "qid").where(" OR ".join(f"NOT ({c} <=> was_{c})" for c in slots)).select(*plan.columns)
    new = written(new, "moved")
    before, after = Lowered(topology(qtype), was, kg, stored=True), Lowered(topology(qtype), new, kg, stored=True)
    gold = written(answer_sets(was, before.answers()), "gold")
    again = answer_sets(new, after.answers())
    answers = gold.select("qid", F.col("answer").alias("before")).join(again.select("qid", F.col("answer").alias("again")), "qid", "left").select("qid", "before", F.coalesce("again", "before").alias("after"))
    kept = before.evidence().join(new.select("qid"), "qid", "left_anti")
    return answers, kept.select("qid", "h", "r", "t").union(after.evidence().select("qid", "h", "r", "t"))


def with_noise(steps: DataFrame, noise: DataFrame) -> DataFrame:
    """(qid, step, h, r, t): each phase's evidence and its distractors."""
    return steps.select("qid", "step", "h", "r", "t").union(noise.select("qid", "step", "h", "r", "t")).distinct()


def corrupted(plan: DataFrame, relations: list[str], pool: list[int], ratio: float, seed: str = "7") -> DataFrame:
    """The plan with each relation slot, with probability ``ratio``, replaced by another relation of the pool, the next in a hashed turn."""
    out = plan
    for slot in relations:
        turn = 1 + F.floor(unit(f"{seed}/pick/{slot}", "qid") * (len(pool) - 1)).cast("int")
        at = F.array_position(F.array(*map(F.lit, pool)), F.col(slot)).cast("int") - 1
        other = F.element_at(F.array(*map(F.lit, pool)), (F.pmod(at + turn, F.lit(len(pool))) + 1).cast("int"))
        out = out.withColumn(f"__{slot}", F.when(unit(f"{seed}/flip/{slot}", "qid") < ratio, other).otherwise(F.col(slot)))
    for slot in relations:
        out = out.drop(slot).withColumnRenamed(f"__{slot}", slot)
    return out.select(*plan.columns)


#: Topologies that are taken for each other.
SWAPPED = {"2i": "2u", "2u": "2i"}


def swapped(qtype: str) -> str:
    return SWAPPED.get(qtype, qtype)


def remapped(triples: DataFrame, entity_offset: int, relation_offset: int) -> DataFrame:
    """Triples in a disjoint namespace."""
    return triples.withColumn("h", F.col("h") + entity_offset).withColumn("r", F.col("r") + relation_offset).withColumn("t", F.col("t") + entity_offset)


def offsets(kg: DataFrame) -> tuple[int, int]:
    """Offsets that keep old and new ids apart: twice the largest entity and one, and the largest relation."""
    row = kg.agg(F.max(F.greatest("h", "t")).alias("e"), F.max("r").alias("r")).first()
    return 2 * row["e"] + 1, row["r"]


def remapped_text(text: Column, entity_offset: int, relation_offset: int) -> Column:
    """A text's triples in the new namespace, rebuilt from what is extracted."""
    from ..functions.text import triples

    return F.array_join(F.transform(triples(text), lambda x: F.format_string("(%d,%d,%d)", x["h"] + entity_offset, x["r"] + relation_offset, x["t"] + entity_offset)), ",")


def remapped_question(text: Column, entity_offset: int, relation_offset: int) -> Column:
    """A question with its entities and relations in the new namespace. Ids behind ``entity`` or ``to`` are entities, those behind ``relation``, ``than`` or ``relationship`` relations; placeholders stay."""
    parts = F.split(text, r"(?<=\b(?:entity|to|relation|relationship|than) )(?=[0-9])", -1)
    moved = lambda p, n: F.concat((F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("long") + n).cast("string"), F.regexp_replace(p, r"^[0-9]+", ""))
    before = lambda i: F.get(parts, i - 1)
    entity = lambda i: before(i).rlike(r"\b(?:entity|to) $")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(entity(i), moved(p, entity_offset)).otherwise(moved(p, relation_offset))), "")


def remapped_answer(answer: Column, entity_offset: int) -> Column:
    """A sorted answer set in the new namespace."""
    return F.transform(answer, lambda t: t + entity_offset)


def union_noise(parts: list[DataFrame]) -> DataFrame:
    """Distractors of all phases of a query as one set."""
    return reduce(DataFrame.union, [p.select("qid", "h", "r", "t") for p in parts]).distinct()
