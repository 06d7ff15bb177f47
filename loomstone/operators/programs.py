"""The semantic-program front end: programs to trees, structured parses, grounding, scoring."""

from __future__ import annotations

import json
import unicodedata
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lowering import MOST_RELATIONS
from ..streaming.staged import written

DIRECTIONS = ("forward", "backward")
#: Path lengths of the branches of each structured type.
PATHS = {"1p": (1,), "2p": (2,), "2i": (1, 1)}
#: Topologies by shape of the tree, branches of a group flattened.
BY_SHAPE = {"P(A)": "1p", "P(P(A))": "2p", "I(P(A),P(A))": "2i", "I(P(A),P(A),P(A))": "3i", "U(P(A),P(A))": "2u"}
#: Functions that pass their one dependency through.
_TRANSPARENT = ("FilterConcept", "What")
_GROUPS = {"And": "I", "Or": "U"}


def normal_name(text: str) -> str:
    """A name's key: compatibility form, single spaces, case folded."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else normal_name(n))


# --- programs ------------------------------------------------------------------------------------------


def tree(program: list) -> tuple:
    """A program as a tree: ("A", name), ("P", predicate, direction, tree), ("I" or "U", tree, tree); ("X", reason) for what isn't supported.

    Steps are read from the first to the last, each once, so a step that several others need is one and the same tuple, and a
    program of any length ends.  Dependencies must point backwards.  A step of any other form than
    an object of a function, a list of steps and a list of names or numbers is ("X", ...); numbers become text.
    """
    made: list[tuple] = []
    for step in program:
        made.append(_made(step, made))
    return made[-1]


def _made(step, made: list[tuple]) -> tuple:
    if not isinstance(step, dict):
        return ("X", "step")
    name, needs, inputs = step.get("function"), step.get("dependencies"), step.get("inputs")
    needs, inputs = [] if needs is None else needs, [] if inputs is None else inputs
    if name is not None and not isinstance(name, str):
        return ("X", "function")
    if not isinstance(needs, list):
        return ("X", "dependency")
    if not isinstance(inputs, list) or not all(isinstance(i, (str, int, float)) for i in inputs):
        return ("X", f"{name}_invalid")
    below = [made[d] if type(d) is int and 0 <= d < len(made) else ("X", "dependency") for d in needs]
    return _step(name, below, [i if isinstance(i, str) else json.dumps(i) for i in inputs])


def _below(node: tuple) -> list[tuple]:
    return [c for c in node[1:] if isinstance(c, tuple)]


def _ordered(node: tuple) -> list[tuple]:
    """The different nodes under a node, children before parents, itself last; a node that several need stands once."""
    out, seen, stack = [], set(), [(node, False)]
    while stack:
        n, ready = stack.pop()
        if ready:
            out.append(n)
        elif id(n) not in seen:
            seen.add(id(n))
            stack.append((n, True))
            stack += [(c, False) for c in reversed(_below(n))]
    return out


def unfolded(node: tuple) -> int:
    """Nodes of a tree in which a node that several need is counted for each of them."""
    sizes: dict[int, int] = {}
    for n in _ordered(node):
        sizes[id(n)] = 1 + sum(sizes[id(c)] for c in _below(n))
    return sizes[id(node)]


def _step(name, below: list[tuple], inputs: list) -> tuple:
    """One step over the trees that it needs. The reasons are fixed values."""
    if name == "Find":
        return ("A", inputs[0]) if len(inputs) == 1 else ("X", "Find_invalid")
    if name == "Relate":
        if len(below) != 1 or len(inputs) < 2:
            return ("X", "Relate_invalid")
        return ("P", inputs[0], inputs[1], below[0]) if inputs[1] in DIRECTIONS else ("X", "Relate_invalid_direction")
    if name in _GROUPS:
        return (_GROUPS[name], *below) if len(below) == 2 else ("X", f"{name}_invalid")
    if name in _TRANSPARENT:
        return below[0] if len(below) == 1 else ("X", f"{name}_invalid")
    return ("X", str(name))


def flattened(node: tuple) -> list[dict]:
    """The nodes of a tree, children before parents, the root last: number, kind, numbers of the children, name of an anchor or key of a relation, height. A node that several need is one row."""
    out: list[dict] = []
    number: dict[int, int] = {}
    for n in _ordered(node):
        below = [number[id(c)] for c in _below(n)]
        name = n[1] if n[0] == "A" else f"{n[1]}::{n[2]}" if n[0] == "P" else None
        height = 1 + max((out[b]["height"] for b in below), default=-1)
        number[id(n)] = len(out)
        out.append({"node": len(out), "kind": n[0], "left": below[0] if below else None, "right": below[1] if len(below) > 1 else None, "name": name, "height": height})
    return out


def shape(node: tuple, flat: bool = False) -> str:
    """A tree without its names; ``flat`` merges groups of one kind. Of a tree of more than UNFOLDED nodes, a group or hop that several need is written once and then named by its number, ``#n``."""
    written_, stack = [], [node]
    named: dict[int, int] | None = {} if unfolded(node) > UNFOLDED else None
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            written_.append(n)
            continue
        below = [n[3]] if n[0] == "P" else (branches(n) if flat and named is None else list(n[1:])) if n[0] in "IU" else []
        if named is not None and below and id(n) in named:
            written_.append(f"#{named[id(n)]}")
            continue
        if named is not None and below:
            named[id(n)] = len(named)
        written_.append(n[0] + "(" * bool(below))
        if below:
            stack.append(")")
        for i, c in enumerate(reversed(below)):
            stack += [c] if i == len(below) - 1 else [c, ","]
    return "".join(written_)


def branches(node: tuple) -> list[tuple]:
    """The parts of a group, nested groups of the same kind dissolved; a tree that is no group is its own part."""
    if node[0] not in "IU":
        return [node]
    return [b for part in node[1:] for b in (branches(part) if part[0] == node[0] else [part])]


def components(node: tuple) -> list[dict] | None:
    """Anchor and path of each branch, hops in order; None if a branch is no path."""
    out = []
    for b in branches(node):
        path = []
        while b[0] == "P":
            path.append(f"{b[1]}::{b[2]}")
            b = b[3]
        if b[0] != "A":
            return None
        out.append({"anchor": b[1], "path": path[::-1]})
    return out


_NODE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("height", T.IntegerType())])
_ANALYSIS = T.StructType([T.StructField("shape", T.StringType()), T.StructField("qtype", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("branches", T.StringType()), T.StructField("nodes", T.ArrayType(_NODE))])
#: Nodes up to which a tree's shape is written in full; it bounds the text, not what is run.
UNFOLDED = 500


def analysis(text: str | None) -> tuple:
    """(shape, topology, why it isn't supported, branches as JSON, nodes) of a program as JSON."""
    try:
        program = json.loads(text) if text else []
    except (ValueError, RecursionError):
        return None, None, "invalid_json", None, None
    if not isinstance(program, list) or not program:
        return None, None, "empty", None, None
    node = tree(program)
    small = unfolded(node) <= UNFOLDED  # a supported shape has eight nodes at most
    qtype = BY_SHAPE.get(shape(node, True)) if small else None
    parts = components(node) if qtype else None
    nodes = flattened(node) if all(n[0] != "X" for n in _ordered(node)) else None
    return shape(node), qtype, None if parts else "unsupported_shape", json.dumps(parts) if parts else None, nodes


@F.pandas_udf(_ANALYSIS)
def analysed(programs: pd.Series) -> pd.DataFrame:
    """Of a program as JSON: shape, topology, why it isn't supported, branches as JSON, and the nodes of its tree, null where a step isn't supported."""
    return pd.DataFrame([analysis(p if isinstance(p, str) else None) for p in programs], columns=_ANALYSIS.names)


def function_inventory(questions: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, patterns, successors of Or) with counts; the k most frequent patterns, ties to the one seen first. ``questions`` has (source_index, program array<struct<function,dependencies,inputs>>)."""
    steps = questions.select("source_index", F.posexplode("program").alias("at", "s")).select("source_index", "at", "s.function", "s.dependencies")
    functions = steps.groupBy("function").count()
    patterns = questions.select("source_index", F.array_join(F.transform("program", lambda s: s["function"]), ">").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"), F.min("source_index").alias("seen")).orderBy(F.desc("n"), "seen").limit(k)
    used = steps.select("source_index", F.col("function").alias("successor"), F.explode("dependencies").alias("at"))
    after = steps.where("function = 'Or'").select("source_index", "at").join(used, ["source_index", "at"], "left")
    return functions, patterns, after.groupBy(F.coalesce("successor", F.lit("END")).alias("successor")).count()


def executed(nodes: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, ent): directed queries over a knowledge base, of any depth and any nesting.

    ``nodes`` has (qid, node, kind, left, right, name, height), the trees of a batch of queries; ``names`` (id, name),
    where a name may seed several ids; ``edges`` (h, predicate, direction, t).  A batch is run height by height:
    there are as many rounds as the highest tree has levels, each a few joins over all queries, and each is
    written before the next.  A name that nobody bears and a hop that leads nowhere give no entities.  Of the edges only
    those of predicates and directions that the batch names are read, if these are at most MOST_RELATIONS.
    """
    nodes = written(nodes.select("qid", "node", "kind", "left", "right", "name", "height"), "nodes")
    keyed = edges.select(F.col("h").alias("ent"), F.concat_ws("::", "predicate", "direction").alias("name"), "t")
    anchors = nodes.where("kind = 'A'").join(names.select("name", F.col("id").alias("ent")).distinct(), "name")
    done = written(anchors.select("qid", "node", "ent"), "reached")
    asked = [x[0] for x in nodes.where("kind = 'P'").select("name").distinct().limit(MOST_RELATIONS + 1).collect()]
    keyed = keyed.where(F.col("name").isin(asked)) if len(asked) <= MOST_RELATIONS else keyed
    highest = nodes.agg(F.max("height")).first()[0] or 0
    for height in range(1, highest + 1):
        here = nodes.where(F.col("height") == height)
        left = here.join(done.select("qid", F.col("node").alias("left"), "ent"), ["qid", "left"])
        hops = left.where("kind = 'P'").join(keyed, ["ent", "name"]).select("qid", "node", F.col("t").alias("ent"))
        right = here.join(done.select("qid", F.col("node").alias("right"), "ent"), ["qid", "right"]).select("qid", "node", "kind", "ent")
        both = left.where("kind = 'I'").select("qid", "node", "ent").join(right.where("kind = 'I'").select("qid", "node", "ent"), ["qid", "node", "ent"], "left_semi")
        either = left.where("kind = 'U'").select("qid", "node", "ent").union(right.where("kind = 'U'").select("qid", "node", "ent"))
        reached = hops.union(both).union(either).distinct()
        done = done.union(written(reached, "reached"))
    top = nodes.groupBy("qid").agg(F.max("node").alias("node"))
    return done.join(top, ["qid", "node"]).select("qid", "ent").distinct()


def path_nodes(parts: DataFrame, union: bool = False) -> DataFrame:
    """The nodes of queries given as branches (qid, branch, anchor, path array<predicate::direction>): paths of any length, joined by intersection or union two by two."""
    kind = F.lit("U" if union else "I")
    ordered = parts.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("branch", "anchor", "path"))).alias("b"))
    # Numbers: branch i has its anchor at its base and its hops behind; the groups come after all branches.
    sizes = F.transform("b", lambda x: F.size(x["path"]) + 1)
    base = lambda i: F.aggregate(F.slice(F.col("sizes"), 1, i), F.lit(0), lambda a, x: a + x)
    end = lambda i: base(i) + F.get(F.col("sizes"), i) - 1
    null = F.lit(None).cast("int")
    node = lambda n, k, left, right, name, h: F.struct(n.cast("int").alias("node"), k.alias("kind"), left.cast("int").alias("left"), right.cast("int").alias("right"), name.cast("string").alias("name"), h.cast("int").alias("height"))
    hop = lambda i: lambda key, j: node(base(i) + j + 1, F.lit("P"), base(i) + j, null, key, j + 1)
    paths = F.flatten(F.transform("b", lambda x, i: F.concat(F.array(node(base(i), F.lit("A"), null, null, x["anchor"], F.lit(0))), F.transform(x["path"], hop(i)))))
    total, count, tallest = base(F.size("b")), F.size("b"), F.array_max("sizes") - 1
    groups = F.when(count > 1, F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: node(total + i - 1, kind, F.when(i == 1, end(F.lit(0))).otherwise(total + i - 2), end(i), F.lit(None), tallest + i)))
    with_sizes = ordered.withColumn("sizes", sizes)
    empty = F.array().cast("array<struct<node:int,kind:string,left:int,right:int,name:string,height:int>>")
    return with_sizes.select("qid", F.inline(F.concat(paths, F.coalesce(groups, empty))))


def executed_paths(parts: DataFrame, names: DataFrame, edges: DataFrame, union: bool = False) -> DataFrame:
    """(qid, ent) of queries given as branches."""
    return executed(path_nodes(parts, union), names, edges)


def names_of(found: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, ent, name): ids with their names; ids without one are left out."""
    return found.join(names.select(F.col("id").alias("ent"), "name"), "ent").select("qid", "ent", "name")


def candidates(questions: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, qtype, shape, reason, answer_ids): which questions can stand in a benchmark, and why the others can't.

    ``questions`` has (qid, program, answer), the program as JSON.  The first reason in this order counts: no program
    or unreadable, another topology, an anchor whose name isn't that of exactly one id, no gold answer, gold that
    is no entity's name, and a program whose answers don't all bear the gold's name.  Fixed values: the reasons.
    """
    a = written(questions.select("qid", "answer", analysed("program").alias("a")).select("qid", "answer", "a.*"), "programs")
    known = a.where("qtype IS NOT NULL AND nodes IS NOT NULL")
    nodes = written(known.select("qid", F.inline("nodes")), "nodes")
    bearers = names.groupBy("name").agg(F.countDistinct("id").alias("ids"))
    anchors = nodes.where("kind = 'A'").join(bearers, "name", "left").groupBy("qid").agg(F.max((F.coalesce("ids", F.lit(0)) != 1).cast("int")).alias("unclear"))
    gold = known.select("qid", F.col("answer").alias("name")).join(bearers, "name").select("qid", F.lit(True).alias("is_entity"))
    found = written(executed(nodes, names, edges), "answers")
    named = found.join(names.select(F.col("id").alias("ent"), "name"), "ent", "left").groupBy("qid").agg(F.array_sort(F.collect_set("ent")).alias("ids"), F.collect_set("name").alias("bear"), F.count_if(F.col("name").isNull()).alias("nameless"))
    row = a.join(anchors, "qid", "left").join(gold, "qid", "left").join(named, "qid", "left")
    said = lambda what: F.concat(F.col("qtype"), F.lit(f":{what}"))
    reason = (
        F.when(F.col("shape").isNull(), F.when(F.col("reason") == "empty", "empty_program").otherwise(F.col("reason"))).when(F.col("qtype").isNull() | F.col("nodes").isNull(), "not_target_topology")
        .when(F.col("unclear") == 1, said("ambiguous_anchor")).when(F.col("answer").isNull(), said("gold_not_string")).when(F.col("is_entity").isNull(), said("gold_not_entity"))
        .when(F.coalesce(F.size("bear") != 1, F.lit(True)) | ~F.array_contains(F.coalesce("bear", F.array(F.lit(""))), F.col("answer")) | (F.col("nameless") > 0), said("reduced_query_not_equal_gold"))
    )
    return row.withColumn("why", reason).select("qid", "qtype", "shape", F.col("why").alias("reason"), F.when(F.col("why").isNull(), F.col("ids")).alias("answer_ids"))


# --- structured parses ---------------------------------------------------------------------------------


def _faults(value):
    """(reason, holds) in the order in which a parse is judged; later checks may rely on earlier ones. The reasons are fixed values."""
    yield "top_level_not_object", isinstance(value, dict)
    yield "invalid_top_level_fields", set(value) == {"type", "query"}
    yield "invalid_qtype", isinstance(value["type"], str) and value["type"] in PATHS
    query, lengths = value["query"], PATHS[value["type"]]
    yield "query_not_list", isinstance(query, list)
    yield "invalid_branch_count", len(query) == len(lengths)
    for branch, length in zip(query, lengths, strict=True):
        yield "branch_not_object", isinstance(branch, dict)
        yield "invalid_branch_fields", set(branch) == {"anchor", "path"}
        yield "invalid_anchor", isinstance(branch["anchor"], str) and bool(branch["anchor"].strip())
        yield "path_not_list", isinstance(branch["path"], list)
        yield "invalid_path_length", len(branch["path"]) == length
        for step in branch["path"]:
            yield "path_step_not_object", isinstance(step, dict)
            yield "invalid_path_step_fields", set(step) == {"relation", "direction"}
            yield "invalid_relation", isinstance(step["relation"], str) and bool(step["relation"].strip())
            yield "invalid_direction", step["direction"] in DIRECTIONS


def parsed(text) -> tuple[dict | None, str | None]:
    """(value, None), or (None, reason)."""
    if isinstance(text, str):
        try:
            value = json.loads(text.strip())
        except (ValueError, RecursionError):
            return None, "invalid_json"
    elif isinstance(text, dict):
        value = text
    else:
        return None, "invalid_output_type"
    for reason, holds in _faults(value):
        if not holds:
            return None, reason
    return value, None


_BRANCHES = T.ArrayType(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("path", T.ArrayType(T.StructType([T.StructField("relation", T.StringType()), T.StructField("direction", T.StringType())])))]))
_PARSE = T.StructType([T.StructField("type", T.StringType()), T.StructField("query", _BRANCHES), T.StructField("error", T.StringType())])


@F.pandas_udf(_PARSE)
def parsed_output(texts: pd.Series) -> pd.DataFrame:
    """A parser's output, checked strictly: type and branches, or the first fault."""
    both = [parsed(t) for t in texts]
    return pd.DataFrame({"type": [v and v["type"] for v, _ in both], "query": [v and v["query"] for v, _ in both], "error": [e for _, e in both]})


def formatted(qtype: Column, branches_: Column) -> Column:
    """A structured query as the JSON that a parser is asked for."""
    return F.to_json(F.struct(qtype.alias("type"), branches_.alias("query")))


def grounded(parses: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """(qid, status, failure_reason, branches): parses with names replaced by ids.

    ``parses`` has (qid, type, query, error), ``names`` (key, ids), ``relations`` (key, spellings), keys
    normalised.  A name must have exactly one id.  The first failure in reading order counts; failed
    parses stay in the result.
    """
    b = parses.where("error IS NULL").select("qid", F.posexplode("query").alias("branch", "q"))
    anchors = b.select("qid", "branch", F.lit(-1).alias("hop"), F.col("q.anchor").alias("name"), F.lit(None).cast("string").alias("direction")).withColumn("key", name_key("name"))
    hops = b.select("qid", "branch", F.posexplode("q.path").alias("hop", "s")).select("qid", "branch", "hop", F.col("s.relation").alias("name"), F.col("s.direction").alias("direction")).withColumn("key", name_key("name"))
    judge = lambda ids, what: F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, f"{what}_not_found").when(F.size(ids) > 1, f"{what}_ambiguous")
    a = anchors.join(names.select("key", "ids"), "key", "left").withColumn("failure", judge(F.col("ids"), "entity")).withColumn("value", F.get("ids", 0)).drop("ids")
    r = hops.join(relations.select("key", "spellings"), "key", "left").withColumn("failure", judge(F.col("spellings"), "relation")).withColumn("value", F.concat_ws("::", F.get("spellings", 0), "direction")).drop("spellings")
    every = a.unionByName(r)
    per_query = every.groupBy("qid").agg(F.min_by("failure", F.when(F.col("failure").isNotNull(), F.struct("branch", "hop"))).alias("failure"), F.array_sort(F.collect_list(F.struct("branch", "hop", "value"))).alias("parts"))
    out = parses.select("qid", "error").join(per_query, "qid", "left").withColumn("failure_reason", F.coalesce("error", "failure"))
    return out.select("qid", F.when(F.col("failure_reason").isNull(), "ok").otherwise("failed").alias("status"), "failure_reason", F.when(F.col("failure_reason").isNull(), F.col("parts")).alias("branches"))


# --- scoring -------------------------------------------------------------------------------------------

SCORES = ("format_correct", "type_correct", "anchor_correct", "anchor_total", "relation_correct", "relation_total", "direction_correct", "direction_total", "relation_slot_correct", "relation_slot_total", "exact_correct")


def _hits(gold: dict, pred: dict) -> tuple[int, int, int, int]:
    """Anchor, relations, directions and whole slots that agree in two branches."""
    pairs = [(normal_name(g["relation"]) == normal_name(p["relation"]), g["direction"] == p["direction"]) for g, p in zip(gold["path"], pred["path"])]  # noqa: B905  paths may differ in length
    return int(normal_name(gold["anchor"]) == normal_name(pred["anchor"])), sum(r for r, _ in pairs), sum(d for _, d in pairs), sum(r and d for r, d in pairs)


def score(gold: dict, pred: dict | None) -> dict[str, float]:
    """One parse against gold. Branches of an intersection are paired in the order that agrees most, the first such; parses with another number of branches pair with none."""
    slots = sum(len(b["path"]) for b in gold["query"])
    anchors = len(gold["query"])
    best = (0, 0, 0, 0)
    if pred is not None and len(pred["query"]) == anchors:
        orders = permutations(pred["query"]) if gold["type"] == "2i" else [tuple(pred["query"])]
        sums = [tuple(map(sum, zip(*(_hits(g, p) for g, p in zip(gold["query"], o, strict=True)), strict=True))) for o in orders]
        best = max(sums, key=lambda s: s[0] + s[1] + s[2])
    kind = float(pred is not None and pred["type"] == gold["type"])
    whole = float(kind and best[0] == anchors and best[1] == slots and best[2] == slots)
    values = (float(pred is not None), kind, best[0], anchors, best[1], slots, best[2], slots, best[3], slots, whole)
    return dict(zip(SCORES, map(float, values), strict=True))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in SCORES]))
def parse_score(golds: pd.Series, preds: pd.Series) -> pd.DataFrame:
    """Scores of a parser's output (text) against gold (text); gold that is no parse fails."""
    rows = []
    for gold, pred in zip(golds, preds, strict=True):
        value, _ = parsed(gold)
        if value is None:
            raise ValueError("gold is no parse")
        rows.append(score(value, parsed(pred)[0]))
    return pd.DataFrame(rows, columns=list(SCORES))


def micro(scores: DataFrame, *by: str) -> DataFrame:
    """Sums of what is right over sums of what there is, and the mean of exact matches."""
    ratio = lambda n: F.try_divide(F.sum(f"{n}_correct"), F.sum(f"{n}_total")).alias(n)
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("format_correct").alias("format"), F.avg("type_correct").alias("type"), *[ratio(n) for n in ("anchor", "relation", "direction", "relation_slot")], F.avg("exact_correct").alias("exact"))


def report(grounded_: DataFrame, qtype: str = "qtype") -> DataFrame:
    """Counts and success rate of each type, and a map of failures."""
    by_reason = grounded_.groupBy(qtype, "failure_reason").count()
    return by_reason.groupBy(qtype).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("failure_reason").isNull(), F.col("count")).otherwise(0)).alias("ok"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("failure_reason").isNotNull(), F.struct("failure_reason", "count"))))).alias("failures")).withColumn("success_rate", F.col("ok") / F.col("n"))


def chat_records(questions: DataFrame, system: str) -> DataFrame:
    """(messages, qtype, sample_id, source_index): question and parse as a conversation of three turns."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    n = F.row_number().over(Window.partitionBy("qtype").orderBy("source_index"))
    return questions.select(F.array(turn("system", F.lit(system)), turn("user", F.col("question")), turn("assistant", formatted(F.col("qtype"), F.col("query")))).alias("messages"), "qtype", F.format_string("%s_%04d", F.col("qtype"), n).alias("sample_id"), "source_index")
