"""All topologies, evidence and step allocation on a graph of fourteen triples."""

import random

import pytest

from loomstone.plans import evidence as E
from loomstone.plans import ir
from loomstone.plans import prompts as P
from loomstone.plans.lowering import Lowered, answer_sets

KG = [(1, 10, 2), (1, 10, 3), (1, 11, 3), (2, 10, 4), (3, 10, 4), (3, 11, 5), (3, 12, 6), (5, 11, 4), (5, 12, 3), (7, 10, 3), (7, 11, 4), (7, 12, 5), (4, 12, 6), (4, 11, 3)]
CASES = {
    "(1,(10,))": ("1p", {2, 3}, "(1,10,2),(1,10,3)"),
    "(1,(10,10))": ("2p", {4}, "(1,10,2),(1,10,3),(2,10,4),(3,10,4)"),
    "(1,(10,10,12))": ("3p", {6}, "(1,10,2),(1,10,3),(2,10,4),(3,10,4),(4,12,6)"),
    "((1,(10,)),(7,(10,)))": ("2i", {3}, "(1,10,3),(7,10,3)"),
    "((1,(10,)),(7,(10,)),(5,(12,)))": ("3i", {3}, "(1,10,3),(5,12,3),(7,10,3)"),
    "(((1,(10,)),(7,(10,))),(11,))": ("ip", {5}, "(1,10,3),(3,11,5),(7,10,3)"),
    "((1,(10,10)),(7,(11,)))": ("pi", {4}, "(1,10,2),(1,10,3),(2,10,4),(3,10,4),(7,11,4)"),
    "((1,(10,)),(7,(12,)),('u',))": ("2u", {2, 3, 5}, "(1,10,2),(1,10,3),(7,12,5)"),
    "(((1,(10,)),(7,(12,)),('u',)),(11,))": ("up", {4, 5}, "(1,10,3),(3,11,5),(5,11,4),(7,12,5)"),
    "((1,(10,)),(7,(11,'n')))": ("2in", {3}, "(1,10,3),(7,10,3)"),
    "((1,(10,)),(7,(10,)),(5,(11,'n')))": ("3in", {3}, "(1,10,3),(5,12,3),(7,10,3)"),
    "(((1,(10,)),(7,(11,'n'))),(12,))": ("inp", {6}, "(1,10,3),(3,12,6),(7,10,3)"),
    "((1,(10,10)),(7,(10,'n')))": ("pin", {4}, "(1,10,2),(1,10,3),(2,10,4),(3,10,4),(7,11,4)"),
    "((1,(10,11,'n')),(7,(11,)))": ("pni", {4}, "(1,10,2),(1,10,3),(2,10,4),(3,10,4),(7,11,4)"),
}


def table(spark, literals):
    rows = []
    for qid, literal in enumerate(literals):
        _, e, r = ir.parse(literal)
        rows.append([qid, *e, *r])
    e, r = ir.slots(ir.parse(literals[0])[0])
    names = ["qid bigint", *[f"e{i} bigint" for i in range(1, e + 1)], *[f"r{i} int" for i in range(1, r + 1)]]
    return spark.createDataFrame(rows, ", ".join(names))


@pytest.fixture(scope="module")
def kg(spark):
    return spark.createDataFrame(KG, "h bigint, r int, t bigint").cache()


@pytest.mark.parametrize("literal", CASES)
def test_topology(spark, kg, literal):
    qtype, answer, text = CASES[literal]
    assert ir.qtype_of(literal) == qtype
    plan = table(spark, [literal])
    low = Lowered(ir.topology(qtype), plan, kg)
    assert {r.ent for r in low.answers().collect()} == answer
    assert E.query_texts(plan, low.evidence()).first().triples == text
    fixed = Lowered(ir.topology(qtype), plan, kg, {i: r for i, r in enumerate(ir.parse(literal)[2], 1)})
    assert {r.ent for r in fixed.answers().collect()} == answer
    assert plan.select(P.literal(qtype).alias("x")).first().x == literal


def test_steps_are_all_there(spark, kg):
    plan = table(spark, ["((1,(10,)),(7,(12,)))", "((99,(10,)),(7,(10,)))"])
    low = Lowered(ir.topology("2i"), plan, kg)
    steps = {(r.qid, r.step): r.triples for r in E.step_texts(plan, low.evidence(), "2i").collect()}
    assert steps == {(q, s): "" for q in (0, 1) for s in (1, 2, 3)}
    assert [r.answer for r in answer_sets(plan, low.answers()).collect()] == [[], []]


def test_step_rules_overlap(spark, kg):
    plan = table(spark, ["(((1,(10,)),(7,(12,)),('u',)),(11,))"])
    steps = {r.step: r.triples for r in E.step_texts(plan, Lowered(ir.topology("up"), plan, kg).evidence(), "up").collect()}
    assert steps == {1: "(1,10,3)", 2: "(7,12,5)", 3: "", 4: "(3,11,5),(5,11,4)"}
    low = Lowered(ir.topology("up"), plan, kg)
    low.forward()
    by_use = {(r.step, r.h) for r in E.by_provenance(low.kept()).collect()}
    assert by_use == {(1, 1), (2, 7), (3, 3), (3, 5)}


def test_evidence_is_sufficient(spark):
    r = random.Random(3)
    triples = sorted({(r.randrange(12), r.randrange(3), r.randrange(12)) for _ in range(70)})
    kg = spark.createDataFrame(triples, "h bigint, r int, t bigint").cache()
    for qtype in ("ip", "pi", "up", "pni"):
        tree = ir.topology(qtype)
        e, n = ir.slots(tree)
        plan = spark.createDataFrame([[0, *[r.randrange(12) for _ in range(e)], *[r.randrange(3) for _ in range(n)]]], ", ".join(["qid bigint", *[f"e{i} bigint" for i in range(1, e + 1)], *[f"r{i} int" for i in range(1, n + 1)]]))
        low = Lowered(tree, plan, kg)
        own = spark.createDataFrame([tuple(x) for x in low.evidence().select("h", "r", "t").collect()], "h bigint, r int, t bigint")
        assert set(triples) >= {tuple(x) for x in own.collect()}
        assert sorted(Lowered(tree, plan, own).answers().collect()) == sorted(low.answers().collect())


@pytest.mark.parametrize("bad", ["((1,(10,)),('u',))", "5", "(1,10)", "((1,(10,(2,))),)"])
def test_bad_literals(bad):
    with pytest.raises((ValueError, SyntaxError)):
        ir.parse(bad)


def random_graph(seed, people=12, size=90):
    import random

    r = random.Random(seed)
    return sorted({(r.randrange(people), r.randrange(1, 5), r.randrange(people)) for _ in range(size)})


def walk(tree, ents, rels, kg):
    """(answers, function from answers to the edges that derive them, with the slots that used them), by sets."""
    from loomstone.plans.ir import Anchor, Intersect, Project

    if isinstance(tree, Anchor):
        return {ents[tree.slot - 1]}, lambda keep: set()
    if isinstance(tree, Project):
        below, why = walk(tree.child, ents, rels, kg)
        edges = {(h, r, t) for h, r, t in kg if h in below and (r != rels[tree.slot - 1] if tree.other else r == rels[tree.slot - 1])}

        def back(keep):
            mine = {e for e in edges if e[2] in keep}
            return {(*e, tree.slot) for e in mine} | why({h for h, _, _ in mine})

        return {t for _, _, t in edges}, back
    parts = [walk(p, ents, rels, kg) for p in tree.parts]
    sets = [p[0] for p in parts]
    joined = set.intersection(*sets) if isinstance(tree, Intersect) else set.union(*sets)
    return joined, lambda keep: set().union(*[why(keep & own) for own, why in parts])


def test_mixed_batch(spark):
    """Every topology, deeper literals, a union of intersections, queries without answers and broken literals in one batch, against sets; over stored triples, with and without the cut to few relations."""
    import random

    from loomstone.plans import batch
    from loomstone.plans.ir import SHAPES, parse
    from loomstone.sources.graph import indexed

    r, kg = random.Random(8), random_graph(8)
    texts = [s for s in SHAPES.values() for _ in range(4)] + ["(((('e',('r',)),('e',('r',))),(('e',('r','r')),('e',('r',))),('u',)),('r','r','n','r'))", "((('e',('r',)),('e',('r',))),('e',('r',)),('u',))"] * 8 + ["('e',('r','r','r','r','r'))"] * 3
    literals = []
    for s in texts:
        while "'e'" in s or "'r'" in s:
            s = s.replace("'e'", str(r.randrange(14)), 1).replace("'r'", str(r.randrange(1, 6)), 1)
        literals.append(s)
    bad = ["", "(1", "(1,(2,))x", "(1,2)", "('x',(1,))", None, "(" * 3000]
    queries = spark.createDataFrame(list(enumerate(literals)) + [(1000 + i, b) for i, b in enumerate(bad)], "qid long, literal string")
    triples = spark.createDataFrame(kg, "h long, r int, t long")
    nodes, faults = batch.literal_nodes(queries)
    assert {x.qid for x in faults.collect()} == {1000 + i for i in range(len(bad))}
    want, why = set(), {}
    for qid, text in enumerate(literals):
        tree, ents, rels = parse(text)
        found, back = walk(tree, [int(e) for e in ents], [int(x) for x in rels], kg)
        want |= {(qid, e) for e in found}
        number = {n["r"]: n["node"] for n in batch.tree_nodes(tree) if n["kind"] == "P"}
        for h, rel, t, slot in back(found):
            why.setdefault((qid, h, rel, t), set()).add(number[slot])
    for run in (batch.Batch(nodes, triples), batch.Batch(nodes, indexed(triples), most_relations=2)):
        assert {tuple(x) for x in run.answers().collect()} == want
        assert {(x.qid, x.h, x.r, x.t): set(x.nodes) for x in run.evidence().collect()} == why
    assert batch.Batch(nodes.where("false"), triples).answers().count() == 0


def test_scans_of_stored_triples_are_pruned(spark):
    from loomstone.plans.ir import topology
    from loomstone.plans.lowering import Lowered, only
    from loomstone.sources.graph import indexed

    kg = indexed(spark.createDataFrame(random_graph(2), "h long, r int, t long"))
    plan = spark.createDataFrame([(i, i, 1 + i % 2) for i in range(10)], "qid long, e1 long, r1 int")
    run = Lowered(topology("1p"), plan, kg, stored=True)
    assert sorted(tuple(x) for x in run.answers().distinct().collect()) == sorted({(i, t) for i in range(10) for h, r, t in random_graph(2) if h == i and r == 1 + i % 2})
    cut = only(kg, plan.select("r1"))
    explained = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [r#" in explained.replace("isnotnull", "") and " IN (" in explained.split("PartitionFilters")[1].split("]")[0]
    assert "IN (" not in only(kg, plan.select("r1"), 1)._jdf.queryExecution().executedPlan().toString()


def test_intersections_cost_what_their_smallest_part_has(spark, tmp_path):
    """Many queries share a hub of which each needs one tail: the hub is walked once, not for each query."""
    n = 300
    kg = spark.createDataFrame([(1, 1, 1000 + i) for i in range(n)] + [(1000 + i, 2, 5000 + i) for i in range(n)] + [(9000 + i, 3, 5000 + i) for i in range(n)] * 2, "h bigint, r int, t bigint")
    plan = spark.createDataFrame([(i, 1, 9000 + i) for i in range(n)], "qid bigint, e1 bigint, e2 bigint")
    low = Lowered(ir.topology("pi"), plan, kg, {1: 1, 2: 2, 3: 3}, stored=True)
    assert sorted(map(tuple, low.answers().collect())) == [(i, 5000 + i) for i in range(n)]
    assert low.evidence().count() == 3 * n
    assert sum(df.count() for df in low.edges.values()) == 4 * n  # the second part's triples are given twice


def test_tables_that_grow_are_not_sent_through_the_driver(spark):
    """Files of a few MB hold more rows than a driver should collect to broadcast them: edges, parts of intersections, orders and customers are joined where they lie."""
    from loomstone import registry

    kg = spark.createDataFrame([(1, 1, 10), (10, 2, 50), (9, 3, 50)], "h bigint, r int, t bigint")
    plan = spark.createDataFrame([(0, 1, 9)], "qid bigint, e1 bigint, e2 bigint")
    joins = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x]
    found = {
        "t#": joins(Lowered(ir.topology("pi"), plan, kg, {1: 1, 2: 2, 3: 3}, stored=True).evidence()), "ent#": joins(Lowered(ir.topology("pi"), plan, kg, {1: 1, 2: 2, 3: 3}).answers()),
        "_orderkey#": joins(registry.base(spark, "/root/testdata/sf0.001")), "_custkey#": joins(registry.base(spark, "/root/testdata/sf0.001")), "_suppkey#": joins(registry.base(spark, "/root/testdata/sf0.001")),
    }
    for key, lines in found.items():
        mine = [x for x in lines if key in x and (key.startswith("_") or "[e1#" in x or "[e2#" in x)]
        assert mine and all("SortMergeJoin" in x for x in mine), (key, lines)


def test_open_relations_of_shared_anchors(spark):
    kg = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 3, 10), (2, 3, 11), (2, 4, 12)], "h bigint, r int, t bigint")
    plan = spark.createDataFrame([(0, 1, 2, 1, 3), (1, 1, 2, 2, 3), (2, 1, 2, 2, 4), (3, None, 2, 1, 3)], "qid bigint, e1 bigint, e2 bigint, r1 int, r2 int")
    low = Lowered(ir.topology("2i"), plan, kg)
    assert sorted(map(tuple, low.answers().collect())) == [(0, 10), (1, 11)]
    assert sorted(map(tuple, low.evidence().collect())) == [(0, 1, 1, 10), (0, 2, 3, 10), (1, 1, 2, 11), (1, 2, 3, 11)]


def test_mixed_batch_walks_a_hub_once(spark):
    """Queries of several topologies share a hub inside an intersection, nested too; it is walked once, not for each of them."""
    from loomstone.plans import batch

    n = 40
    kg = spark.createDataFrame([(1, 1, 1000 + i) for i in range(n)] + [(1000 + i, 2, 5000 + i) for i in range(n)] + [(9000 + i, 3, 5000 + i) for i in range(n)] * 2, "h bigint, r int, t bigint")
    forms = ["((1,(1,2)),({e},(3,)))", "(({e},(3,)),((1,(1,2)),(9001,(3,)),('u',)))"]
    queries = spark.createDataFrame([(2 * i + k, form.format(e=9000 + i)) for i in range(n) for k, form in enumerate(forms)], "qid long, literal string")
    run = batch.Batch(batch.literal_nodes(queries)[0], kg)
    assert sorted(map(tuple, run.answers().collect())) == [(q, 5000 + q // 2) for q in range(2 * n)]
    edges = sum(x.where("h IS NOT NULL AND r = 1").count() for x in run.levels) + sum(x.where("r = 1").count() for x in run.walked)
    assert edges == n + n * n  # once for all intersections, once for each query that unites it
    assert run.evidence().where("qid = 0").orderBy("r").collect() == [(0, 1, 1, 1000, [1]), (0, 1000, 2, 5000, [2]), (0, 9000, 3, 5000, [4])]


def test_literals_are_parsed_once_a_form(spark, monkeypatch):
    from loomstone.plans import batch

    many = [f"(({i},(1,{i})),(7,(2,'n')))" for i in range(300)]
    odd = ["('12',(3,))", "( ' 12 ' ,(3,))", "(007,(1,))", "(-5,(1,))", "(+5,(1,))", "(1_0,(2,))", "(0,(0,))", "(1.0,(2,))", "(12,(3 ,4))", "('\uff15 1',(2,))", "('\uff151',(2,))", "(1,(\u2400,))", "(7355608000000000001,(1,))", "(True,(1,))", "(0x10,(1,))", "(1e2,(1,))", "({5},(1,))", "(1,(2,)) # 3", None]
    queries = spark.createDataFrame(list(enumerate(many + odd)), "qid long, literal string")
    sizes, write = {}, batch.written

    def counted(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(batch, "written", counted)
    nodes, faults = batch.literal_nodes(queries)
    whole = queries.select("qid", batch.parsed_literals("literal").alias("p")).select("qid", "p.*")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(nodes) == rows(whole.where("error IS NULL").selectExpr("qid", "inline(nodes)"))
    assert rows(faults) == rows(whole.where("error IS NOT NULL").select("qid", "error"))
    assert sizes["forms"] <= 1 + len(odd) and sizes["odd"] <= len(odd)


def test_index_of_some_relations(spark):
    from loomstone.sources.graph import order_graph, order_index

    some = order_index(spark, "/root/testdata/sf0.001", (4, 1, 2))
    assert {x.r for x in some.select("r").distinct().collect()} == {1, 2, 4}
    assert some.count() == order_graph(spark, "/root/testdata/sf0.001").where("r IN (1, 2, 4)").count()
