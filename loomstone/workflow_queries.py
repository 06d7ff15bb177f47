"""Queries over whole workflows: knowledge bases, staged retrieval, stage bounds, costs, exposures, comparisons, record loaders."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import oracle as O
from .functions import setmetrics as M
from .functions import text as X
from .functions.answers import parsed_answer
from .operators import comparisons as C
from .operators import costs, exposures, overlaps, perturb, sampling, stats, summaries
from .operators import programs as G
from .plans import evidence as E
from .plans import knowledge as K
from .plans import prompts as P
from .plans import stages as T
from .registry import _CONTRASTS, _METHODS, _MODELS, _PLAN_CONTRASTS, _PLAN_METHODS, _PLAN_MODELS, _PLANNED, _R6, _REC, _SINGLE, _TEXTS, _TYPES, BATCHES, FIXED, _metric_sql, _pairs_sql, evidence, lowered, order_graph, plan, plan_sql, planned_pairs, predictions, query, records, table
from .plans.lowering import answer_sets
from .sources import files
from .sources import records as R
from .sources.graph import INVERSE, relation_ids
from .streaming.dynamic import run_dynamic
from .streaming.staged import run_incremental, shared_folder

# --- a directed knowledge base made of the order graph ---


def knowledge(spark, sf) -> DataFrame:
    """(h, predicate, direction, t): the graph with text ids and directed predicates, numbered as its relations are."""
    way = F.when(F.col("r") <= INVERSE, "forward").otherwise("backward")
    name = F.concat(F.lit("rel"), F.when(F.col("r") <= INVERSE, F.col("r")).otherwise(F.col("r") - INVERSE).cast("string"))
    text = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string")).alias(c)
    return order_graph(spark, sf).select(text("h"), name.alias("predicate"), way.alias("direction"), text("t"))


def _key(r: int) -> str:
    return f"rel{(r - 1) % INVERSE + 1}::{'forward' if r <= INVERSE else 'backward'}"


def knowledge_plan(spark, sf, qtype: str) -> DataFrame:
    p = plan(spark, sf, qtype)
    return p.select("qid", *[F.concat(F.lit("Q"), F.col(c).cast("string")).alias(c) for c in p.columns if re.fullmatch(r"e\d", c)], *[F.lit(_key(r)).alias(f"r{i}") for i, r in enumerate(FIXED[qtype], 1)])


for _q in ("1p", "2p", "2i"):

    @query(O.query(_q, plan_sql(_q), "SELECT qid, CAST(h AS VARCHAR) AS h, r, CAST(t AS VARCHAR) AS t FROM evidence", base=_q in BATCHES), f"kb_evidence_{_q}")
    def kb_evidence(spark, sf, q=_q):
        edges = knowledge(spark, sf)
        return K.evidence(knowledge_plan(spark, sf, q), edges, relation_ids(edges), q)[0]

    @query(O.query(_q, plan_sql(_q), "SELECT qid, step, CAST(h AS VARCHAR) AS h, r, CAST(t AS VARCHAR) AS t FROM steps", O.step_sql(_q), base=_q in BATCHES), f"kb_steps_{_q}")
    def kb_steps(spark, sf, q=_q):
        edges = knowledge(spark, sf)
        return K.evidence(knowledge_plan(spark, sf, q), edges, relation_ids(edges), q)[1]


@query(O.query("2i", plan_sql("2i"), _SINGLE.format(q=O.question("2i")), _TEXTS))
def kb_prompts(spark, sf):
    """Directed queries to one-shot prompts: evidence from the knowledge base, bare ids and relation numbers in the text."""
    edges = knowledge(spark, sf)
    ids, p = relation_ids(edges), knowledge_plan(spark, sf, "2i")
    triples = K.evidence(p, edges, ids, "2i")[0].select("qid", F.col("h").cast("long").alias("h"), "r", F.col("t").cast("long").alias("t"))
    return P.single_prompts(K.mapped_plan(p, ids, ["e1", "e2"], ["r1", "r2"]), E.query_texts(p, triples), "2i")


_STEP = "struct<function:string,dependencies:array<int>,inputs:array<string>>"


def _step(f: str, needs: list[int], *inputs) -> F.Column:
    return F.struct(F.lit(f).alias("function"), F.array(*map(F.lit, needs)).cast("array<int>").alias("dependencies"), F.array(*inputs).cast("array<string>").alias("inputs")).cast(_STEP)


def _hop(need: int, r: int) -> F.Column:
    predicate, way = _key(r).split("::")
    return _step("Relate", [need], F.lit(predicate), F.lit(way))


def _names(spark, sf) -> DataFrame:
    of = lambda t, base, key, name: table(spark, sf, t).select(F.concat(F.lit("Q"), (F.lit(base) + F.col(key)).cast("string")).alias("id"), F.col(name).alias("name"))
    return of("nation", 100, "n_nationkey", "n_name").union(of("region", 0, "r_regionkey", "r_name")).union(of("customer", 20_000_000, "c_custkey", "c_name"))


@query("WITH " + O.KG + """, hop AS (SELECT h, r, t FROM kg),
four AS (SELECT DISTINCT 2 * n_nationkey AS qid, d.t AS ent FROM nation JOIN hop a ON a.h = 100 + n_nationkey AND a.r = 8 JOIN hop b ON b.h = a.t AND b.r = 11 JOIN hop c ON c.h = b.t AND c.r = 6 JOIN hop d ON d.h = c.t AND d.r = 3),
far AS (SELECT DISTINCT n_nationkey AS k, c.t AS ent FROM nation JOIN hop a ON a.h = 100 + n_nationkey AND a.r = 8 JOIN hop b ON b.h = a.t AND b.r = 11 JOIN hop c ON c.h = b.t AND c.r = 6),
nested AS (SELECT DISTINCT 2 * n_nationkey + 1 AS qid, far.ent FROM nation JOIN far ON far.k = n_nationkey JOIN hop x ON x.t = far.ent AND x.r = 10 AND x.h IN (100 + n_nationkey, 100 + (n_nationkey + 1) % 25))
SELECT CAST(qid AS BIGINT) AS qid, 'Q' || ent AS ent FROM four UNION ALL SELECT CAST(qid AS BIGINT), 'Q' || ent FROM nested""")
def execute_programs(spark, sf):
    """For each nation a program of four hops, and an intersection of a union with a path of three hops."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    after = nations.select(F.pmod(F.col("k") - 1, F.lit(25)).alias("k"), F.col("name").alias("next"))
    rows = nations.join(after, "k")
    find = lambda c: _step("Find", [], F.col(c))
    four = F.array(find("name"), _hop(0, 8), _hop(1, 11), _hop(2, 6), _hop(3, 3), _step("What", [4]))
    nested = F.array(find("name"), _hop(0, 10), find("next"), _hop(2, 10), _step("Or", [1, 3]), _hop(0, 8), _hop(5, 11), _hop(6, 6), _step("And", [4, 7]))
    both = rows.select((2 * F.col("k")).alias("qid"), F.to_json(four).alias("program")).union(rows.select(2 * F.col("k") + 1, F.to_json(nested)))
    nodes = both.select("qid", G.analysed("program").alias("a")).select("qid", F.inline("a.nodes"))
    return G.executed(nodes, _names(spark, sf), knowledge(spark, sf))


_CASES = "CASE c_custkey % 8 {} END"


@query("SELECT CAST(c_custkey AS BIGINT) AS qid, " + _CASES.format("WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 6 THEN '2p' ELSE '1p'") + " AS qtype, " + _CASES.format("WHEN 0 THEN 'empty_program' WHEN 1 THEN 'not_target_topology' WHEN 2 THEN '1p:ambiguous_anchor' WHEN 3 THEN '1p:gold_not_string' WHEN 4 THEN '1p:gold_not_entity' WHEN 5 THEN '1p:reduced_query_not_equal_gold'") + " AS reason, " + _CASES.format("WHEN 6 THEN 'Q' || n_regionkey WHEN 7 THEN 'Q' || (100 + c_nationkey)") + " AS answers FROM customer JOIN nation ON n_nationkey = c_nationkey")
def candidate_filter(spark, sf):
    """A question for each customer, of eight forms, of which two can stand in a benchmark."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("c_custkey") % 8
    find, known = lambda name: _step("Find", [], name), F.col("c_name")
    one = F.array(find(known), _hop(0, 1), _step("What", [1]))
    program = F.when(kind == 0, F.lit("[]")).when(kind == 1, F.to_json(F.array(find(known), _hop(0, 1), _step("Count", [1])))).when(kind == 2, F.to_json(F.array(find(F.lit("nobody")), _hop(0, 1))))
    program = program.when(kind == 6, F.to_json(F.array(find(known), _hop(0, 1), _step("FilterConcept", [1], F.lit("x")), _hop(2, 2)))).otherwise(F.to_json(one))
    answer = F.when(kind == 3, F.lit(None)).when(kind == 4, "nowhere").when(kind == 5, F.col("r_name")).when(kind == 6, F.col("r_name")).otherwise(F.col("n_name"))
    questions = rows.select(F.col("c_custkey").cast("long").alias("qid"), program.alias("program"), answer.alias("answer"))
    found = G.candidates(questions, _names(spark, sf), knowledge(spark, sf))
    return found.select("qid", "qtype", "reason", F.array_join("answer_ids", ",").alias("answers"))


@query("SELECT o_orderkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0")
def answer_names(spark, sf):
    """Answers of one-hop queries with their names; ids without a name are left out."""
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("ent"))
    names = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return G.names_of(found, names).select("qid", "name")


_FUNCTIONS = {0: ["Find", "Relate", "What"], 1: ["Find", "Relate", "FilterConcept", "Relate"], 2: ["Find", "Relate", "Find", "Relate", "And"], 3: ["Find", "Relate", "Find", "Relate", "Or"], 4: ["Find", "Relate", "Find", "Relate", "Or", "Count"]}
_NEEDS = {0: [[], [0], [1]], 1: [[], [0], [1], [2]], 2: [[], [0], [], [2], [1, 3]], 3: [[], [0], [], [2], [1, 3]], 4: [[], [0], [], [2], [1, 3], [4]]}


def _programs(spark, sf) -> DataFrame:
    forms = F.array(*[F.array(*[_step(f, d) for f, d in zip(_FUNCTIONS[k], _NEEDS[k], strict=True)]) for k in range(5)])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("source_index"), F.get(forms, (F.col("p_partkey") % 5).cast("int")).alias("program"))


@query("WITH f AS (SELECT unnest(CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in _FUNCTIONS.items()) + " END) AS function FROM part) SELECT function, count(*) AS count FROM f GROUP BY 1")
def program_functions(spark, sf):
    return G.function_inventory(_programs(spark, sf))[0]


@query("SELECT CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{'>'.join(v)}'" for k, v in _FUNCTIONS.items()) + " END AS pattern, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1 ORDER BY n DESC, seen LIMIT 3")
def program_patterns(spark, sf):
    return G.function_inventory(_programs(spark, sf), 3)[1]


@query("SELECT CASE WHEN p_partkey % 5 = 3 THEN 'END' ELSE 'Count' END AS successor, count(*) AS count FROM part WHERE p_partkey % 5 IN (3, 4) GROUP BY 1")
def or_successors(spark, sf):
    """What follows a union in programs, or the program's end."""
    return G.function_inventory(_programs(spark, sf))[2]


#: Malformed parses and the first fault of each.
_BRANCH = '{"anchor":"a","path":[{"relation":"r","direction":"forward"}]}'
_FAULTS = [
    ("{", "invalid_json"), ("[]", "top_level_not_object"), ('{"type":"1p"}', "invalid_top_level_fields"), ('{"type":"9p","query":[]}', "invalid_qtype"), ('{"type":"1p","query":{}}', "query_not_list"),
    ('{"type":"1p","query":[]}', "invalid_branch_count"), ('{"type":"1p","query":[1]}', "branch_not_object"), ('{"type":"1p","query":[{"anchor":"a"}]}', "invalid_branch_fields"),
    ('{"type":"1p","query":[{"anchor":" ","path":[]}]}', "invalid_anchor"), ('{"type":"1p","query":[{"anchor":"a","path":1}]}', "path_not_list"), ('{"type":"1p","query":[{"anchor":"a","path":[]}]}', "invalid_path_length"),
    ('{"type":"1p","query":[{"anchor":"a","path":[1]}]}', "path_step_not_object"), ('{"type":"1p","query":[{"anchor":"a","path":[{"relation":"r"}]}]}', "invalid_path_step_fields"),
    ('{"type":"1p","query":[{"anchor":"a","path":[{"relation":"","direction":"forward"}]}]}', "invalid_relation"), ('{"type":"1p","query":[{"anchor":"a","path":[{"relation":"r","direction":"up"}]}]}', "invalid_direction"),
    ("{\"type\":\"1p\",\"query\":[" + _BRANCH + "]}", None),
]


@query("SELECT p_partkey AS qid, [" + ", ".join("NULL" if r is None else f"'{r}'" for _, r in _FAULTS) + f"][p_partkey % {len(_FAULTS)} + 1] AS error, CASE WHEN p_partkey % {len(_FAULTS)} = {len(_FAULTS) - 1} THEN '1p:a' END AS parse FROM part")
def parse_faults(spark, sf):
    """Parser outputs with each fault, and the first fault of each."""
    text = F.get(F.array(*[F.lit(t) for t, _ in _FAULTS]), (F.col("p_partkey") % len(_FAULTS)).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), G.parsed_output(text).alias("p"))
    return rows.select("qid", "p.error", F.concat("p.type", F.lit(":"), F.get("p.query", 0)["anchor"]).alias("parse"))


@query("SELECT p_partkey AS qid, lower(trim(regexp_replace(p_name, ' +', ' ', 'g'))) || ' strasse' AS key FROM part")
def name_keys(spark, sf):
    """Names in compatibility form, case folded, with single spaces."""
    written_ = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit("   "))), F.lit(" Ｓtraße "))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), G.name_key(written_).alias("key"))


# --- stage bounds and staged retrieval ---

_ANSWERS = "SELECT qid, ent FROM answers"

for _q in ("2p", "2i", "2u"):

    @query(O.query(_q, plan_sql(_q), _ANSWERS, base=_q in BATCHES), f"prompt_bound_{_q}")
    def prompt_bound(spark, sf, q=_q):
        """What follows from the text of one-shot prompts alone."""
        p = plan(spark, sf, q)
        triples, asked = T.read_back(P.single_prompts(p, E.query_texts(p, evidence(spark, sf, q)), q), q)
        return T.bound(triples, asked, q)


def _worker(prompts: list[str]) -> list[str]:
    """A model that reads tails from its triples, and intersects or unites the sets in its question."""
    out = []
    for p in prompts:
        facts, asked = p.split(P.QUESTION, 1)
        sets = [{int(x) for x in re.findall(r"\d+", s)} for s in re.findall(r"\{([^}]*)\}", asked)]
        if "both sets" in asked:
            found = set.intersection(*sets)
        elif "either sets" in asked:
            found = set.union(*sets)
        else:
            found = {int(t) for t in re.findall(r"\(\d+,\d+,(\d+)\)", facts)}
        out.append("Answer: " + ", ".join(map(str, sorted(found))) if found else "None")
    return out


for _q in ("2p", "2i", "2u"):

    @query(O.query(_q, plan_sql(_q), f"SELECT plan.qid, coalesce(string_agg(CAST(ent AS VARCHAR), ',' ORDER BY ent), 'None') AS last, 'ok' AS status, {len(T.OPERATIONS[_q])} AS steps FROM plan LEFT JOIN answers USING (qid) GROUP BY plan.qid", base=_q in BATCHES), f"dynamic_run_{_q}")
    def dynamic_run(spark, sf, q=_q):
        """A staged run that retrieves each step's evidence by the answers before it, with a model that reads well."""
        found, _ = run_dynamic(plan(spark, sf, q), q, order_graph(spark, sf, True), _worker)
        return found.select("qid", F.element_at("answers", -1).alias("last"), "status", F.size("answers").alias("steps"))

    @query(O.query(_q, plan_sql(_q), _ANSWERS, base=_q in BATCHES), f"retrieved_bound_{_q}")
    def retrieved_bound(spark, sf, q=_q):
        """What follows from the triples that a staged run has retrieved."""
        p = plan(spark, sf, q)
        return T.bound(run_dynamic(p, q, order_graph(spark, sf, True), _worker)[1], p, q)


@query(O.query("2p", plan_sql("2p"), "SELECT DISTINCT qid, h, r, t FROM plan JOIN kg ON kg.h = e1 OR kg.t = e1 OR kg.r = r1 OR kg.r = r2", base=False))
def candidate_retrieval(spark, sf):
    """Everything around the anchors and of the relations of the 2p batch."""
    return T.retrieved(plan(spark, sf, "2p"), order_graph(spark, sf), [1], [1, 2], [])


@query(O.query("2i", plan_sql("2i"), f"SELECT qid, place, CASE place WHEN 0 THEN 'system' ELSE 'user' END AS role, CASE place WHEN 0 THEN '{P.SYSTEMS['plain'].replace(chr(39), chr(39) * 2)}' ELSE prompt END AS content FROM ({_SINGLE.format(q=O.question('2i'))}), (VALUES (0), (1)) v(place)", _TEXTS))
def chat_turns(spark, sf):
    """One-shot prompts as conversations."""
    p = plan(spark, sf, "2i")
    prompts = P.single_prompts(p, E.query_texts(p, evidence(spark, sf, "2i")), "2i")
    return prompts.select("qid", F.posexplode(P.chat(P.system_prompt(F.lit("plain")), F.col("prompt"))).alias("place", "x")).select("qid", "place", "x.role", "x.content")


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'CoT' WHEN 1 THEN 'FewShot_CoT' ELSE 'abstract' END AS task, [" + ", ".join("'" + P.SYSTEMS[t].replace("'", "''") + "'" for t in ("CoT", "FewShot_CoT", "plain")) + "][c_custkey % 3 + 1] AS words FROM customer")
def system_prompts(spark, sf):
    task = F.get(F.array(F.lit("CoT"), F.lit("FewShot_CoT"), F.lit("abstract")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), task.alias("task")).select("k", "task", P.system_prompt(F.col("task")).alias("words"))


@query("SELECT c_custkey AS k, 'user' AS role, CASE WHEN c_custkey % 2 = 0 THEN 'say ' || c_name ELSE 'say ' || c_name || chr(10) || 'now' END AS content FROM customer UNION ALL SELECT c_custkey, 'assistant', c_mktsegment FROM customer")
def training_turns(spark, sf):
    c = table(spark, sf, "customer")
    said = P.training_chat(F.concat(F.lit("say "), "c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("now")), F.col("c_mktsegment"))
    return c.select(F.col("c_custkey").alias("k"), F.inline(said))


# --- extraction ---


@query("""SELECT c_custkey AS k, c_custkey || ',2' AS final, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN array_to_string(list_sort(list_distinct([c_custkey, 3])), ',') ELSE NULL END AS strict, 'a,b' AS lenient,
CASE c_custkey % 3 WHEN 2 THEN array_to_string(list_sort(list_distinct([7, c_custkey])), ',') ELSE '' END AS checked, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_custkey || ',z' END AS api, CAST(c_custkey AS VARCHAR) AS last, '1,' || c_custkey AS bare,
'p::q' AS predicate, 'forward' AS direction, CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE printf('%.4f', c_custkey / 8.0) END AS four FROM customer""")
def extractors(spark, sf):
    """Final answers, answer sets by four rules, fields of replies, relation keys and measures as text."""
    k, c = F.col("c_custkey").cast("string"), F.col("c_custkey")
    cat = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    strict = F.get(F.array(F.lit(""), F.lit("None"), cat(k, ", 3,", k), F.lit("x1")), (c % 4).cast("int"))
    checked = F.get(F.array(F.lit("NULL"), F.lit(None).cast("string"), cat("7,", k)), (c % 3).cast("int"))
    parts = X.relation_parts(F.lit("p::q::forward"))
    return table(spark, sf, "customer").select(
        c.alias("k"), X.final_answer(cat("Answer: {1} then Answer: {", k, ",2}")).alias("final"), F.array_join(X.strict_set(strict), ",").alias("strict"), F.array_join(X.lenient_set(F.lit("{b,None, a}")), ",").alias("lenient"), F.array_join(X.checked_set(checked), ",").alias("checked"),
        F.array_join(X.api_answer(F.when(c % 5 == 0, F.lit("no object")).otherwise(cat('reply {"answer": ["', k, '","z"]} end'))), ",").alias("api"), F.array_join(X.last_answer_list(cat('"answer": ["x"] and "answer": ["', k, '"]')), ",").alias("last"), X.bare(cat("{ 1, ", k, " }")).alias("bare"),
        parts["predicate"].alias("predicate"), parts["direction"].alias("direction"), X.four_places(F.when(c % 4 == 0, F.lit(float("nan"))).otherwise(c / F.lit(8.0))).alias("four"),
    )


@query("SELECT o_orderkey AS k, '[' || o_orderkey || ', [' || o_custkey || ', 7]]' AS literal, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' END AS other FROM orders")
def literal_values(spark, sf):
    """Literals of tuples as JSON; what is no literal is null."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("("), k, F.lit(", ("), c, F.lit(", 7,))"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), files.literal_json(text).alias("literal"), F.when(files.literal_json(F.when(F.col("o_orderkey") % 2 == 0, F.lit("{'a': (1,)}")).otherwise(F.lit("oops("))) == '{"a": [1]}', "yes").alias("other"))


@query(O.query("2i", plan_sql("2i"), f"SELECT qid, {O.question('2i')} AS was, " + O.filled(P.QUESTIONS["2i"]).replace("CAST(e1 AS VARCHAR)", "CAST(e1 + 1000 AS VARCHAR)").replace("CAST(e2 AS VARCHAR)", "CAST(e2 + 1000 AS VARCHAR)").replace("CAST(r1 AS VARCHAR)", "CAST(r1 + 14 AS VARCHAR)").replace("CAST(r2 AS VARCHAR)", "CAST(r2 + 14 AS VARCHAR)") + " AS question FROM plan"))
def remap_questions(spark, sf):
    """Questions in the new namespace."""
    q = P.questions(plan(spark, sf, "2i"), "2i")
    return q.select("qid", F.col("question").alias("was"), perturb.remapped_question(F.col("question"), 1000, 14).alias("question"))


@query(O.query("pi", plan_sql("pi"), "SELECT plan.qid, coalesce(string_agg(CAST(ent + 1000 AS VARCHAR), ',' ORDER BY ent), '') AS answer FROM plan LEFT JOIN answers USING (qid) GROUP BY plan.qid"))
def remap_answers(spark, sf):
    sets = answer_sets(plan(spark, sf, "pi"), lowered(spark, sf, "pi").answers())
    return sets.select("qid", F.array_join(perturb.remapped_answer(F.col("answer"), 1000), ",").alias("answer"))


# --- costs ---

_CALLS = "calls AS (SELECT model, method, qtype, sample, CASE WHEN sample % 11 = 0 THEN NULL ELSE sample % 97 + 10 * call END AS input_tokens, sample % 5 + 1 AS output_tokens, 0.25 AS seconds, sample % 8 AS batch FROM records, unnest(range(1, CASE method WHEN 'single' THEN 2 ELSE 4 END)) u(call))"
_COSTS = "costs AS (SELECT model, method, qtype, count(DISTINCT sample) AS num_queries, count(*) AS total_calls, coalesce(sum(input_tokens), 0) AS tin, sum(output_tokens) AS tout, CAST(sum(seconds) AS DOUBLE) AS secs, count(DISTINCT batch) AS num_batches FROM calls GROUP BY ALL)"


def _calls(spark, sf) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf)
    rows = r.select("model", "method", "qtype", "sample", F.explode(F.sequence(F.lit(1), F.when(F.col("method") == "single", 1).otherwise(3))).alias("call"))
    s = F.col("sample")
    return r, rows.select("model", "method", "qtype", "sample", F.when(s % 11 != 0, s % 97 + 10 * F.col("call")).alias("input_tokens"), (s % 5 + 1).alias("output_tokens"), F.lit(0.25).alias("seconds"), (s % 8).alias("batch"))


@query(_REC + ", " + _CALLS + ", " + _COSTS + " SELECT model, method, qtype, num_queries, total_calls, round(total_calls / num_queries, 6) AS calls_per_query, CAST(tin AS BIGINT) AS total_input_tokens, round(tin / num_queries, 6) AS input_tokens_per_query, round((tin + tout) / num_queries, 6) AS total_tokens_per_query, secs AS inference_seconds, round(num_queries / secs, 6) AS queries_per_second, num_batches FROM costs")
def efficiency_summary(spark, sf):
    c = costs.efficiency(_calls(spark, sf)[1])
    return c.select("model", "method", "qtype", "num_queries", "total_calls", _R6(F.col("calls_per_query"), "calls_per_query"), "total_input_tokens", _R6(F.col("input_tokens_per_query"), "input_tokens_per_query"), _R6(F.col("total_tokens_per_query"), "total_tokens_per_query"), "inference_seconds", _R6(F.col("queries_per_second"), "queries_per_second"), "num_batches")


@query(_REC + ", " + _CALLS + ", " + _COSTS + ", acc AS (SELECT model, method, qtype, avg(f1) AS f1, avg(exact_match) AS em FROM records GROUP BY ALL) SELECT model, method, qtype, round(f1, 6) AS f1, round(em, 6) AS em_rate, round(tin / num_queries, 6) AS input_tokens_per_query, CASE WHEN tin > 0 THEN CAST(round(1000 * f1 / (tin / num_queries), 4) AS VARCHAR) ELSE 'NaN' END AS ratio FROM acc JOIN costs USING (model, method, qtype)")
def accuracy_cost(spark, sf):
    """Accuracy beside cost, F1 for each thousand input tokens."""
    r, calls = _calls(spark, sf)
    a = costs.accuracy_cost(summaries.by_method(r), costs.efficiency(calls))
    ratio = F.col("f1_per_1k_input_tokens")
    return a.select("model", "method", "qtype", _R6(F.col("f1"), "f1"), _R6(F.col("em_rate"), "em_rate"), _R6(F.col("input_tokens_per_query"), "input_tokens_per_query"), F.when(F.isnan(ratio), "NaN").otherwise(X.rounded_text(ratio)).alias("ratio"))


@query(_REC + "SELECT model, method, qtype, sample, f1, CAST(parse_failed AS DOUBLE) AS parse_failed FROM records")
def score_records(spark, sf):
    """Scores as JSON records, read back with their required fields."""
    r = records(spark, sf)
    text = F.to_json(F.struct("exact_match", "precision", "recall", "f1", "parse_failed", F.lit(0).alias("status_failed")))
    read = R.scores(r.select("model", "method", "qtype", "sample", text.alias("text")))
    return read.select("model", "method", "qtype", "sample", "f1", "parse_failed")


@query(_REC + ", " + _CALLS + ", " + _COSTS + " SELECT model, method, qtype, num_queries, total_calls, num_batches FROM costs")
def efficiency_records(spark, sf):
    """Costs as JSON records, read back with their required fields and their place checked."""
    c = costs.efficiency(_calls(spark, sf)[1])
    read = R.efficiencies(c.select("model", "method", "qtype", F.to_json(F.struct(*c.columns)).alias("text")))
    return read.select("model", "method", "qtype", "num_queries", "total_calls", "num_batches")


@query("SELECT conv_id, CAST(sum(CASE WHEN turn % 3 = 0 THEN NULL ELSE length(text) END) AS BIGINT) AS chars, count(*) FILTER (turn % 3 = 0) AS skipped FROM conversations GROUP BY 1")
def token_totals(spark, sf):
    """Input sizes of each conversation; turns that were skipped have none."""
    rows = table(spark, sf, "conversations").select("conv_id", F.when(F.col("turn") % 3 != 0, F.length("text")).alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("chars"), F.count_if(F.col("n").isNull()).alias("skipped"))


# --- summaries ---

_STAGES = "sets AS (SELECT plan.qid, coalesce(list_sort(list(DISTINCT ent) FILTER (ent IS NOT NULL)), []) AS gold FROM plan LEFT JOIN answers USING (qid) GROUP BY plan.qid), preds AS (SELECT qid, k, gold, CASE WHEN (qid + k) % 9 = 0 THEN NULL ELSE list_sort(list_distinct(list_concat([x FOR x IN gold IF (x + k) % 5 <> 0], [x + 1 FOR x IN gold IF (x + k) % 7 = 0]))) END AS pred FROM sets, (VALUES (1), (2), (3)) ks(k))"
_STAGE_ROWS = _metric_sql("staged").replace("SELECT qid,", "SELECT qid, k, pred, gold,", 1)


@query(O.query("2i", plan_sql("2i"), f"""SELECT k AS stage, CASE k WHEN 3 THEN 'set_operation' ELSE 'projection' END AS role, count(*) AS n, round(avg(f1), 6) AS f1, round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(exact_match), 6) AS em_rate, round(avg(CASE WHEN pred IS NOT NULL AND list_has_all(pred, gold) THEN 1 ELSE 0 END), 6) AS containment_rate, round(avg(CASE WHEN pred IS NULL THEN 0 ELSE 1 END), 6) AS parse_ok_rate, round(avg(len(pred)), 6) AS pred_size, round(avg(len(gold)), 6) AS gold_size FROM ({_STAGE_ROWS}) GROUP BY 1, 2""", _STAGES))
def stage_metrics(spark, sf):
    """Means of each stage of a decomposed query over stage rows."""
    rows = None
    for k in (1, 2, 3):
        p, g = F.col("pred"), F.col("gold")
        part = predictions(spark, sf, "2i", k).select(
            F.lit("new").alias("run"), F.lit("decomposed").alias("method"), F.lit("2i").alias("qtype"), F.lit(k).alias("stage"), F.lit("set_operation" if k == 3 else "projection").alias("role"), *[c.alias(n) for n, c in M.metrics(p, g, "staged").items()],
            M.contains_gold(p, g).alias("contained"), p.isNotNull().cast("int").alias("parse_ok"), F.when(p.isNotNull(), F.size(p)).alias("pred_size"), F.size(g).alias("gold_size"),
        )
        rows = part if rows is None else rows.union(part)
    s = summaries.stage_metrics(rows)
    return s.select("stage", "role", "n", *[_R6(F.col(c), c) for c in ("f1", "precision", "recall", "em_rate", "containment_rate", "parse_ok_rate", "pred_size", "gold_size")])


@query(O.query("2i", plan_sql("2i"), "SELECT qid, CASE WHEN list_contains([x IS NULL FOR x IN preds3], true) THEN NULL ELSE array_to_string(list_sort([x FOR x IN preds3[1] IF list_contains(preds3[2], x) AND list_contains(preds3[3], x)]), ',') END AS both FROM (SELECT qid, list(pred ORDER BY k) AS preds3 FROM preds GROUP BY qid)", _STAGES))
def symbolic_diagnostic(spark, sf):
    """The intersection of the branches' predictions; null where one is null."""
    a, b, c = (predictions(spark, sf, "2i", k).select("qid", F.col("pred").alias(f"p{k}")) for k in (1, 2, 3))
    both = a.join(b, "qid").join(c, "qid")
    return both.select("qid", F.array_join(M.symbolic_intersection([F.col("p1"), F.col("p2"), F.col("p3")]), ",").alias("both"))


@query(_REC + "SELECT model, qtype, sample, CASE WHEN b.f1 - a.f1 > 1e-12 THEN 'better' WHEN b.f1 - a.f1 < -1e-12 THEN 'worse' ELSE 'tie' END AS way FROM records a JOIN records b USING (model, qtype, sample) WHERE a.method = 'single' AND b.method = 'isolated'")
def sample_directions(spark, sf):
    d = summaries.differences(records(spark, sf), ["model", "qtype", "sample"], "single", "isolated", ["f1"])
    return d.select("model", "qtype", "sample", M.compared(F.col("delta_f1"), F.lit(0.0)).alias("way"))


@query(_REC + ", d AS (SELECT model, qtype, b.f1 - a.f1 AS d FROM records a JOIN records b USING (model, qtype, sample) WHERE a.method = 'single' AND b.method = 'isolated') SELECT CASE WHEN grouping(model) = 1 AND grouping(qtype) = 1 THEN 'overall' WHEN grouping(model) = 0 THEN 'model' ELSE 'qtype' END AS scope, model, qtype, count(*) AS n, count(*) FILTER (d > 1e-12) AS better, count(*) FILTER (d < -1e-12) AS worse, count(*) FILTER (abs(d) <= 1e-12) AS equal, round(avg(CAST(d > 1e-12 AS INTEGER)), 6) AS better_rate, round(avg(CAST(d < -1e-12 AS INTEGER)), 6) AS worse_rate FROM d GROUP BY GROUPING SETS ((), (model), (qtype))")
def direction_summary(spark, sf):
    d = summaries.differences(records(spark, sf), ["model", "qtype", "sample"], "single", "isolated", ["f1"])
    s = summaries.directions(d, "delta_f1", [[], ["model"], ["qtype"]])
    return s.select("scope", "model", "qtype", "n", "better", "worse", "equal", _R6(F.col("better_rate"), "better_rate"), _R6(F.col("worse_rate"), "worse_rate"))


@query(_REC + ", s AS (SELECT DISTINCT model, method, qtype FROM records) SELECT model, method, qtype, row_number() OVER (ORDER BY model DESC, CASE method WHEN 'isolated' THEN 1 WHEN 'single' THEN 2 ELSE 3 END, CASE qtype WHEN '2u' THEN 1 WHEN '1p' THEN 2 ELSE 3 END, qtype) AS place FROM s")
def report_order(spark, sf):
    """The rows of a report in an order of its own."""
    cells = records(spark, sf).select("model", "method", "qtype").distinct()
    w = Window.orderBy(*summaries.places({"model": ["beta", "alpha"], "method": ["isolated", "single"], "qtype": ["2u", "1p"]}))  # 30 rows
    return cells.select("model", "method", "qtype", F.row_number().over(w).alias("place"))


@query(_pairs_sql(_PLAN_CONTRASTS, _PLAN_MODELS, _PLAN_METHODS) + f" SELECT count(DISTINCT (model, qtype, contrast)) AS found, {_PLANNED} AS planned FROM pairs")
def planned_tests(spark, sf):
    """The number of tests that the records give, which must be that of the plan."""
    return stats.planned(planned_pairs(spark, sf).select("model", "qtype", "contrast").distinct(), _PLANNED)


@query(_REC + ", pairs AS (SELECT a.model, a.qtype, a.method || ' -> ' || b.method AS contrast, b.f1 - a.f1 AS d FROM records a JOIN records b USING (model, qtype, sample) WHERE (a.method, b.method) IN (('single', 'decomposed'), ('decomposed', 'isolated'), ('single', 'isolated'))) SELECT model, qtype, contrast, count(*) AS n, round(avg(d), 6) AS delta, count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses, CASE WHEN coalesce(stddev_samp(d), 0) <= 1e-12 THEN 'none' ELSE CAST(round(avg(d) / stddev_samp(d), 4) AS VARCHAR) END AS dz FROM pairs GROUP BY ALL")
def paired_sums(spark, sf):
    """The part of the paired tests that SQL can tell: means, effects, wins, ties and losses."""
    pairs = stats.paired(records(spark, sf), _CONTRASTS, ["model", "qtype"], "sample", "f1")
    t = stats.paired_tests(pairs, ["model", "qtype", "contrast"])
    even = (F.col("wins") == 0) & (F.col("losses") == 0) | F.isnan("dz") | (F.abs("dz") == float("inf"))
    return t.select("model", "qtype", "contrast", "n", _R6(F.col("delta"), "delta"), "wins", "ties", "losses", F.when(even, "none").otherwise(X.rounded_text(F.col("dz"))).alias("dz"))


# --- exposure ---


def _exposure_sql() -> str:
    part = lambda q, select: f"SELECT * FROM (WITH {', '.join([plan_sql(q), *O.lowered(q)[0]])} {select})"
    both = lambda select: " UNION ALL ".join(part(q, select.format(q=q)) for q in ("2i", "2u"))
    text = "CAST({} AS VARCHAR)"
    rows = lambda source, kind, key: f"SELECT qtype, qid, '{kind}' AS kind, {key} AS key FROM {source}"
    v = lambda c: text.format(c)
    ents, rels, gold = "(SELECT qtype, qid, h AS x FROM ev UNION SELECT qtype, qid, t FROM ev)", "(SELECT qtype, qid, r AS x FROM ev UNION SELECT qtype, qid, r FROM rel)", "(SELECT qtype, qid, ent AS x FROM ans)"
    test = [rows(ents, "query_entity", v("x")), rows(ents, "query_entity_any", v("x")), rows(gold, "gold", v("x")), rows(gold, "gold_any", v("x")), rows(rels, "relation", v("x")), rows("ev", "triple", "h || ',' || r || ',' || t"), rows("ev", "head_relation", "h || ',' || r"), rows("ev", "relation_tail", "r || ',' || t")]
    numbers = f"(SELECT * FROM {ents} UNION SELECT * FROM {rels} UNION SELECT * FROM {gold})"
    train = [test[0], rows(numbers, "query_entity_any", v("x")), test[2], rows(numbers, "gold_any", v("x")), *test[4:]]
    kinds = exposures.KINDS
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}, count(*) FILTER (kind = '{k}' AND s.key IS NOT NULL) AS s_{k}" for k in kinds)
    zero = ", ".join(f"coalesce({x}_{k}, 0) AS {x}_{k}" for k in kinds for x in "ns")
    rate = lambda k: f"CASE WHEN n_{k} = 0 THEN 0.0 ELSE s_{k} / n_{k} END"
    any_, all_ = (lambda k: f"CAST(s_{k} > 0 AS INTEGER)"), (lambda k: f"CAST(n_{k} > 0 AND s_{k} = n_{k} AS INTEGER)")
    out = f"""n_query_entity AS query_entities, s_query_entity AS query_entities_seen, {rate('query_entity')} AS query_entity_rate, s_query_entity_any AS query_entities_seen_anywhere, n_gold AS golds, s_gold AS golds_seen, {rate('gold')} AS gold_rate, s_gold_any AS golds_seen_anywhere,
n_relation AS relations, s_relation AS relations_seen, {rate('relation')} AS relation_rate, n_triple AS triples, s_triple AS triples_seen, s_head_relation AS head_relations_seen, s_relation_tail AS relation_tails_seen, {any_('query_entity')} AS any_query_entity, {all_('query_entity')} AS all_query_entities, {any_('gold')} AS any_gold, {all_('gold')} AS all_golds,
{any_('relation')} AS any_relation, {all_('relation')} AS all_relations, {any_('triple')} AS any_triple, {any_('head_relation')} AS any_head_relation, {any_('relation_tail')} AS any_relation_tail"""
    return f"""WITH {O.KG}, {O.BASE}, ev AS ({both("SELECT '{q}' AS qtype, qid, h, r, t FROM evidence")}), ans AS ({both("SELECT '{q}' AS qtype, qid, ent FROM answers")}), rel AS ({both("SELECT '{q}' AS qtype, qid, r1 AS r FROM plan UNION SELECT '{q}', qid, r2 FROM plan")}),
tkeys AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(test)}) WHERE qid % 2 = 1), skeys AS (SELECT DISTINCT kind, key FROM ({' UNION ALL '.join(train)}) WHERE qid % 2 = 0),
sums AS (SELECT qtype, qid, {sums} FROM tkeys LEFT JOIN skeys s USING (kind, key) GROUP BY ALL),
full_ AS (SELECT qtype, qid, {zero} FROM (SELECT DISTINCT qtype, qid FROM rel WHERE qid % 2 = 1) LEFT JOIN sums USING (qtype, qid)),
rows_ AS (SELECT qtype, qid, {out} FROM full_) """


_EXPOSED = _exposure_sql()


def _sides(spark, sf) -> DataFrame:
    """Features of the queries of two batches, as record loaders give them."""
    sides = None
    for q in ("2i", "2u"):
        p = plan(spark, sf, q)
        full = lowered(spark, sf, q)
        triples = full.evidence().groupBy("qid").agg(F.collect_set(F.struct("h", "r", "t")).alias("triples"))
        sets = answer_sets(p, full.answers()).withColumnRenamed("answer", "gold")
        rows = p.select("qid", "r1", "r2").join(triples, "qid", "left").join(sets, "qid")
        found = F.coalesce("triples", F.array().cast("array<struct<h:bigint,r:int,t:bigint>>"))
        entities = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["h"], x["t"]))))
        relations = F.array_union(F.transform(found, lambda x: x["r"]), F.array("r1", "r2"))
        texts = lambda a: F.transform(a, lambda x: x.cast("string"))
        numbers = F.array_union(F.array_union(texts(entities), texts(relations)), texts(F.col("gold")))
        part = rows.select(F.lit(q).alias("qtype"), "qid", found.alias("triples"), entities.alias("entities"), relations.alias("relations"), "gold", F.col("gold").alias("answers"), numbers.alias("numbers"))
        sides = part if sides is None else sides.union(part)
    return sides


def _exposed(spark, sf) -> DataFrame:
    sides = _sides(spark, sf)
    return exposures.exposures(sides.where("qid % 2 = 1"), sides.where("qid % 2 = 0"), "qtype", "qid")


@query(_EXPOSED + "SELECT * FROM rows_")
def sample_exposure(spark, sf):
    """What the even queries of two batches show of the odd ones: all measures of each sample."""
    return _exposed(spark, sf)


@query(_EXPOSED + "SELECT CASE WHEN grouping(qtype) = 1 THEN 'overall' ELSE 'qtype' END AS scope, qtype, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in exposures.MEASURES) + " FROM rows_ GROUP BY GROUPING SETS ((), (qtype))")
def exposure_summary(spark, sf):
    s = exposures.exposure_summary(_exposed(spark, sf))
    return s.select("scope", "qtype", "n", *[_R6(F.col(m), m) for m in exposures.MEASURES])


_RECORD_TEXT = "'(' || c_custkey || ',3,' || (c_custkey + 1) || '),(4,' || c_custkey % 5 || ',6) Which entities are connected to entity ' || c_custkey || ' by relation 7?'"


@query("SELECT c_custkey AS k, array_to_string([x.x FOR x IN list_sort([{'n': length(y), 'v': y, 'x': y} FOR y IN list_distinct([CAST(c_custkey AS VARCHAR), CAST(c_custkey + 1 AS VARCHAR), '4', '6'])])], ',') AS entities, array_to_string(list_sort(list_distinct([3, c_custkey % 5, 7])), ',') AS relations, '7' AS signature, 'a,b' AS answers, 2 AS triples FROM customer")
def training_features(spark, sf):
    """Features of training records."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("("), k, F.lit(",3,"), (F.col("c_custkey") + 1).cast("string"), F.lit("),(4,"), (F.col("c_custkey") % 5).cast("string"), F.lit(",6) Which entities are connected to entity "), k, F.lit(" by relation 7?"))
    r = R.training_records(table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.alias("instruction"), F.lit("so Answer: {b, a}").alias("output")), "k")
    return r.select("k", F.array_join("entities", ",").alias("entities"), F.array_join("relations", ",").alias("relations"), "signature", F.array_join("answers", ",").alias("answers"), F.size("triples").alias("triples"))


# --- comparisons ---


@query(_REC + ", cells AS (SELECT model, method, qtype, avg(f1) AS f1, avg(exact_match) AS em FROM records GROUP BY ALL) SELECT method, qtype, round(a.f1, 6) AS source_f1, round(b.f1, 6) AS mapped_f1, round(b.f1 - a.f1, 6) AS delta_f1, round(b.em - a.em, 6) AS delta_em_rate FROM cells a JOIN cells b USING (method, qtype) WHERE a.model = 'alpha' AND b.model = 'beta'")
def remap_scores(spark, sf):
    """Scores before and after, cell by cell."""
    cells = summaries.by_method(records(spark, sf))
    c = C.side_by_side(cells.where("model = 'alpha'"), cells.where("model = 'beta'"), ["method", "qtype"], ["f1", "em_rate"])
    return c.select("method", "qtype", *[_R6(F.col(x), x) for x in ("source_f1", "mapped_f1", "delta_f1", "delta_em_rate")])


@query(_REC + "SELECT method, qtype, sample, round(b.f1 - a.f1, 6) AS delta_f1 FROM records a JOIN records b USING (method, qtype, sample) WHERE a.model = 'alpha' AND b.model = 'beta'")
def remap_sample_scores(spark, sf):
    r = records(spark, sf)
    c = C.side_by_side(r.where("model = 'alpha'"), r.where("model = 'beta'"), ["method", "qtype", "sample"], ["f1"])
    return c.select("method", "qtype", "sample", _R6(F.col("delta_f1"), "delta_f1"))


_GROUP_VALUES = ", ".join(f"('{g}', '{q}')" for g, qs in summaries.GROUPS.items() for q in qs)


@query(_REC + f""", cells AS (SELECT model, method, qtype, avg(f1) AS f1 FROM records GROUP BY ALL), g AS (SELECT method, grp AS "group", count(*) AS n_types, avg(a.f1) AS s, avg(b.f1) AS m FROM cells a JOIN cells b USING (method, qtype) JOIN (VALUES {_GROUP_VALUES}) t(grp, qt) ON qt = qtype WHERE a.model = 'alpha' AND b.model = 'beta' GROUP BY 1, 2) SELECT method, "group", n_types, round(s, 6) AS source_f1, round(m, 6) AS mapped_f1, CASE WHEN s > 0 THEN CAST(round(m / s, 4) AS VARCHAR) ELSE 'NaN' END AS ratio FROM g""")
def remap_retention(spark, sf):
    """What is kept of a score after a change of ids, over groups of topologies."""
    cells = summaries.by_method(records(spark, sf))
    c = C.side_by_side(cells.where("model = 'alpha'"), cells.where("model = 'beta'"), ["method", "qtype"], ["f1"])
    groups = spark.createDataFrame([(g, q) for g, qs in summaries.GROUPS.items() for q in qs], "group string, qtype string")
    k = C.retained(c, groups, ["method"], "f1")
    return k.select("method", "group", "n_types", _R6(F.col("source_f1"), "source_f1"), _R6(F.col("mapped_f1"), "mapped_f1"), F.when(F.isnan("ratio"), "NaN").otherwise(X.rounded_text(F.col("ratio"))).alias("ratio"))


@query(O.query("up", plan_sql("up"), "SELECT qid, CASE WHEN qid % 11 = 0 THEN 'missing' ELSE 'different' END AS problem FROM plan WHERE qid % 11 = 0 OR qid % 7 = 0"))
def gold_alignment(spark, sf):
    """New gold against old: each eleventh is missing and each seventh has one entity more."""
    sets = answer_sets(plan(spark, sf, "up"), lowered(spark, sf, "up").answers()).withColumnRenamed("answer", "gold")
    moved = F.transform("gold", lambda t: t + 1000)
    new = sets.where("qid % 11 <> 0").select("qid", F.when(F.col("qid") % 7 == 0, F.concat(moved, F.array(F.lit(1).cast("bigint")))).otherwise(moved).alias("gold"))
    return C.gold_alignment(sets, new, ["qid"], 1000)


@query(O.query("2i", plan_sql("2i"), "SELECT plan.qid, CASE WHEN plan.qid % 7 = 0 THEN 'missing' ELSE 'count' END AS problem FROM plan LEFT JOIN (SELECT qid, count(*) AS n FROM evidence GROUP BY qid) e USING (qid) WHERE plan.qid % 7 = 0 OR (plan.qid % 5 = 0 AND coalesce(n, 0) > 0)"))
def prompt_alignment(spark, sf):
    """Prompts against those with other ids, of which each seventh is missing and each fifth lacks a triple."""
    p = plan(spark, sf, "2i")
    prompts = P.single_prompts(p, E.query_texts(p, evidence(spark, sf, "2i")), "2i").select("qid", X.triples(X.before(F.col("prompt"), P.QUESTION)).alias("triples"))
    other = prompts.where("qid % 7 <> 0").select("qid", F.when(F.col("qid") % 5 == 0, F.slice("triples", 2, 1_000_000)).otherwise(F.col("triples")).alias("triples"))
    return C.prompt_alignment(prompts, other, ["qid"])


@query("WITH " + O.KG + ", e AS (SELECT h AS x FROM kg UNION SELECT t FROM kg), m AS (SELECT 2 * max(x) + 1 AS o FROM e), k AS (SELECT x + o AS x FROM e, m) SELECT 'moved' AS which, (SELECT count(*) FROM (SELECT x FROM e INTERSECT SELECT x FROM k)) AS shared, (SELECT max(x) FROM e) AS most_a, (SELECT min(x) FROM k) AS least_b UNION ALL SELECT 'customers', (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)), (SELECT max(c_custkey) FROM customer), (SELECT min(o_custkey) FROM orders)")
def namespaces(spark, sf):
    """Ids that two namespaces share: none after a move, some between customers and orders."""
    kg = order_graph(spark, sf)
    entity, _ = perturb.offsets(kg)
    ids = kg.select(F.col("h").alias("x")).union(kg.select("t")).distinct()
    row = lambda which, a, b: C.shared(a, b, "x").select(F.lit(which).alias("which"), "shared", F.col("most_a").cast("long").alias("most_a"), F.col("least_b").cast("long").alias("least_b"))
    return row("moved", ids, ids.select((F.col("x") + entity).alias("x"))).union(row("customers", table(spark, sf, "customer").select(F.col("c_custkey").alias("x")), table(spark, sf, "orders").select(F.col("o_custkey").alias("x"))))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 1.0 END AS exact FROM part")
def zipped_scores(spark, sf):
    """Gold and parses brought together by key, with their source checked, then scored."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("source"), F.col("p_partkey"))
    text = lambda relation: G.formatted(F.lit("1p"), F.array(F.struct(F.col("source").alias("anchor"), F.array(F.struct(relation.alias("relation"), F.lit("forward").alias("direction"))).alias("path"))))
    gold = part.select("k", "source", text(F.lit("made by")).alias("gold"))
    pred = part.select("k", "source", text(F.when(F.col("k") % 4 == 0, F.lit("sold by")).otherwise(F.lit("Made  by"))).alias("pred"))
    both = C.zipped(gold, pred, ["k"], "source")
    return both.select("k", G.parse_score("gold", "pred").alias("s")).select("k", F.col("s.exact_correct").alias("exact"))


@query("SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS answer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def gold_lookup(spark, sf):
    """Gold by id, null without one; gold of another source would fail."""
    samples = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("sample"), F.lit(1).alias("source"))
    gold = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("sample"), F.lit(1).alias("source"), F.col("c_name").alias("answer"))
    return C.gold_of(samples, gold, "sample", "source", "answer").select("k", "answer")


# --- sampling and stores ---


@query("SELECT c_mktsegment AS segment, c_custkey AS k, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256((926 + CAST(list_sum([ascii(x) FOR x IN string_split(c_mktsegment, '')]) AS INTEGER)) || '|' || c_custkey), c_custkey) AS n FROM customer) WHERE n <= 4")
def sample_per_group_seeded(spark, sf):
    """Samples of each segment under a seed of its own."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    return sampling.per_group_seeded(c, "segment", 4, 926, ["k"])


@query("WITH " + O.KG + " SELECT r, count(*) AS n, min(h) AS first, max(t) AS last FROM kg GROUP BY r")
def stored_graph(spark, sf):
    """The graph written by relation and read back."""
    import uuid

    from .sources.graph import write_triples

    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    write_triples(order_graph(spark, sf), path)
    return spark.read.schema("h bigint, t bigint, r int").parquet(path).groupBy("r").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.max("t").alias("last"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, '[1,2]' AS ids FROM customer GROUP BY 1")
def summary_files(spark, sf):
    """A summary written as CSV, arrays as JSON text, and read back."""
    import uuid

    path = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    s = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n")).withColumn("ids", F.array(F.lit(1), F.lit(2)))
    files.write_csv(s, path, ["segment", "n", "ids"])
    return spark.read.option("header", True).schema("segment string, n bigint, ids string").csv(path)


@query(_REC + "SELECT method, qtype, model, sample, round(f1, 6) AS f1 FROM records")
def sample_files(spark, sf):
    """Records written as JSON in folders by method and topology, and read back."""
    import uuid

    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    files.write_samples(records(spark, sf).select("method", "qtype", "model", "sample", _R6(F.col("f1"), "f1")), path)
    return spark.read.schema("model string, sample bigint, f1 double, method string, qtype string").json(path).select("method", "qtype", "model", "sample", "f1")


@query("SELECT conv_id, min(CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'failed' END) AS confidence, count(*) AS turns FROM conversations GROUP BY 1")
def reply_confidence(spark, sf):
    """How surely the replies of each conversation could be read."""
    reply = F.when(F.col("turn") % 2 == 0, F.lit("7, 8")).otherwise(F.lit("because of entities"))
    rows = table(spark, sf, "conversations").select("conv_id", parsed_answer(reply)["confidence"].alias("confidence"))
    return rows.groupBy("conv_id").agg(F.min("confidence").alias("confidence"), F.count("*").alias("turns"))


# --- overlaps by topology, incomplete records, audits of remapped prompts, two grains ---


def _overlap_rows() -> str:
    v = lambda c: f"CAST({c} AS VARCHAR)"
    ents, rels = "(SELECT qtype, qid, h AS x FROM ev UNION SELECT qtype, qid, t FROM ev)", "(SELECT qtype, qid, r AS x FROM ev UNION SELECT qtype, qid, r FROM rel)"
    numbers = f"(SELECT * FROM {ents} UNION SELECT * FROM {rels} UNION SELECT qtype, qid, ent FROM ans)"
    out = "(SELECT qtype, qid, h, r, t FROM ev UNION SELECT qtype, qid, h + 1, r, t FROM ev WHERE qid % 2 = 0 AND h % 2 = 0)"
    rows = [("prompt_entity", ents, v("x")), ("target_answer_entity", "ans", v("ent")), ("relation", rels, v("x")), ("all_numeric_upper_bound", numbers, v("x")), ("exact_triple_train_input_only", "ev", "h || ',' || r || ',' || t")]
    rows += [("exact_triple_full_train_exposure", out, "h || ',' || r || ',' || t"), ("head_relation_pair", out, "h || ',' || r"), ("relation_tail_pair", out, "r || ',' || t"), ("head_tail_pair", out, "h || ',' || t")]
    keys = " UNION ".join(f"SELECT qid % 2 AS side, qtype, '{m}' AS measure, {k} AS key FROM {source}" for m, source, k in rows)
    counts = "count(*) FILTER (a) AS train_unique, count(*) FILTER (b) AS test_unique, count(*) FILTER (a AND b) AS overlap"
    found = lambda scope, qtype, where: f"SELECT '{scope}' AS scope, {qtype} AS qtype, measure, {counts} FROM (SELECT measure, key, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM keys WHERE {where} GROUP BY ALL) GROUP BY measure"
    every = " UNION ALL ".join([found("overall", "CAST(NULL AS VARCHAR)", "TRUE")] + [found("qtype", f"'{t}'", f"qtype = '{t}'") for t in overlaps.TYPES])
    names = " UNION ALL ".join([f"SELECT 'overall' AS scope, CAST(NULL AS VARCHAR) AS qtype, '{m}' AS measure" for m in overlaps.MEASURES] + [f"SELECT 'qtype', '{t}', '{m}'" for t in overlaps.TYPES for m in overlaps.BY_TYPE])
    rate = lambda n: f"coalesce(overlap / nullif({n}, 0), 0.0)"
    return (
        f", keys AS ({keys}), found AS ({every}), names AS ({names}), filled AS (SELECT names.*, coalesce(train_unique, 0) AS train_unique, coalesce(test_unique, 0) AS test_unique, coalesce(overlap, 0) AS overlap FROM names LEFT JOIN found ON found.scope = names.scope AND found.measure = names.measure AND found.qtype IS NOT DISTINCT FROM names.qtype) "
        + f"SELECT *, {rate('test_unique')} AS test_overlap_rate, {rate('train_unique')} AS train_overlap_rate, {rate('train_unique + test_unique - overlap')} AS jaccard FROM filled"
    )


@query(_EXPOSED.rstrip() + _overlap_rows())
def overlap_by_type(spark, sf):
    """The even queries of two batches against the odd ones: nine measures in all, five for each topology."""
    sides = _sides(spark, sf)
    more = F.transform(F.filter("triples", lambda x: x["h"] % 2 == 0), lambda x: F.struct((x["h"] + 1).alias("h"), x["r"].alias("r"), x["t"].alias("t")))
    return overlaps.overlap_table(sides.where("qid % 2 = 0").withColumn("output_triples", more), sides.where("qid % 2 = 1"))


@query("SELECT c_custkey AS k, side || '_' || what AS anomaly FROM customer, (VALUES ('train', 'no_triple', 1), ('train', 'no_triple', 2), ('train', 'no_relation', 2), ('train', 'no_final_answer', 3), ('test', 'no_triple', 1), ('test', 'no_triple', 2), ('test', 'no_relation', 2), ('test', 'no_gold', 3)) v(side, what, kind) WHERE c_custkey % 4 = kind")
def incomplete_records(spark, sf):
    """Records through both loaders, of which three quarters lack something."""
    k, kind = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    triples = F.when(kind.isin(1, 2), "").otherwise(F.concat(F.lit("("), k, F.lit(",3,9) ")))
    text = F.concat(triples, F.lit("Which entities are connected to entity "), k, F.when(kind == 2, "?").otherwise(" by relation 7?"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.alias("instruction"), text.alias("query"), F.when(kind == 3, "nothing is said").otherwise("Answer: {b, a}").alias("output"), F.when(kind == 3, "").otherwise("b, a").alias("answer"))
    return overlaps.incomplete_records(R.training_records(rows, "k"), R.test_records(rows, "k"), "k")


@query(O.query("pi", plan_sql("pi"), """SELECT plan.qid, CASE plan.qid % 7 WHEN 1 THEN 'stage_count' WHEN 2 THEN CASE WHEN e.n > 0 THEN 'triples' ELSE '' END WHEN 3 THEN 'question_ids' WHEN 4 THEN CASE WHEN a.n > 0 THEN 'answer' ELSE '' END WHEN 5 THEN 'missing' ELSE '' END AS problems
FROM plan LEFT JOIN (SELECT qid, count(*) AS n FROM steps WHERE step = 1 GROUP BY qid) e USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM answers GROUP BY qid) a USING (qid)""", O.step_sql("pi")))
def remap_prompt_audit(spark, sf):
    """Prompts of a batch in another namespace, of which every seventh lacks a stage, has a stage's old triples, an old question, an old answer, or isn't there."""
    entity, relation = 10**9, 100
    p = plan(spark, sf, "pi")
    full = lowered(spark, sf, "pi", True)
    texts = E.step_texts(p, full.evidence(), "pi").join(P.step_questions(p, "pi"), ["qid", "step"])
    stages = texts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("step", "triples", "question"))).alias("s"))
    rows = stages.join(answer_sets(p, full.answers()), "qid")
    read = lambda s, t, q: F.struct(X.triples(t(s)).alias("triples"), q(s).alias("question"))
    old = rows.select("qid", F.transform("s", lambda s: read(s, lambda x: x["triples"], lambda x: x["question"])).alias("stages"), "answer")
    kind = F.col("qid") % 7
    triples = lambda s: F.when((kind == 2) & (s["step"] == 1), s["triples"]).otherwise(perturb.remapped_text(s["triples"], entity, relation))
    question = lambda s: F.when((kind == 3) & (s["step"] == 1), s["question"]).otherwise(perturb.remapped_question(s["question"], entity, relation))
    moved = F.transform("s", lambda s: read(s, triples, question))
    new = rows.where(kind != 5).select("qid", F.when(kind == 1, F.slice(moved, 1, 3)).otherwise(moved).alias("stages"), F.when(kind == 4, F.col("answer")).otherwise(perturb.remapped_answer(F.col("answer"), entity)).alias("answer"))
    return C.remapped_faults(old, new, ["qid"], entity, relation).select("qid", F.array_join("problems", ",").alias("problems"))


_GROUPED = ", ".join(f"('{g}', '{q}')" for g, qs in summaries.GROUPS.items() for q in qs)
_MEMBER = f"(SELECT 'qtype' AS level, q AS name, q AS qtype FROM (VALUES {', '.join(f'({chr(39)}{q}{chr(39)})' for q in _TYPES)}) t(q) UNION ALL SELECT 'group', g, q FROM (VALUES {_GROUPED}) t(g, q))"


@query(_REC + f""", m AS {_MEMBER}, s AS (SELECT model, qtype, sample, count(*) AS n, sum(f1) AS f1, min(exact_match) AS lo, min(CAST(recall = 1 AS INTEGER)) AS rc, max(CASE WHEN method = 'isolated' THEN exact_match ELSE 0 END) AS fin FROM records GROUP BY ALL)
SELECT model, level, name, CAST(sum(n) AS BIGINT) AS stages, round(sum(f1) / sum(n), 6) AS f1, count(*) AS samples, round(avg(lo), 6) AS all_exact_rate, round(avg(rc), 6) AS all_contained_rate, count(*) FILTER (rc = 1 AND lo = 0) AS recoverable,
 coalesce(CAST(round(avg(fin) FILTER (rc = 1 AND lo = 0), 4) AS VARCHAR), 'NaN') AS recovery_rate, coalesce(CAST(round(avg(fin) FILTER (rc = 1), 4) AS VARCHAR), 'NaN') AS final_given_contained FROM s JOIN m USING (qtype) GROUP BY model, level, name""")
def mechanism_summary(spark, sf):
    """Means over stages beside conditional rates over samples, by topology and by group of topologies."""
    r = records(spark, sf).select("model", "qtype", "sample", F.col("method").alias("stage"), F.col("exact_match").alias("exact"), (F.col("recall") == 1).cast("int").alias("contained"), F.when(F.col("method") == "isolated", F.col("exact_match")).otherwise(0).alias("final_exact"), "f1")
    m = summaries.mechanism(r, ["model"], ["f1"])
    text = lambda c: F.when(F.isnan(c), "NaN").otherwise(X.rounded_text(F.col(c))).alias(c)
    return m.select("model", "level", "name", "stages", _R6(F.col("f1"), "f1"), "samples", _R6(F.col("all_exact_rate"), "all_exact_rate"), _R6(F.col("all_contained_rate"), "all_contained_rate"), "recoverable", text("recovery_rate"), text("final_given_contained"))


@query(_REC + f""", m AS {_MEMBER}, p AS (SELECT a.model, a.qtype, a.sample, a.f1 AS left_f1, b.f1 AS right_f1 FROM records a JOIN records b USING (model, qtype, sample) WHERE a.method = 'decomposed' AND b.method = 'isolated')
SELECT model, level, name, count(*) AS n, round(avg(left_f1), 6) AS left_f1, round(avg(right_f1), 6) AS right_f1, round(avg(right_f1) - avg(left_f1), 6) AS delta_f1, count(*) FILTER (right_f1 - left_f1 > 1e-12) AS better, count(*) FILTER (right_f1 - left_f1 < -1e-12) AS worse, count(*) FILTER (abs(right_f1 - left_f1) <= 1e-12) AS equal FROM p JOIN m USING (qtype) GROUP BY model, level, name""")
def method_comparison(spark, sf):
    """Two methods on the same samples, by topology and by group of topologies."""
    c = summaries.compared(records(spark, sf), ["model"], "decomposed", "isolated", ["f1"])
    return c.select("model", "level", "name", "n", *[_R6(F.col(x), x) for x in ("left_f1", "right_f1", "delta_f1")], "better", "worse", "equal")


# --- parses to prompts ---


def _parse_prompts_sql() -> str:
    plans = {
        "1p": (3, O.plan(["20000000 + qid"], [1], "who")), "2p": (4, O.plan(["20000000 + qid"], [1, 2], "who")), "2i": (5, O.plan(["20000000 + qid", "region"], [1, 9], "who")),
    }
    parts = []
    for q, (kind, sql) in plans.items():
        who = f"who AS (SELECT CAST(c_custkey AS BIGINT) AS qid, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 6 = {kind})"
        made = lambda select, *more: O.query(q, f"{who}, {sql}", select, *more, base=False)  # noqa: B023, E731
        steps = O.step_questions(q)
        for name, text in (
            ("single", made(_SINGLE.format(q=O.question(q)).replace("SELECT qid,", "SELECT qid, 0 AS step,", 1), _TEXTS)), ("decomposed", made(f"{_STEP_SELECT} FROM texts JOIN ({steps}) USING (qid)", _TEXTS)),
            ("isolated", made(f"{_STEP_SELECT} FROM ({O.STEP_TEXTS}) JOIN ({steps}) USING (qid, step)", O.step_sql(q))),
        ):
            parts.append(f"SELECT qid, '{q}' AS qtype, '{name}' AS kind, CAST(step AS INTEGER) AS step, prompt, CAST(NULL AS VARCHAR) AS failure FROM ({text})")
    parts.append("SELECT c_custkey, NULL, NULL, NULL, NULL, ['invalid_json', 'entity_not_found', 'relation_not_found'][c_custkey % 6 + 1] FROM customer WHERE c_custkey % 6 < 3")
    return " UNION ALL ".join(parts)


_STEP_SELECT = "SELECT qid, step, '" + P.STEP_PREMISE + "' || triples || '\n\n" + P.QUESTION + "' || question || '" + P.INSTRUCTION + "' AS prompt"


@query(_parse_prompts_sql())
def parse_prompts(spark, sf):
    """A parser's output for each customer to prompts: half of them fail, at reading, at an anchor or at a relation."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.col("c_custkey") % 6
    hop = lambda name, way="forward": F.struct(F.lit(name).alias("relation"), F.lit(way).alias("direction"))
    branch = lambda anchor, *hops: F.struct(anchor.alias("anchor"), F.array(*hops).alias("path"))
    who = F.upper("c_name")
    said = F.when(kind == 0, F.lit("{")).when(kind == 1, G.formatted(F.lit("1p"), F.array(branch(F.lit("nobody"), hop("rel1"))))).when(kind == 2, G.formatted(F.lit("1p"), F.array(branch(who, hop("likes")))))
    said = said.when(kind == 3, G.formatted(F.lit("1p"), F.array(branch(who, hop("Rel1"))))).when(kind == 4, G.formatted(F.lit("2p"), F.array(branch(who, hop("rel1"), hop("REL2")))))
    said = said.otherwise(G.formatted(F.lit("2i"), F.array(branch(who, hop("rel1")), branch(F.col("r_name"), hop("rel2", "backward")))))
    outputs = rows.select(F.col("c_custkey").cast("long").alias("qid"), said.alias("text"))
    named = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.concat(F.lit("Q"), (20_000_000 + F.col("c_custkey")).cast("string")).alias("id")).union(r.select("r_name", F.concat(F.lit("Q"), F.col("r_regionkey").cast("string"))))
    names = named.select(G.name_key("name").alias("key"), "id").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    edges = knowledge(spark, sf)
    relations = edges.select(F.col("predicate").alias("key")).distinct().select("key", F.array("key").alias("spellings"))
    return K.parse_prompts(outputs, names, relations, edges, relation_ids(edges))


def _measure(prompts: list[str]) -> list[str]:
    return [f"Answer: {len(p)}" for p in prompts]


@query("SELECT conv_id * 1000 + turn AS qid, CAST(length(text) AS VARCHAR) AS answer, CAST(turn % 2 AS INTEGER) AS arrival FROM conversations")
def incremental_run(spark, sf):
    """Every turn of the conversations as a sample, in two arrivals: the even turns, then all turns. The second run leaves out what the first has done."""
    where = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.lit(1).alias("step"), F.col("text").alias("prompt"))
    for arrived in (rows.where("qid % 2 = 0"), rows):
        arrived.write.mode("append").json(f"{where}/prompts")
        run_incremental(spark, f"{where}/prompts", "qid long, step int, prompt string", f"{where}/out", _measure, f"{where}/checkpoint")
    return spark.read.parquet(f"{where}/out").select("qid", F.element_at("answers", 1).alias("answer"), F.col("batch").alias("arrival"))


# --- what prompts, files and parsers leave behind ---


@query(O.query("up", plan_sql("up"), "SELECT qid, CAST(step AS INTEGER) AS step, array_to_string(list_sort(list(DISTINCT h)), ',') AS heads FROM steps GROUP BY ALL", O.step_sql("up")))
def phase_heads(spark, sf):
    """The heads that each step's evidence starts from."""
    p = plan(spark, sf, "up")
    return E.phase_heads(E.step_rows(p, evidence(spark, sf, "up"), "up")).select("qid", "step", F.array_join("heads", ",").alias("heads"))


@query(O.query("2i", plan_sql("2i"), "SELECT qid, '" + P.PREMISE + "(' || qid || ',2,3)\n\n" + P.QUESTION + "' || " + O.question("2i") + " || '" + P.INSTRUCTION + "' AS prompt FROM plan"))
def premise_swap(spark, sf):
    """One-shot prompts whose evidence is replaced."""
    p = plan(spark, sf, "2i")
    prompts = P.single_prompts(p, E.query_texts(p, evidence(spark, sf, "2i")), "2i")
    return prompts.select("qid", P.with_premise(F.col("prompt"), F.concat(F.lit("("), F.col("qid").cast("string"), F.lit(",2,3)"))).alias("prompt"))


@query("SELECT c_custkey AS k, c_custkey || ',7' AS predicted, CAST(c_nationkey AS VARCHAR) AS gold FROM customer")
def legacy_results(spark, sf):
    """Results of the old form, predictions and gold with signs between."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.col("c_custkey").cast("string"), F.lit(",7 @\n@ "), F.col("c_nationkey").cast("string"), F.lit("\n")).alias("text"))
    parts = files.legacy_results(rows)
    return parts.select("k", F.get("parts", 0).alias("predicted"), F.get("parts", 1).alias("gold"))


@query("SELECT c_custkey AS k, CAST(stage AS INTEGER) AS stage, CAST(c_custkey + stage AS VARCHAR) AS answer, 'said ' || stage AS raw_answer, CASE stage WHEN 1 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN c_custkey % 5 = 0 THEN 'cuda_oom' ELSE 'ok' END AS status FROM customer, (VALUES (1), (2)) v(stage)")
def staged_answers(spark, sf):
    """Staged answer records to one row a stage."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    record = F.to_json(F.struct(F.array(text(k + 1), text(k + 2)).alias("answers"), F.array(F.lit("said 1"), F.lit("said 2")).alias("raw_answers"), F.array(F.lit("high"), F.lit("low")).alias("confidences"), F.when(k % 5 == 0, "cuda_oom").otherwise("ok").alias("status")))
    return files.staged_answers(table(spark, sf, "customer").select(k.alias("k"), record.alias("text")))


@query("""SELECT p_partkey AS source_index, '1p_' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR), CAST(greatest(4, len(CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR))) AS INTEGER), '0') AS sample_id, 'parse' AS system, 'Who makes ' || p_name || '?' AS said, '{"type":"1p","query":[{"anchor":"' || p_name || '","path":[{"relation":"made by","direction":"forward"}]}]}' AS answer FROM part""")
def parser_chats(spark, sf):
    """A question for each part with its parse, as a conversation."""
    path = F.array(F.struct(F.lit("made by").alias("relation"), F.lit("forward").alias("direction")))
    rows = table(spark, sf, "part").select(F.lit("1p").alias("qtype"), F.col("p_partkey").alias("source_index"), F.concat(F.lit("Who makes "), "p_name", F.lit("?")).alias("question"), F.array(F.struct(F.col("p_name").alias("anchor"), path.alias("path"))).alias("query"))
    said = lambda i: F.get("messages", i)["content"]
    return G.chat_records(rows, "parse").select("source_index", "sample_id", said(0).alias("system"), said(1).alias("said"), said(2).alias("answer"))


@query("""WITH g AS (SELECT p_brand AS brand, [NULL, 'entity_not_found', NULL, 'relation_not_found'][p_partkey % 4 + 1] AS reason FROM part), f AS (SELECT brand, reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY ALL)
SELECT g.brand, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok, round(count(*) FILTER (reason IS NULL) / count(*), 6) AS success_rate, coalesce((SELECT string_agg(reason || ':' || n, ',' ORDER BY reason) FROM f WHERE f.brand = g.brand), '') AS failures FROM g GROUP BY g.brand""")
def parser_report(spark, sf):
    """Counts, success and failures of grounded parses by group."""
    reason = F.get(F.array(F.lit(None).cast("string"), F.lit("entity_not_found"), F.lit(None).cast("string"), F.lit("relation_not_found")), (F.col("p_partkey") % 4).cast("int"))
    r = G.report(table(spark, sf, "part").select(F.col("p_brand").alias("brand"), reason.alias("failure_reason")), "brand")
    failures = F.array_join(F.transform(F.array_sort(F.map_entries("failures")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return r.select("brand", "n", "ok", _R6(F.col("success_rate"), "success_rate"), failures.alias("failures"))


@query(_REC + "SELECT model, qtype, count(*) AS n, round(avg(p), 6) AS parse_failure_rate, round(avg(s), 6) AS status_failure_rate, round(avg(greatest(p, s)), 6) AS any_failure_rate FROM (SELECT model, qtype, sample, max(parse_failed) AS p, max(CASE WHEN (sample + len(method)) % 11 = 0 THEN 1 ELSE 0 END) AS s FROM records GROUP BY ALL) GROUP BY ALL")
def failure_rates(spark, sf):
    """Shares of samples that fail to be parsed at some stage, that end badly, and that do either; a method is a stage."""
    status = F.when((F.col("sample") + F.length("method")) % 11 == 0, "context_overflow").otherwise("ok")
    r = summaries.failure_rates(records(spark, sf).withColumn("status", status), ["model", "qtype"])
    return r.select("model", "qtype", "n", *[_R6(F.col(c), c) for c in ("parse_failure_rate", "status_failure_rate", "any_failure_rate")])
