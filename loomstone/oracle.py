"""DuckDB SQL for the same queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import re

from .plans.evidence import STEPS
from .plans.ir import Anchor, Intersect, Node, Project, topology
from .plans.prompts import QUESTIONS, STEP_QUESTIONS

PAIRS = (
    "SELECT 20000000 + c_custkey AS h, 1 AS r, 100 + c_nationkey AS t FROM customer",
    "SELECT 100 + n_nationkey, 2, n_regionkey FROM nation",
    "SELECT 1000000 + s_suppkey, 3, 100 + s_nationkey FROM supplier",
    "SELECT 30000000 + o_orderkey, 4, 20000000 + o_custkey FROM orders",
    "SELECT DISTINCT 30000000 + l_orderkey, 5, 10000000 + l_partkey FROM lineitem",
    "SELECT DISTINCT 30000000 + l_orderkey, 6, 1000000 + l_suppkey FROM lineitem",
    "SELECT DISTINCT 10000000 + l_partkey, 7, 1000000 + l_suppkey FROM lineitem",
)
KG = f"""one AS ({' UNION ALL '.join(PAIRS)}),
kg AS (SELECT CAST(h AS BIGINT) AS h, CAST(r AS INTEGER) AS r, CAST(t AS BIGINT) AS t FROM one
       UNION ALL SELECT CAST(t AS BIGINT), CAST(r + 7 AS INTEGER), CAST(h AS BIGINT) FROM one)"""

BASE = """firsts AS (SELECT l_suppkey, l_orderkey, l_partkey,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey) AS k FROM lineitem),
base AS (SELECT CAST(l_suppkey AS BIGINT) AS qid, 30000000 + l_orderkey AS o, 10000000 + l_partkey AS pt, 1000000 + l_suppkey AS s,
           20000000 + o_custkey AS c, 100 + c_nationkey AS nc, 100 + s_nationkey AS n, n_regionkey AS g
         FROM firsts JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
         JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE k = 1)"""


def plan(anchors: list[str], relations: list[int], source: str = "base") -> str:
    cols = ["qid", *[f"CAST({a} AS BIGINT) AS e{i}" for i, a in enumerate(anchors, 1)], *[f"{r} AS r{i}" for i, r in enumerate(relations, 1)]]
    return f"plan AS (SELECT {', '.join(cols)} FROM {source})"


def lowered(qtype: str) -> tuple[list[str], str, list[str]]:
    """(common table expressions, the answers' name, the kept edges' names): forward by joins, backward by IN."""
    ctes: list[str] = []
    edges: dict[Node, str] = {}
    kept: list[str] = []

    def forward(node: Node) -> str:
        if isinstance(node, Anchor):
            return f"(SELECT qid, e{node.slot} AS ent FROM plan)"
        name = f"f{len(ctes)}"
        if isinstance(node, Project):
            below = forward(node.child)
            name = f"x{node.slot}"
            ctes.append(f"{name} AS (SELECT DISTINCT a.qid, kg.h, kg.r, kg.t FROM {below} a JOIN plan USING (qid) JOIN kg ON kg.h = a.ent AND kg.r {'<>' if node.other else '='} plan.r{node.slot})")
            edges[node] = name
            return f"(SELECT DISTINCT qid, t AS ent FROM {name})"
        word = " INTERSECT " if isinstance(node, Intersect) else " UNION "
        body = word.join(f"SELECT qid, ent FROM {forward(p)}" for p in node.parts)
        name = f"f{len(ctes)}"
        ctes.append(f"{name} AS ({body})")
        return name

    def back(node: Node, keep: str) -> None:
        if isinstance(node, Project):
            name = f"k{node.slot}"
            ctes.append(f"{name} AS (SELECT * FROM {edges[node]} WHERE (qid, t) IN (SELECT (qid, ent) FROM {keep}))")
            kept.append(name)
            back(node.child, f"(SELECT DISTINCT qid, h AS ent FROM {name})")
        elif not isinstance(node, Anchor):
            for p in node.parts:
                back(p, keep)

    tree = topology(qtype)
    top = forward(tree)
    ctes.append(f"answers AS (SELECT qid, ent FROM {top})")
    back(tree, "answers")
    ctes.append("evidence AS (" + " UNION ".join(f"SELECT qid, h, r, t FROM {k}" for k in kept) + ")")
    return ctes, "answers", kept


def query(qtype: str, plan_sql: str, select: str, *more: str, base: bool = True) -> str:
    ctes, _, _ = lowered(qtype)
    return "WITH " + ",\n".join([KG, *([BASE] if base else []), plan_sql, *ctes, *more]) + "\n" + select


ANSWER_SELECT = "SELECT qid, ent FROM answers"
EVIDENCE_SELECT = "SELECT qid, h, r, t FROM evidence"
TEXT = "string_agg('(' || h || ',' || r || ',' || t || ')', ',' ORDER BY h, r, t)"


def step_sql(qtype: str) -> str:
    """The rows (qid, step, h, r, t) of a topology's step rules."""
    parts = []
    for i, rule in enumerate(STEPS[qtype], 1):
        tests = []
        for word in rule.split():
            tests.append("TRUE" if word == "all" else f"h = e{word[1]}" if word[0] == "h" else f"r {'=' if word[0] == 'r' else '<>'} r{word[1]}")
        if tests:
            parts.append(f"SELECT qid, {i} AS step, h, r, t FROM evidence JOIN plan USING (qid) WHERE {' OR '.join(tests)}")
    return f"steps AS ({' UNION ALL '.join(parts)}), every AS (SELECT qid, unnest(range(1, {len(STEPS[qtype]) + 1})) AS step FROM plan)"


STEP_TEXTS = f"SELECT every.qid, CAST(every.step AS INTEGER) AS step, coalesce({TEXT}, '') AS triples FROM every LEFT JOIN steps ON steps.qid = every.qid AND steps.step = every.step GROUP BY ALL"


def filled(template: str) -> str:
    parts = re.split(r"\{([er]\d)\}", template)
    return " || ".join(f"CAST({p} AS VARCHAR)" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if i % 2 or p)


def question(qtype: str) -> str:
    return filled(QUESTIONS[qtype])


def step_questions(qtype: str) -> str:
    return " UNION ALL ".join(f"SELECT qid, {i} AS step, {filled(q)} AS question FROM plan" for i, q in enumerate(STEP_QUESTIONS[qtype], 1))
