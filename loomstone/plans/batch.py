"""Batches of any mixture of trees as one plan: a node table, run height by height and explained back down.

A node table has a row for each node of each query: (qid, node, parent, up, kind, fan, height, ent, rel, other, inner, way).
``kind`` is A (an anchor, with ``ent``), P (a projection by ``rel``, or by any other relation), I or U (a group of ``fan``
parts); ``up`` is the height of the parent, both null at the root.  All nodes of one height are worked on together, so a
batch takes as many rounds as its highest tree has levels, however many topologies it mixes, and each round reads
the triples once for its projections by a relation and once for those by any other.

Paths inside intersections come first, in rounds of their own: each distinct one, its anchor and relations, is walked once
for all queries that hold it.  An intersection lists the part that has fewest entities and looks them up in the others.
The row of such a path's last node has ``way``, a struct of its anchor and relations; rows of its other nodes are ``inner``.

A round's result is written: edges of projections, entities of groups.  The way back reads only these tables,
never the triples: what an answer needs is semi-joined from each height to the one below, and each edge that
is left knows the nodes that used it.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.staged import written
from .ir import SHAPES, Anchor, Intersect, Node, Project, parse, topology
from .lowering import MOST_RELATIONS, only

_COLUMNS = ("qid", "node", "parent", "up", "kind", "fan", "height", "ent", "rel", "other", "inner", "way")
_NODE = T.StructType(
    [T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("up", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("fan", T.IntegerType()), T.StructField("height", T.IntegerType())]
    + [T.StructField("e", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("other", T.BooleanType())]
)


def tree_nodes(tree: Node) -> list[dict]:
    """The nodes of a tree, children before parents, the root last; ``e`` and ``r`` are slots. ``way``: the anchor's slot and (slot, other) of each projection of a path that is a part of an intersection, at its last node; ``inner``: its other nodes."""
    out: list[dict] = []

    def way(n: Node) -> tuple | None:
        if isinstance(n, Anchor):
            return n.slot, []
        below = way(n.child) if isinstance(n, Project) else None
        return below and (below[0], [*below[1], (n.slot, n.other)])

    def add(n: Node, path: tuple | None = None, inner: bool = False) -> dict:
        parts = () if isinstance(n, Anchor) else (n.child,) if isinstance(n, Project) else n.parts
        below = [add(p, way(p) if isinstance(n, Intersect) else None, inner or path is not None) for p in parts]
        kind = "A" if isinstance(n, Anchor) else "P" if isinstance(n, Project) else "I" if isinstance(n, Intersect) else "U"
        row = {"node": len(out), "parent": None, "up": None, "kind": kind, "fan": len(parts), "height": 1 + max((b["height"] for b in below), default=-1)}
        row |= {"e": n.slot if kind == "A" else None, "r": n.slot if kind == "P" else None, "other": kind == "P" and n.other, "inner": inner, "way": path}
        for b in below:
            b["parent"], b["up"] = row["node"], row["height"]
        out.append(row)
        return row

    add(tree)
    return out


def typed_nodes(plan: DataFrame) -> DataFrame:
    """The node table of ``plan`` (qid, qtype, e1, ..., r1, ...), whose queries may be of all named topologies; slots that a topology lacks are null. An unknown topology is an error."""
    slot = lambda letter, n: F.col(f"{letter}{n}") if n is not None and f"{letter}{n}" in plan.columns else F.lit(None)
    kind_e, kind_r = (plan.schema[c].dataType for c in ("e1", "r1"))

    def struct(n: dict) -> Column:
        whole = [F.lit(n[c]).cast(k).alias(c) for c, k in (("node", "int"), ("parent", "int"), ("up", "int"), ("kind", "string"), ("fan", "int"), ("height", "int"))]
        hop = f"struct<rel:{kind_r.simpleString()},other:boolean>"
        hops = F.array(*[F.struct(slot("r", r).cast(kind_r).alias("rel"), F.lit(o).alias("other")) for r, o in n["way"][1]]) if n["way"] else None
        way = F.struct(slot("e", n["way"][0]).cast(kind_e).alias("ent"), hops.alias("hops")) if n["way"] else F.lit(None)
        ends = [F.lit(n["other"]).alias("other"), F.lit(n["inner"]).alias("inner"), way.cast(f"struct<ent:{kind_e.simpleString()},hops:array<{hop}>>").alias("way")]
        return F.struct(*whole, slot("e", n["e"]).cast(kind_e).alias("ent"), slot("r", n["r"]).cast(kind_r).alias("rel"), *ends)

    chosen = F
    for qtype in SHAPES:
        chosen = chosen.when(F.col("qtype") == qtype, F.array(*map(struct, tree_nodes(topology(qtype)))))
    return plan.select("qid", F.inline(chosen.otherwise(F.raise_error(F.concat(F.lit("no topology "), F.coalesce("qtype", F.lit("null")))))))


_WAY = T.StructType([T.StructField("ent", T.LongType()), T.StructField("hops", T.ArrayType(T.StructType([T.StructField("rel", T.IntegerType()), T.StructField("other", T.BooleanType())])))])
_PARSED = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([*_NODE.fields[:6], T.StructField("ent", T.LongType()), T.StructField("rel", T.IntegerType()), T.StructField("other", T.BooleanType()), T.StructField("inner", T.BooleanType()), T.StructField("way", _WAY)]))), T.StructField("error", T.StringType())])


def _parsed(text: str | None) -> dict:
    try:
        tree, anchors, relations = parse(text)
        ents, rels = [int(a) for a in anchors], [int(r) for r in relations]
    except (ValueError, TypeError, SyntaxError, RecursionError, MemoryError) as e:
        return {"nodes": None, "error": str(e)[:200] or type(e).__name__}
    rows = tree_nodes(tree)
    way = lambda w: w and {"ent": ents[w[0] - 1], "hops": [{"rel": rels[r - 1], "other": o} for r, o in w[1]]}
    return {"nodes": [{**{k: n[k] for k in ("node", "parent", "up", "kind", "fan", "height", "other", "inner")}, "way": way(n["way"]), "ent": ents[n["e"] - 1] if n["e"] else None, "rel": rels[n["r"] - 1] if n["r"] else None} for n in rows], "error": None}


@F.pandas_udf(_PARSED)
def parsed_literals(texts: pd.Series) -> pd.DataFrame:
    """Nodes of query literals of any nesting, or why a literal is none."""
    return pd.DataFrame([_parsed(t) for t in texts], columns=_PARSED.names)


#: A whole number that stands alone: of 18 digits at most, beside no letter, quote, sign or point, and no character beyond ASCII.
_ALONE = r"""(?<![0-9A-Za-z_.'"+\-\\]|[^\x00-\x7f])(?:0|[1-9][0-9]{0,17})(?![0-9A-Za-z_.'"\\]|[^\x00-\x7f])"""
#: What a number is written as in a literal's form, and from where on the form's numbers count when it is read.
_BLANK, _FIRST = "\u2400", 7_355_608_000_000_000_000
_PLACE = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("value", T.LongType())])
_SLOTS = T.StructType([T.StructField("ent", _PLACE), T.StructField("hops", T.ArrayType(T.StructType([T.StructField("rel", _PLACE), T.StructField("other", T.BooleanType())])))])
_FORM = T.StructType([T.StructField("nodes", T.ArrayType(T.StructType([*_NODE.fields[:6], T.StructField("ent", _PLACE), T.StructField("rel", _PLACE), T.StructField("other", T.BooleanType()), T.StructField("inner", T.BooleanType()), T.StructField("way", _SLOTS)]))), T.StructField("plain", T.BooleanType())])


def _form(form: str) -> dict:
    """The nodes of a literal's form, entities and relations as places among the literal's numbers or as values; not ``plain`` if it is no query or not told by its form."""
    count = form.count(_BLANK)
    text = form
    for i in range(count):
        text = text.replace(_BLANK, str(_FIRST + i), 1)
    read = _parsed(text) if str(_FIRST)[:7] not in form else {"nodes": None}
    if read["nodes"] is None:
        return {"nodes": None, "plain": False}
    place = lambda x: None if x is None else {"at": x - _FIRST, "value": None} if _FIRST <= x < _FIRST + count else {"at": None, "value": x}
    way = lambda w: w and {"ent": place(w["ent"]), "hops": [{"rel": place(h["rel"]), "other": h["other"]} for h in w["hops"]]}
    return {"nodes": [n | {"ent": place(n["ent"]), "rel": place(n["rel"]), "way": way(n["way"])} for n in read["nodes"]], "plain": True}


@F.pandas_udf(_FORM)
def parsed_forms(forms: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_form(f) for f in forms], columns=_FORM.names)


def literal_nodes(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node table, faults (qid, error)) of ``queries`` (qid, literal): each literal by its own tree, whatever its topology.

    A literal's form is the literal without its numbers.  Each form is parsed once, and its nodes are filled with the numbers
    of the literals that have it; a literal whose form is no query is parsed by itself, which tells why.
    """
    blank = F.coalesce(F.col("literal"), F.lit(""))
    form = F.when(F.contains(blank, F.lit(_BLANK)), F.lit("")).otherwise(F.regexp_replace(blank, F.lit(_ALONE), F.lit(_BLANK)))
    texts = queries.select("qid", "literal", form.alias("form"), F.regexp_extract_all(blank, F.lit(_ALONE), F.lit(0)).cast("array<bigint>").alias("numbers"))
    forms = written(texts.select("form").distinct().select("form", parsed_forms("form").alias("p")).select("form", "p.*"), "forms")
    met = texts.join(forms, "form")
    odd = written(met.where("NOT plain").select("qid", parsed_literals("literal").alias("p")).select("qid", "p.*"), "odd")
    value = lambda x: F.coalesce(F.get(F.col("numbers"), x["at"]), x["value"])
    hop = lambda h: F.struct(value(h["rel"]).cast("int").alias("rel"), h["other"].alias("other"))
    way = lambda w: F.when(w.isNotNull(), F.struct(value(w["ent"]).alias("ent"), F.transform(w["hops"], hop).alias("hops")))
    filled = lambda n: F.struct(*[n[f.name].alias(f.name) for f in _NODE.fields[:6]], value(n["ent"]).alias("ent"), value(n["rel"]).cast("int").alias("rel"), n["other"].alias("other"), n["inner"].alias("inner"), way(n["way"]).alias("way"))
    nodes = met.where("plain").select("qid", F.inline(F.transform("nodes", filled)))
    return nodes.union(odd.where("error IS NULL").select("qid", F.inline("nodes"))), odd.where("error IS NOT NULL").select("qid", "error")


class Batch:
    """A node table over triples (h, r, t)."""

    def __init__(self, nodes: DataFrame, kg: DataFrame, most_relations: int = MOST_RELATIONS):
        self.kg, self.most = kg, most_relations
        every = written(nodes.select(*_COLUMNS), "nodes")
        self.ways = written(every.where("way IS NOT NULL").select("way").distinct().select(F.monotonically_increasing_id().alias("id"), F.size("way.hops").alias("length"), "way"), "ways")
        self.tops = written(every.where("way IS NOT NULL").join(self.ways, "way").select("qid", F.col("node").alias("child"), F.col("parent").alias("node"), "up", "id", "length"), "tops")
        self.nodes = every.where("NOT inner AND way IS NULL").drop("inner", "way")
        self.highest = self.nodes.agg(F.max("height")).first()[0] or 0
        self.longest = self.ways.agg(F.max("length")).first()[0] or 0
        self.levels: list[DataFrame] = []
        self.walked: list[DataFrame] = []
        self._down: list[DataFrame] | None = None

    def _hops(self, asked: DataFrame, kinds: set[bool], *kept: str) -> list[DataFrame]:
        """The triples that rows with (ent, rel, other) meet, with the columns ``kept``: at most two reads of the triples."""
        parts = []
        for other in sorted(kinds):
            mine = asked.where(F.col("other") == other)
            kg = self.kg if other else only(self.kg, mine.select("rel"), self.most)
            same = F.col("r") != F.col("rel") if other else F.col("r") == F.col("rel")
            parts.append(mine.join(kg, (F.col("ent") == F.col("h")) & same).select(*kept, "h", "r", "t"))
        return parts

    def _walk(self) -> DataFrame:
        """(id, ent): the ends of each way. Its edges (id, h, r, t) of each hop are written to ``walked``."""
        at = self.ways.select("id", F.col("way.ent").alias("ent"))
        ends = [at.join(self.ways.where("length = 0").select("id"), "id", "left_semi")]
        for n in range(1, self.longest + 1):
            hop = written(self.ways.where(F.col("length") >= n).select("id", F.col("way.hops")[n - 1].alias("x")).select("id", "x.rel", "x.other"), "hops")
            kinds = {x[0] for x in hop.select("other").distinct().collect()}  # two rows at most
            self.walked.append(written(reduce(DataFrame.union, self._hops(at.join(hop, "id"), kinds, "id")), "walked"))
            at = self.walked[-1].select("id", F.col("t").alias("ent")).distinct()
            ends.append(at.join(self.ways.where(F.col("length") == n).select("id"), "id", "left_semi"))
        return written(reduce(DataFrame.union, ends), "ends")

    def _met(self, groups: DataFrame, height: int, reached: DataFrame, ends: DataFrame) -> DataFrame:
        """(qid, node, parent, up, ent): the entities of the smallest part of each intersection that all its other parts have."""
        tops = self.tops.where(F.col("up") == height).select("qid", "node", "child", "id")
        own = reached.groupBy("qid", "node", "child").agg(F.count("*").alias("size")).select("qid", "node", "child", F.lit(None).cast("bigint").alias("id"), "size")
        shared = tops.join(ends.groupBy("id").agg(F.count("*").alias("size")), "id").select("qid", "node", "child", "id", "size")
        parts = written(own.union(shared).join(groups, ["qid", "node"]), "parts")
        best = parts.groupBy("qid", "node", "parent", "up", "fan").agg(F.count("*").alias("filled"), F.min(F.struct("size", "child", "id")).alias("x")).where("filled = fan")
        best = written(best.select("qid", "node", "parent", "up", "fan", "x.child", "x.id"), "best")
        listed = best.where("id IS NULL").join(reached, ["qid", "node", "child"]).select(*best.columns, "ent").union(best.where("id IS NOT NULL").join(ends, "id").select(*best.columns, "ent"))
        asked = listed.withColumnsRenamed({"child": "least"}).drop("id").join(parts.select("qid", "node", "child", "id"), ["qid", "node"]).where("child <> least")
        found = asked.where("id IS NULL").join(reached, ["qid", "node", "child", "ent"], "left_semi").select("qid", "node", "parent", "up", "fan", "ent")
        found = found.union(asked.where("id IS NOT NULL").join(ends, ["id", "ent"], "left_semi").select(*found.columns))
        return found.groupBy(*found.columns).agg(F.count("*").alias("met")).where("met = fan - 1").select("qid", "node", "parent", "up", "ent")

    def forward(self) -> list[DataFrame]:
        """For each height (qid, node, parent, up, h, r, t): edges of projections; anchors and groups have their entities as t and no h. Paths inside intersections aren't among them."""
        if self.levels:
            return self.levels
        kinds = {tuple(x) for x in self.nodes.where("kind <> 'A'").select("height", "kind", "other").distinct().collect()}  # four rows for each height at most
        triple = {f.name: f.dataType for f in self.kg.schema}
        bare = lambda df: df.select("qid", "node", "parent", "up", F.lit(None).cast(triple["h"]).alias("h"), F.lit(None).cast(triple["r"]).alias("r"), F.col("ent").cast(triple["t"]).alias("t"))
        ends = self._walk()
        self.levels.append(written(bare(self.nodes.where("kind = 'A'")), "level"))
        for height in range(1, self.highest + 1):
            reached = reduce(DataFrame.union, [x.where(F.col("up") == height).select("qid", F.col("node").alias("child"), F.col("parent").alias("node"), F.col("t").alias("ent")) for x in self.levels]).distinct()
            here = self.nodes.where(F.col("height") == height).drop("ent", "height")
            hops, groups = {o for h, k, o in kinds if h == height and k == "P"}, {k for h, k, _ in kinds if h == height}
            parts = []
            if hops:
                parts += self._hops(reached.join(here.where("kind = 'P'"), ["qid", "node"]), hops, "qid", "node", "parent", "up")
            if "U" in groups:
                parts.append(bare(reached.join(here.where("kind = 'U'"), ["qid", "node"]).select("qid", "node", "parent", "up", "ent").distinct()))
            if "I" in groups:
                parts.append(bare(self._met(here.where("kind = 'I'").select("qid", "node", "parent", "up", "fan"), height, written(reached.join(here.where("kind = 'I'").select("qid", "node"), ["qid", "node"], "left_semi"), "reached"), ends)))
            parts = parts or [self.levels[0].where("false")]
            self.levels.append(written(reduce(DataFrame.union, parts), "level"))
        return self.levels

    def answers(self) -> DataFrame:
        """(qid, ent), distinct. A query without answers has no row."""
        return reduce(DataFrame.union, [x.where("parent IS NULL").select("qid", F.col("t").alias("ent")) for x in self.forward()]).distinct()

    def kept(self) -> list[DataFrame]:
        """The levels cut to what lies on a derivation of an answer. A part of a union keeps only what it reached itself."""
        if self._down is not None:
            return self._down
        levels = self.forward()
        links = self.nodes.where("parent IS NOT NULL").select("qid", F.col("node").alias("child"), F.col("parent").alias("node"), F.col("height").alias("at"))
        self._down, wanted, paths = [], [], []
        for height in range(self.highest, 0, -1):
            here = levels[height]
            roots = here.where("parent IS NULL")
            below = here.where("parent IS NOT NULL")
            asked = [w.where(F.col("at") == height).select("qid", F.col("child").alias("node"), F.col("ent").alias("t")) for w in wanted]
            cut = roots.union(below.join(reduce(DataFrame.union, asked).distinct(), ["qid", "node", "t"], "left_semi").select(here.columns)) if asked else roots
            cut = written(cut, "kept")
            self._down.append(cut)
            # A projection asks its part for the heads of what is left, a group each of its parts for its entities.
            asks = cut.select("qid", "node", F.coalesce("h", "t").alias("ent")).distinct()
            wanted.append(asks.join(links, ["qid", "node"]).select("qid", "child", "ent", "at"))
            paths.append(cut.where("h IS NULL").select("qid", "node", F.col("t").alias("ent")).join(self.tops, ["qid", "node"]).select("qid", "child", "id", "length", "ent"))
        # A path's nodes are numbered upwards, without gaps.
        asks = reduce(DataFrame.union, paths) if paths and self.longest else None
        for n in range(self.longest if asks is not None else 0, 0, -1):
            now = asks.where(F.col("length") >= n).withColumnRenamed("ent", "t").join(self.walked[n - 1], ["id", "t"])
            now = written(now.select("qid", "child", "id", "length", (F.col("child") - F.col("length") + n).alias("node"), "h", "r", "t"), "kept")
            self._down.append(now)
            asks = asks.where(F.col("length") < n).union(now.select("qid", "child", "id", "length", F.col("h").alias("ent")).distinct())
        return self._down

    def evidence(self) -> DataFrame:
        """(qid, h, r, t, nodes): each triple that some derivation of some answer uses, once for a query, with the projections that used it in order."""
        edges = [x.where("h IS NOT NULL").select("qid", "h", "r", "t", "node") for x in self.kept()]
        return reduce(DataFrame.union, edges).groupBy("qid", "h", "r", "t").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
