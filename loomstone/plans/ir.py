"""Logical queries as trees: anchors, projections, intersections, unions.

A tree is compiled once for a topology and serves any number of queries of it: anchors and relations are
slots, filled by the columns e1, e2, ... and r1, r2, ... of a plan table.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass


@dataclass(frozen=True)
class Anchor:
    slot: int


@dataclass(frozen=True)
class Project:
    child: Node
    slot: int
    other: bool = False  # tails by any relation other than the slot's


@dataclass(frozen=True)
class Intersect:
    parts: tuple


@dataclass(frozen=True)
class Union:
    parts: tuple


Node = Anchor | Project | Intersect | Union

#: The topologies as literals; 'n' marks the relation before it as "any other", 'u' a union.
SHAPES = {
    "1p": "('e', ('r',))",
    "2p": "('e', ('r', 'r'))",
    "3p": "('e', ('r', 'r', 'r'))",
    "2i": "(('e', ('r',)), ('e', ('r',)))",
    "3i": "(('e', ('r',)), ('e', ('r',)), ('e', ('r',)))",
    "ip": "((('e', ('r',)), ('e', ('r',))), ('r',))",
    "pi": "(('e', ('r', 'r')), ('e', ('r',)))",
    "2u": "(('e', ('r',)), ('e', ('r',)), ('u',))",
    "up": "((('e', ('r',)), ('e', ('r',)), ('u',)), ('r',))",
    "2in": "(('e', ('r',)), ('e', ('r', 'n')))",
    "3in": "(('e', ('r',)), ('e', ('r',)), ('e', ('r', 'n')))",
    "inp": "((('e', ('r',)), ('e', ('r', 'n'))), ('r',))",
    "pin": "(('e', ('r', 'r')), ('e', ('r', 'n')))",
    "pni": "(('e', ('r', 'r', 'n')), ('e', ('r',)))",
}


def _atoms(x) -> bool:
    return isinstance(x, tuple) and len(x) > 0 and not any(isinstance(i, tuple) for i in x)


def parse(literal: str | tuple) -> tuple[Node, list, list]:
    """(tree, anchors, relations) of a query literal: paths of any length, any number of branches, any nesting, a projection after a group. Slots are numbered from 1 in reading order."""
    anchors: list = []
    relations: list = []

    def hops(node: Node, rels: tuple) -> Node:
        for i, r in enumerate(rels):
            if r == "n":
                continue
            relations.append(r)
            node = Project(node, len(relations), i + 1 < len(rels) and rels[i + 1] == "n")
        return node

    def walk(x) -> Node:
        if not isinstance(x, tuple) or len(x) < 2:
            raise ValueError(f"no query: {x!r}")
        if not isinstance(x[0], tuple):
            if len(x) != 2 or not _atoms(x[1]):
                raise ValueError(f"no path: {x!r}")
            anchors.append(x[0])
            return hops(Anchor(len(anchors)), x[1])
        if len(x) == 2 and _atoms(x[1]) and x[1] != ("u",):
            return hops(walk(x[0]), x[1])
        if x[-1] == ("u",):
            if len(x) < 3:
                raise ValueError("a union needs two branches")
            return Union(tuple(map(walk, x[:-1])))
        return Intersect(tuple(map(walk, x)))

    tree = walk(ast.literal_eval(literal) if isinstance(literal, str) else literal)
    return tree, anchors, relations


def topology(qtype: str) -> Node:
    """The tree of one of the named shapes."""
    return parse(SHAPES[qtype])[0]


def qtype_of(literal: str | tuple) -> str | None:
    """The name of a literal's shape, or None."""
    tree = parse(literal)[0]
    return next((q for q in SHAPES if topology(q) == tree), None)


def slots(node: Node) -> tuple[int, int]:
    """How many anchors and relations a tree has."""
    if isinstance(node, Anchor):
        return node.slot, 0
    if isinstance(node, Project):
        e, r = slots(node.child)
        return e, max(r, node.slot)
    found = [slots(p) for p in node.parts]
    return max(e for e, _ in found), max(r for _, r in found)
