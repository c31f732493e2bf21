"""Newick trees: a tokenizer without recursion, node tables, and the tip-to-ancestor closure."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark import errors, schemas

_TOKENS = re.compile(r"\s+|\[[^\]]*\]|'((?:[^']|'')*)'|([(),:;])|([^\s(),:;\[\]']+)")


@dataclass
class Node:
    """A node in preorder."""

    node_id: int
    parent_id: int | None
    depth: int
    name: str | None = None
    length: float = 0.0
    children: int = 0
    subtree_end: int = 0
    ancestors: list[int] = field(default_factory=list)


def parse(text: str) -> list[Node]:
    """Nodes in preorder; the root is node 0. Missing lengths are 0, unquoted underscores stay."""
    nodes = [Node(0, None, 0)]
    current, expect_length, closed, at = nodes[0], False, False, 0
    while at < len(text):
        found = _TOKENS.match(text, at)
        if found is None or closed and (found[2] or found[3] or found[1] is not None):
            raise ValueError(errors.NOT_NEWICK)
        at = found.end()
        quoted, mark, word = found[1], found[2], found[3]
        if quoted is not None or word:
            label = quoted.replace("''", "'") if quoted is not None else word
            if expect_length:
                try:
                    current.length = float(label)
                except ValueError:
                    raise ValueError(errors.NOT_NEWICK) from None
                expect_length = False
            elif current.name is not None:
                raise ValueError(errors.NOT_NEWICK)
            else:
                current.name = label
        elif mark == "(":
            current = _child(nodes, current)
        elif mark == ",":
            if current.parent_id is None:
                raise ValueError(errors.NOT_NEWICK)
            current = _child(nodes, nodes[current.parent_id])
        elif mark == ")":
            if current.parent_id is None:
                raise ValueError(errors.NOT_NEWICK)
            current = nodes[current.parent_id]
        elif mark == ":":
            expect_length = True
        elif mark == ";":
            closed = True
    if not closed or current.parent_id is not None or expect_length:
        raise ValueError(errors.NOT_NEWICK)
    for node in nodes:
        if node.parent_id is not None:
            node.ancestors = [*nodes[node.parent_id].ancestors, node.node_id]
        node.subtree_end = node.node_id
    for node in reversed(nodes[1:]):
        parent = nodes[node.parent_id]
        parent.subtree_end = max(parent.subtree_end, node.subtree_end)
    return nodes


def _child(nodes: list[Node], parent: Node) -> Node:
    parent.children += 1
    nodes.append(Node(len(nodes), parent.node_id, parent.depth + 1))
    return nodes[-1]


def is_newick(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def node_table(spark: SparkSession, text: str) -> DataFrame:
    """The tree as rows (schemas.NODES)."""
    rows = [(n.node_id, n.parent_id, n.name, n.length, n.children == 0, n.depth, n.subtree_end, n.ancestors) for n in parse(text)]
    return spark.createDataFrame(rows, schemas.NODES)


def closure(nodes: DataFrame, include_root_edge: bool = False) -> DataFrame:
    """One row for each tip and each edge between it and the root (schemas.CLOSURE)."""
    edges = nodes.select(F.col("node_id").alias("edge"), "length", "is_tip")
    tips = nodes.where("is_tip").select(F.col("name").alias("feature_id"), F.explode("ancestors" if not include_root_edge else F.concat(F.array(F.lit(0)), "ancestors")).alias("edge"))
    return tips.join(edges, "edge").select("feature_id", F.col("edge").cast("string").alias("node_id"), "length", "is_tip")
