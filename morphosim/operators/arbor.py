"""Tree-shaped skeletons: pruning, measuring and resampling, one tree at a time in a task.

A skeleton is a table (skeleton_id, node_id, parent_id, x, y, z) whose root has no
parent. Definitions (our own, from the standard terms of trees): a branch point has
two children or more; a leaf none; Strahler order is 1 at leaves, and at other nodes
the children's highest, plus 1 if two share it; depth counts edges from the root.
Ids that a tree lacks are ignored. Trees with no or several roots, or with cycles,
are errors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "skeleton_id long, node_id long, parent_id long, x double, y double, z double"


class Tree:
    """Nodes in an order where parents come before children."""

    def __init__(self, ids: list[int], parents: list[int | None], points: np.ndarray):
        at = {n: i for i, n in enumerate(ids)}
        children: list[list[int]] = [[] for _ in ids]
        roots = []
        for i, p in enumerate(parents):
            if p is None:
                roots.append(i)
            elif p not in at:
                raise ValueError(f"node {ids[i]} has an unknown parent")
            else:
                children[at[p]].append(i)
        if len(roots) != 1 or len(at) != len(ids):
            raise ValueError("a skeleton needs one root and distinct nodes")
        order, stack = [], roots
        while stack:
            i = stack.pop()
            order.append(i)
            stack += sorted(children[i], key=lambda c: -ids[c])
        if len(order) != len(ids):
            raise ValueError("a skeleton has a cycle")
        place = {i: k for k, i in enumerate(order)}
        self.ids, self.points = [ids[i] for i in order], points[order]
        self.parent = [-1 if parents[i] is None else place[at[parents[i]]] for i in order]
        self.children: list[list[int]] = [[] for _ in order]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        self.edge = [0.0 if p < 0 else float(np.sqrt(((self.points[i] - self.points[p]) ** 2).sum())) for i, p in enumerate(self.parent)]

    def down(self, start, step: Callable) -> list:
        """A value for each node from its parent's."""
        out: list = []
        for i, p in enumerate(self.parent):
            out.append(start if p < 0 else step(out[p], i, p))
        return out

    def depth(self) -> list[int]:
        return self.down(0, lambda v, i, p: v + 1)

    def cable(self) -> list[float]:
        return self.down(0.0, lambda v, i, p: v + self.edge[i])

    def branches(self) -> list[int]:
        """How many branch points lie between the root and each node, the root counted if it is one, the node not."""
        return self.down(0, lambda v, i, p: v + (len(self.children[p]) > 1))

    def strahler(self) -> list[int]:
        out = [1] * len(self.ids)
        for i in range(len(self.ids) - 1, -1, -1):
            if self.children[i]:
                own = sorted((out[c] for c in self.children[i]), reverse=True)
                out[i] = own[0] + (len(own) > 1 and own[0] == own[1])
        return out

    def keep_connected(self, keep: list[bool]) -> list[bool]:
        """A node stays only if its parent does."""
        return self.down(keep[0], lambda v, i, p: v and keep[i])

    def twig_start(self, leaf: int) -> tuple[int, float]:
        """The first node of the unbranched run that ends at a leaf, and its length from the branch point or root before it."""
        i, length = leaf, self.edge[leaf]
        while self.parent[i] >= 0 and len(self.children[self.parent[i]]) == 1 and self.parent[self.parent[i]] >= 0:
            i = self.parent[i]
            length += self.edge[i]
        return i, length


def _each(skeletons: DataFrame, work: Callable[[Tree], pd.DataFrame], schema: str) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        parents = [None if pd.isna(p) else int(p) for p in pdf.parent_id]
        out = work(Tree(pdf.node_id.astype(int).tolist(), parents, pdf[["x", "y", "z"]].to_numpy(float)))
        out.insert(0, "skeleton_id", key[0])
        return out

    return skeletons.groupBy("skeleton_id").applyInPandas(run, schema)


def _rows(t: Tree, keep: list[bool] | None = None) -> pd.DataFrame:
    some = [i for i in range(len(t.ids)) if keep is None or keep[i]]
    parent = pd.array([None if t.parent[i] < 0 else t.ids[t.parent[i]] for i in some], dtype="Int64")
    p = t.points[some]
    return pd.DataFrame({"node_id": [t.ids[i] for i in some], "parent_id": parent, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


def _pruned(skeletons: DataFrame, keep: Callable[[Tree], list[bool]]) -> DataFrame:
    return _each(skeletons, lambda t: _rows(t, t.keep_connected(keep(t))), SCHEMA)


def validated(skeletons: DataFrame) -> DataFrame:
    """The skeletons in pre-order; an error for what is no tree."""
    return _each(skeletons, _rows, SCHEMA)


def ordered(skeletons: DataFrame) -> DataFrame:
    """``validated`` with each node's place in pre-order."""
    return _each(skeletons, lambda t: _rows(t).assign(place=np.arange(len(t.ids))), SCHEMA + ", place long")


def prune_at(skeletons: DataFrame, ids: list[int]) -> DataFrame:
    """Without the nodes and all that hangs on them."""
    gone = set(ids)
    return _pruned(skeletons, lambda t: [n not in gone for n in t.ids])


def prune_branches_containing(skeletons: DataFrame, ids: list[int]) -> DataFrame:
    """Without each node's branch, from the first node after the nearest branch point (or the root) on."""
    gone = set(ids)

    def keep(t: Tree) -> list[bool]:
        out = [True] * len(t.ids)
        for i, n in enumerate(t.ids):
            if n in gone:
                while t.parent[i] >= 0 and len(t.children[t.parent[i]]) == 1 and t.parent[t.parent[i]] >= 0:
                    i = t.parent[i]
                out[i] = False
        return out

    return _pruned(skeletons, keep)


def prune_below_strahler(skeletons: DataFrame, least: int) -> DataFrame:
    return _pruned(skeletons, lambda t: [s >= least for s in t.strahler()])


def prune_beyond_branches(skeletons: DataFrame, most: int) -> DataFrame:
    return _pruned(skeletons, lambda t: [b <= most for b in t.branches()])


def prune_beyond_steps(skeletons: DataFrame, most: int) -> DataFrame:
    return _pruned(skeletons, lambda t: [d <= most for d in t.depth()])


def prune_beyond_distance(skeletons: DataFrame, most: float) -> DataFrame:
    return _pruned(skeletons, lambda t: [d <= most for d in t.cable()])


def prune_twigs(skeletons: DataFrame, least: float) -> DataFrame:
    """Without terminal branches shorter than ``least``."""

    def keep(t: Tree) -> list[bool]:
        out = [True] * len(t.ids)
        for i in range(1, len(t.ids)):
            if not t.children[i]:
                start, length = t.twig_start(i)
                out[start] = out[start] and length >= least
        return out

    return _pruned(skeletons, keep)


def cable_length(skeletons: DataFrame) -> DataFrame:
    """skeleton_id, cable_length: an equi-join of children with parents, no tree walked."""
    p = skeletons.select("skeleton_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz"))
    edges = skeletons.join(p, ["skeleton_id", "parent_id"], "left")
    return edges.groupBy("skeleton_id").agg(F.coalesce(F.sum(d), F.lit(0.0)).alias("cable_length"))


def strahler(skeletons: DataFrame) -> DataFrame:
    """skeleton_id, node_id, strahler."""
    return _each(skeletons, lambda t: pd.DataFrame({"node_id": t.ids, "strahler": t.strahler()}), "skeleton_id long, node_id long, strahler int")


def roots(skeletons: DataFrame) -> DataFrame:
    return skeletons.where("parent_id is null").select("skeleton_id", F.col("node_id").alias("root_id"))


def points(skeletons: DataFrame, resample: float | None = None) -> DataFrame:
    """skeleton_id, point_idx, x, y, z: the nodes in pre-order, or points every ``resample`` along each branch from its start on."""

    def work(t: Tree) -> pd.DataFrame:
        if resample is None:
            p = t.points
        else:
            out = [t.points[0]]
            starts = [c for i in range(len(t.ids)) if i == 0 or len(t.children[i]) > 1 for c in t.children[i]]
            for c in starts:
                i, left = c, resample
                while True:
                    a, b, size = t.points[t.parent[i]], t.points[i], t.edge[i]
                    at = left
                    while size > 0 and at <= size:
                        out.append(a + (b - a) * (at / size))
                        at += resample
                    left = at - size
                    if len(t.children[i]) != 1:
                        break
                    i = t.children[i][0]
            p = np.array(out)
        return pd.DataFrame({"point_idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return _each(skeletons, work, "skeleton_id long, point_idx int, x double, y double, z double")
