"""Alignment of many sequences along a binary tree, from the leaves up.

Every node keeps its k best alignments as a table of packed rows. The driver
walks the tree; a node is one Spark job over the pairs of its children's rows
(k squared at most), each of which is aligned as two lists of columns.

Methods: pairs (penalties summed over the pairs of sequences on either side),
general (one penalty about the mean gap of all), representative (each alignment
is first reduced to one list of sites).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.penalty import Weights
from ..sources.trees import Node
from ..storage import stored
from .chain import Cells, Steps, best_chains, chains_by_part, chains_of, step_lists
from .sites import REACH


@dataclass
class Columns:
    """An alignment's columns, or a sequence's sites: labels, and begin, end and weight by sequence."""

    names: list[str]
    label: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    weight: np.ndarray

    def taken(self, at: np.ndarray) -> "Columns":
        return Columns(self.names, self.label[at], self.begin[at], self.end[at], self.weight[at])

    def representative(self) -> "Columns":
        """One list of sites: the first sequence's, spaced by the mean gaps."""
        begin, end = np.zeros(len(self.label), np.int64), np.zeros(len(self.label), np.int64)
        for c in range(len(self.label)):
            if c:
                begin[c] = end[c - 1] + int((self.begin[c] - self.end[c - 1]).mean())
            end[c] = begin[c] + self.end[c, 0] - self.begin[c, 0]
        return Columns(["representative"], self.label, begin[:, None], end[:, None], self.weight[:, :1])


def _joined(a: Columns, b: Columns) -> Cells:
    i, j = np.nonzero(a.label[:, None] == b.label)
    label = a.label[i]
    both = lambda x, y: np.concatenate([x[i], y[j]], axis=1)
    begin, end, weight = both(a.begin, b.begin), both(a.end, b.end), both(a.weight, b.weight)
    order = np.lexsort((begin[:, -1], label, end[:, 0], begin[:, 0]))
    return Cells(begin[order], end[order], weight[order], label[order], np.stack([i, j], axis=1)[order])


def aligned_columns(a: Columns, b: Columns, n: int, method: str, w: Weights) -> list[tuple[float, Columns, np.ndarray]]:
    """The n best alignments of two lists: score, columns, running scores."""
    x, y = (a.representative(), b.representative()) if method == "representative" else (a, b)
    if method == "representative":
        x, y = (c if len(c.names) > 1 or c is not own else own for c, own in ((x, a), (y, b)))
        x, y = (own if len(own.names) == 1 else c for c, own in ((x, a), (y, b)))
    cells = _joined(x, y)
    wide = Cells(cells.begin, cells.end, cells.weight, cells.label, np.zeros_like(cells.begin))
    chains = chains_of(wide, w, bonus="chain", method="general" if method == "general" else "cross", split=x.begin.shape[1])
    out = []
    for score, path, running in best_chains(chains, n):
        i, j = cells.site[path].T
        left, right = a.taken(i), b.taken(j)
        merged = Columns(a.names + b.names, left.label, *(np.concatenate([getattr(left, f), getattr(right, f)], axis=1) for f in ("begin", "end", "weight")))
        out.append((score, merged, running))
    return out


_ROWS = "score double, alignment binary"


def _leaf(sites: DataFrame, name: str, labels: dict[tuple[str, str], int]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["begin", "end", "motif", "strand"], kind="stable")
        label = np.array([labels[k] for k in zip(own["motif"], own["strand"], strict=True)])
        columns = Columns([name], label, *(own[c].to_numpy()[:, None] for c in ("begin", "end", "score")))
        return pd.DataFrame({"score": [0.0], "alignment": [pickle.dumps((columns, np.zeros(len(own))))]})

    return sites.where(F.col("seq") == name).groupBy("seq").applyInPandas(run, _ROWS)


def align_tree(sites: DataFrame, tree: Node, method: str = "pairs", k: int = 100, weights: Weights = Weights()) -> dict[int, DataFrame]:
    """For each inner node's number, its k best alignments (score, alignment), best first."""
    keys = sorted((r["motif"], r["strand"]) for r in sites.select("motif", "strand").distinct().collect())  # motifs times strands
    labels = {key: i for i, key in enumerate(keys)}
    found: dict[int, DataFrame] = {}
    for node in tree.post_order():
        if node.name is not None:
            found[node.number] = stored(_leaf(sites, node.name, labels), "tree-leaf")
            continue
        left, right = node.children
        inner = (left.name is None) + (right.name is None)
        each = (k, math.ceil(math.sqrt(k)), 1)[inner]

        def run(batches: Iterator[pd.DataFrame], each=each) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for x, y in zip(pdf["a"], pdf["b"], strict=True):
                    for score, columns, running in aligned_columns(pickle.loads(x)[0], pickle.loads(y)[0], each, method, weights):
                        rows.append((score, pickle.dumps((columns, running))))
                yield pd.DataFrame(rows, columns=["score", "alignment"])

        a = found[left.number].select(F.lit(0).alias("key"), F.col("alignment").alias("a"))
        b = found[right.number].select(F.lit(0).alias("key"), F.col("alignment").alias("b"))
        pairs = a.join(F.broadcast(b), "key").select("a", "b").repartition(max(1, min(k, 64)))
        best = pairs.mapInPandas(run, _ROWS).orderBy(F.desc("score"), "alignment").limit(k)
        found[node.number] = stored(best, "tree-node")
    names = [{"label": i, "motif": m, "strand": s} for (m, s), i in labels.items()]
    return {n.number: _columns(found[n.number], names) for n in tree.post_order() if n.name is None}


_BY_COLUMN = ("label", "begin", "end", "weight", "running")
_CELLS = 1_000_000  # of a node worked on at once, unless two rows have more


@dataclass
class Listed:
    """A node's alignments, their columns one after another: row and score by alignment, the rest by column."""

    names: list[str]
    row: np.ndarray  # of each column, from 0
    label: np.ndarray
    begin: np.ndarray  # columns x sequences
    end: np.ndarray
    weight: np.ndarray
    running: np.ndarray
    score: np.ndarray

    def rows(self, low: int, high: int) -> "Listed":
        at = slice(*np.searchsorted(self.row, [low, high]))
        return Listed(self.names, self.row[at] - low, *(getattr(self, f)[at] for f in _BY_COLUMN), self.score[low:high])

    def and_(self, other: "Listed") -> "Listed":
        both = lambda f: np.concatenate([getattr(self, f), getattr(other, f)])
        return Listed(self.names, np.r_[self.row, other.row + len(self.score)], *(both(f) for f in _BY_COLUMN), both("score"))

    def best(self, k: int) -> "Listed":
        """The k best, in order; equal scores go by begins, ends and labels."""
        if not len(self.score):
            return self
        first = np.searchsorted(self.row, np.arange(len(self.score)))
        col = np.arange(len(self.row)) - first[self.row]
        keys = []
        for values in (self.begin, self.end, self.label[:, None]):
            flat = np.full((len(self.score), int(col.max()) + 1, values.shape[1]), np.iinfo(np.int64).min)
            flat[self.row, col] = values
            keys.append(flat.reshape(len(self.score), -1))
        best = np.lexsort((*np.concatenate(keys, axis=1).T[::-1], -self.score))[:k]
        count = np.diff(np.r_[first, len(self.row)])[best]
        at = np.repeat(first[best] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return Listed(self.names, np.repeat(np.arange(len(best)), count), *(getattr(self, f)[at] for f in _BY_COLUMN), self.score[best])

    def represented(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and weight as Columns.representative gives them; a leaf's own."""
        if len(self.names) == 1:
            return self.begin, self.end, self.weight
        size = self.end[:, 0] - self.begin[:, 0]
        inner = np.r_[False, self.row[1:] == self.row[:-1]][: len(self.row)]
        gap = np.zeros(len(size), np.int64)
        gap[1:] = np.where(inner[1:], np.trunc((self.begin[1:] - self.end[:-1]).mean(axis=1)), 0)
        end = np.cumsum(gap + size)
        head = np.maximum.accumulate(np.where(inner, 0, np.arange(len(size))))
        end -= (end - size - gap)[head]
        return (end - size)[:, None], end[:, None], self.weight[:, :1]


def _nodes_best(a: Listed, b: Listed, each: int, k: int, method: str, w: Weights) -> Listed:
    """The k best of the alignments that every pair of rows of a and b gives, `each` of a pair; many pairs at once."""
    order = np.argsort(b.label, kind="stable")
    low, high = (np.searchsorted(b.label[order], a.label, side) for side in ("left", "right"))
    count = high - low
    if count.sum() > _CELLS and max(len(a.score), len(b.score)) > 1:
        (na, ha), (nb, hb) = ((len(c.score), max(1, len(c.score) // 2)) for c in (a, b))
        parts = [(a.rows(0, ha), b), (a.rows(ha, na), b)] if na > 1 else [(a, b.rows(0, hb)), (a, b.rows(hb, nb))]
        one, two = (_nodes_best(*part, each, k, method, w) for part in parts)
        return one.and_(two).best(k)
    (x, y), names = (((c.represented() if method == "representative" else (c.begin, c.end, c.weight)) for c in (a, b))), a.names + b.names
    i = np.repeat(np.arange(len(a.label)), count)
    j = order[np.arange(len(i)) + np.repeat(low - (np.cumsum(count) - count), count)]
    begin, end, weight = (np.concatenate([p[i], q[j]], axis=1) for p, q in zip(x, y, strict=True))
    label, pair = a.label[i], a.row[i] * (len(b.score) or 1) + b.row[j]
    order = np.lexsort((begin[:, -1], label, end[:, 0], begin[:, 0], pair))
    i, j, begin, end, weight, label, pair = (v[order] for v in (i, j, begin, end, weight, label, pair))
    starts = np.flatnonzero(np.r_[True, np.diff(pair) != 0][: len(pair)])
    parts = []
    if len(pair):
        d = begin.shape[1]
        shift = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pair)])) * int(end[:, 0].max() - begin[:, 0].min() + 2 * REACH) - int(begin[:, 0].min())
        base = w.lam * (d - 1) * weight.sum(axis=1)
        apart = Cells(np.c_[begin[:, 0] + shift, begin[:, 1:]], np.c_[end[:, 0] + shift, end[:, 1:]], weight, label, np.zeros_like(begin))
        steps = Steps(*step_lists(apart, w, "general" if method == "general" else "cross", x[0].shape[1]))
        before = 0
        for score, which, path, of, running in chains_by_part(base, steps, starts, each):
            parts.append((score, path, np.searchsorted(which, of) + before, running))
            before += len(score)
    if not parts:
        none, wide = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64)
        return Listed(names, none, none, wide, wide, wide.astype(float), none.astype(float), none.astype(float))
    score, path, of, running = (np.concatenate(v) for v in zip(*parts, strict=True))
    least = -np.partition(-score, k - 1)[k - 1] if len(score) > k else -np.inf
    keep = np.flatnonzero(score >= least)
    place = np.full(len(score), -1)
    place[keep] = np.arange(len(keep))
    own = place[of] >= 0
    path, of, running = path[own], place[of[own]], running[own]
    order = np.lexsort((path, of))
    path, of, running = path[order], of[order], running[order]
    left, right = i[path], j[path]
    columns = [a.label[left], *(np.concatenate([getattr(a, f)[left], getattr(b, f)[right]], axis=1) for f in ("begin", "end", "weight"))]
    return Listed(names, of, *columns, running, score[keep]).best(k)


def tree_frame(sites: pd.DataFrame, tree: Node, names: dict[str, str], n: int, method: str, k: int, w: Weights) -> pd.DataFrame:
    """The n best modules at the root, as align_tree finds them. names: the sequence of each leaf."""
    kinds = list(zip(sites["motif"], sites["strand"], strict=True))
    keys = sorted(set(kinds))
    labels = {key: i for i, key in enumerate(keys)}
    label = np.array([labels[key] for key in kinds], np.int64)
    begin, end, weight = (sites[c].to_numpy(t) for c, t in (("begin", np.int64), ("end", np.int64), ("score", np.float64)))
    seq = sites["seq"].to_numpy()
    found: dict[int, Listed] = {}
    for node in tree.post_order():
        if node.name is not None:
            own = np.flatnonzero(seq == names.get(node.name))
            own = own[np.lexsort((label[own], end[own], begin[own]))]
            found[node.number] = Listed([names.get(node.name, "")], np.zeros(len(own), np.int64), label[own], *(v[own][:, None] for v in (begin, end, weight)), np.zeros(len(own)), np.zeros(1))
            continue
        left, right = (found.pop(c.number) for c in node.children)
        each = (k, math.ceil(math.sqrt(k)), 1)[sum(c.name is None for c in node.children)]
        found[node.number] = _nodes_best(left, right, each, k, method, w)
    c, out = found[tree.number], []
    for col in range(int(np.searchsorted(c.row, n))):
        new = not col or c.row[col] != c.row[col - 1]
        nth = 0 if new else nth + 1
        motif, strand = keys[c.label[col]]
        delta = c.running[col] - (0.0 if new else c.running[col - 1])
        for i, name in enumerate(c.names):
            out.append((int(c.row[col]) + 1, nth, name, motif, strand, int(c.begin[col, i]), int(c.end[col, i]), float(c.weight[col, i]), float(c.running[col]), float(delta), float(c.score[c.row[col]])))
    return pd.DataFrame(out, columns=[x.split()[0] for x in schemas.COLUMNS.split(", ")])


def align_tree_groups(sites: DataFrame, groups: DataFrame, tree: Node, n: int = 3, method: str = "pairs", k: int = 100, weights: Weights = Weights()) -> DataFrame:
    """group and columns of the n best modules at the root, for many groups of few sequences: a task works a group's whole tree.

    groups: group, seq, nth; the leaves' names are the sequences' places (nth) in their group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {str(i): s for i, s in pdf[["nth", "seq"]].drop_duplicates().itertuples(index=False)}
        out = tree_frame(pdf, tree, names, n, method, k, weights)
        out.insert(0, "group", pdf["group"].iloc[0])
        return out

    own = sites.select("seq", "motif", "begin", "end", "score", "strand").join(groups, "seq")
    tasks = max(64, int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return own.repartition(tasks, "group").groupBy("group").applyInPandas(run, f"group string, {schemas.COLUMNS}")


def _columns(rows: DataFrame, names: list[dict]) -> DataFrame:
    """The alignments of a node as columns, modules by rank."""
    ranked = rows.withColumn("module", F.row_number().over(Window.orderBy(F.desc("score"), "alignment")))  # k rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for module, score, blob in zip(pdf["module"], pdf["score"], pdf["alignment"], strict=True):
                c, running = pickle.loads(blob)
                for col in range(len(c.label)):
                    key = names[c.label[col]]
                    delta = running[col] - (running[col - 1] if col else 0.0)
                    for i, seq in enumerate(c.names):
                        out.append((module, col, seq, key["motif"], key["strand"], int(c.begin[col, i]), int(c.end[col, i]), float(c.weight[col, i]), float(running[col]), float(delta), score))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schemas.COLUMNS.split(", ")])

    return ranked.mapInPandas(run, schemas.COLUMNS)


def node_alignments(found: dict[int, DataFrame], node: int, n: int = 3) -> DataFrame:
    """The n best modules of an inner node."""
    if node not in found:
        raise ValueError(f"no inner node {node}")
    return found[node].where(F.col("module") <= n)


def align_tree_root(spark: SparkSession, sites: DataFrame, tree: Node, n: int = 3, **how) -> DataFrame:
    return node_alignments(align_tree(sites, tree, **how), tree.number, n)
