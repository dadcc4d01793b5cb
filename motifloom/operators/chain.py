"""Local chain alignment of the sites of two or more sequences.

A cell is one site of each sequence, all of one motif and strand. A chain's score
is the bonus of its cells less the penalties of its steps; a cell starts afresh
unless a step into it is worth more than nothing. The best chain is reported, its
cells taken away, and the scores that hung on them worked out again, for as many
chains as are asked for. The unit of work is a group of sequences; dense groups
are one sequential pass over the cells, whose steps are found by band joins in
numpy. Groups whose cells fall apart into islands with no step between them can
be worked on island by island, many at a time (align_pairs, align_next).

Of equal scores the first cell in order of begin, end, motif, strand stands.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.penalty import Weights, folded_angle, general_penalty, step_penalty
from .sites import REACH

_CHUNK = 2_000_000
_ISLANDS = 200_000  # cells worked on at once, if islands are no larger


@dataclass
class Cells:
    """n cells of d sequences. -1 as begin and end: the cell has no site in that sequence."""

    begin: np.ndarray  # n x d
    end: np.ndarray
    weight: np.ndarray
    label: np.ndarray  # of motif and strand
    site: np.ndarray  # places of the sites in their sequences' lists


@dataclass
class Chains:
    """Cells with the steps between them, and what is left of them."""

    cells: Cells
    base: np.ndarray
    first: np.ndarray  # steps into cell c: first[c] to first[c + 1]
    source: np.ndarray
    cost: np.ndarray
    score: np.ndarray = field(init=False)
    back: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.base)
        self.score, self.back = np.full(n, -np.inf), np.full(n, -1)
        self.alive = np.ones(n, bool)
        order = np.argsort(self.source, kind="stable")
        self._into = np.repeat(np.arange(n), np.diff(self.first))[order]
        self._out = np.searchsorted(self.source[order], np.arange(n + 1))
        for c in range(n):
            self._solve(c)

    def _solve(self, c: int) -> None:
        a, b = self.first[c], self.first[c + 1]
        self.score[c], self.back[c] = self.base[c], -1
        if a < b:
            worth = self.score[self.source[a:b]] - self.cost[a:b]
            k = int(worth.argmax())
            if worth[k] > 0:
                self.score[c], self.back[c] = self.base[c] + worth[k], self.source[a + k]

    def path(self, c: int) -> list[int]:
        out = [c]
        while self.back[out[-1]] >= 0:
            out.append(int(self.back[out[-1]]))
        return out[::-1]

    def pop(self) -> tuple[float, list[int], np.ndarray] | None:
        """The best chain's score, cells and running scores; its cells are then gone."""
        if not self.alive.any():
            return None
        c = int(self.score.argmax())
        if not self.score[c] > 0:
            return None
        path = self.path(c)
        running = self.score[path].copy()
        self.remove(path)
        return float(running[-1]), path, running

    def remove(self, path: Iterable[int]) -> None:
        gone = list(path)
        self.alive[gone] = False
        self.score[gone] = -np.inf
        todo: list[int] = []
        waiting = set()

        def touch(c: int) -> None:
            for d in self._into[self._out[c] : self._out[c + 1]]:
                d = int(d)
                if self.alive[d] and self.back[d] == c and d not in waiting:
                    waiting.add(d)
                    heapq.heappush(todo, d)

        for c in gone:
            touch(c)
        while todo:
            c = heapq.heappop(todo)
            waiting.discard(c)
            old = self.score[c]
            self._solve(c)
            if self.score[c] != old:
                touch(c)


def settle(base: np.ndarray, steps: Steps, score: np.ndarray, back: np.ndarray, active: np.ndarray) -> None:
    """Works out the scores of the cells in active, and of all that hang on those that change, many at a time.

    base is -inf for a cell that is taken away. The results are those of Chains, to the last bit.
    """
    while len(active):
        count = steps.first[active + 1] - steps.first[active]
        from_ = np.cumsum(count) - count
        at = np.arange(int(count.sum())) + np.repeat(steps.first[active] - from_, count)
        worth = score[steps.source[at]] - steps.cost[at]
        best = np.maximum.reduceat(worth, from_)
        hit = np.flatnonzero(worth == np.repeat(best, count))
        source = steps.source[at[hit[np.searchsorted(hit, from_)]]]
        new = np.where(best > 0, base[active] + np.where(best > 0, best, 0), base[active])
        back[active] = np.where(best > 0, source, -1)
        moved = np.zeros(len(base), bool)
        moved[active] = new != score[active]
        score[active] = new
        active = steps.after(moved)


@dataclass
class Steps:
    """first, source and cost of step_lists, with the cells that they lead to."""

    first: np.ndarray
    source: np.ndarray
    cost: np.ndarray

    def __post_init__(self) -> None:
        self.target = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def after(self, moved: np.ndarray) -> np.ndarray:
        """The cells with a step from one of moved, in order."""
        reached = np.zeros(len(moved), bool)
        reached[self.target[moved[self.source]]] = True
        return np.flatnonzero(reached)

    def reached(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.first))


def chains_by_part(base: np.ndarray, steps: Steps, starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The n best chains of each part, a round a chain: score, part, and cells and parts of the paths, from their ends.

    A part is a run of cells from one of starts up to the next, without steps to others.
    """
    base = base.copy()
    score, back = base.copy(), np.full(len(base), -1)
    part = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(base)]))
    settle(base, steps, score, back, steps.reached())
    for _ in range(n):
        best = np.maximum.reduceat(score, starts)
        hit = np.flatnonzero(score == best[part])
        head = hit[np.searchsorted(hit, starts)]
        which = np.flatnonzero(best > 0)
        if not len(which):
            return
        cells, parts, at, of = [], [], head[which], which
        while len(at):
            cells.append(at)
            parts.append(of)
            at = back[at]
            at, of = at[at >= 0], of[at >= 0]
        path, of = np.concatenate(cells), np.concatenate(parts)
        yield best[which], which, path, of, score[path]
        base[path] = score[path] = -np.inf
        gone = np.zeros(len(base), bool)
        gone[path] = True
        settle(base, steps, score, back, steps.after(gone))


def cells_of(sequences: list[pd.DataFrame], gap_limit: int = 0) -> Cells:
    """The cells of site lists (begin, end, weight, label), each in order.

    With a gap limit a cell may lack a site in so many sequences.
    """
    d = len(sequences)
    by_label = [{k: g.index.to_numpy() for k, g in s.groupby("label", sort=False)} for s in sequences]
    labels = sorted({k for g in by_label for k in g})
    parts, names = [], []
    for label in labels:
        have = [i for i in range(d) if label in by_label[i]]
        if len(have) < max(2, d - gap_limit):
            continue
        for chosen in (c for size in range(max(2, d - gap_limit), len(have) + 1) for c in combinations(have, size)):
            lists = [by_label[i][label] if i in chosen else np.array([-1]) for i in range(d)]
            grid = np.stack([g.ravel() for g in np.meshgrid(*lists, indexing="ij")], axis=1)
            parts.append(grid)
            names.append(np.full(len(grid), label))
    site = np.concatenate(parts) if parts else np.zeros((0, d), np.int64)
    label = np.concatenate(names) if names else np.zeros(0, np.int64)

    def values(column: str, missing: float) -> np.ndarray:
        return np.stack([np.where(site[:, i] >= 0, s[column].to_numpy()[site[:, i]] if len(s) else missing, missing) for i, s in enumerate(sequences)], axis=1)

    begin, end, weight = values("begin", -1).astype(np.int64), values("end", -1).astype(np.int64), values("weight", 0.0)
    present = site >= 0
    lead = np.where(present, begin, np.iinfo(np.int64).max)
    keys = [begin[:, i] for i in range(d - 1, 0, -1)]
    order = np.lexsort((*keys, label, np.where(present, end, 0).max(axis=1), lead[:, 0], lead.min(axis=1))) if gap_limit else np.lexsort((*keys, label, end[:, 0], begin[:, 0]))
    return Cells(begin[order], end[order], weight[order], label[order], site[order])


def _near(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, target) of the steps that two sequences allow. begin, end: n x 2.

    A source ends in the bucket of REACH letters that the target begins in, or in the one before; inside a bucket
    sources are in order of their end in the second sequence, so a target's are one run of each bucket.
    """
    n = len(begin)
    width = int(max(end.max(initial=0), 0)) + 2 * REACH
    key = end[:, 0] // REACH * width + np.maximum(end[:, 1], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    sources, targets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bucket = begin[:, 0] // REACH
    for shift in (-1, 0):
        low = np.searchsorted(sorted_key, (bucket + shift) * width + np.maximum(begin[:, 1] - REACH + 1, 0), "left")
        high = np.searchsorted(sorted_key, (bucket + shift) * width + np.maximum(begin[:, 1], 0), "left")
        count = np.maximum(high - low, 0)
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(np.cumsum(count) // _CHUNK)) + 1, n])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            target = np.repeat(np.arange(a, b), count[a:b])
            place = np.arange(len(target)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            source = order[low[target] + place]
            gap = begin[target] - end[source]
            ok = ((gap > 0) & (gap < REACH)).all(axis=1)
            sources.append(source[ok])
            targets.append(target[ok])
    return np.concatenate(sources), np.concatenate(targets)


def _lists(n: int, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    return np.searchsorted(target, np.arange(n + 1)), source, target


def step_lists(cells: Cells, w: Weights, method: str = "pairs", split: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps into each cell, as first, source and cost.

    method pairs: penalties summed over all pairs of sequences; cross: over those with one on each side of split;
    general: one penalty about the mean gap.
    """
    n, d = cells.begin.shape
    if n < 2:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ends = [0, min(1, d - 1)]
    source, target = _near(cells.begin[:, ends], cells.end[:, ends])
    gap = cells.begin[target] - cells.end[source]
    ok = ((gap > 0) & (gap < REACH)).all(axis=1)
    first, source, target = _lists(n, source[ok], target[ok])
    return first, source, step_costs(cells.begin[target] - cells.end[source] - 1, w, method, split)


def step_costs(gaps: np.ndarray, w: Weights, method: str, split: int | None) -> np.ndarray:
    d = gaps.shape[1]
    if method == "general":
        return general_penalty(gaps.astype(float), w)
    pairs = combinations(range(d), 2) if method == "pairs" else product(range(split or 1), range(split or 1, d))
    out = np.zeros(len(gaps))
    for k, m in pairs:
        out += step_penalty(gaps[:, k], gaps[:, m], w)
    return out


def gapped_step_lists(cells: Cells, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps between cells that may lack sites: both have sites in two sequences at least; penalties over the pairs that both have."""
    n, d = cells.begin.shape
    present = cells.site >= 0
    edges = [np.zeros(0, np.int64)]
    for k, m in combinations(range(d), 2):
        own = np.flatnonzero(present[:, k] & present[:, m])
        source, target = _near(cells.begin[own][:, [k, m]], cells.end[own][:, [k, m]])
        edges.append(own[source] * n + own[target])
    source, target = np.divmod(np.unique(np.concatenate(edges)), max(n, 1))
    both = present[source] & present[target]
    gap = cells.begin[target] - cells.end[source]
    ok = (~both | (gap > 0) & (gap < REACH)).all(axis=1) & (source < target)
    first, source, target = _lists(n, source[ok], target[ok])
    both, gap = present[source] & present[target], cells.begin[target] - cells.end[source] - 1
    cost = np.zeros(len(source))
    for k, m in combinations(range(d), 2):
        use = both[:, k] & both[:, m]
        cost[use] += step_penalty(gap[use, k], gap[use, m], w)
    return first, source, cost


def chains_of(cells: Cells, w: Weights, bonus: str = "pairs", method: str = "pairs", split: int | None = None, gaps: bool = False) -> Chains:
    """bonus pairs: every site counts once for each pair of sequences; chain: once for each other sequence."""
    n_sites = (cells.site >= 0).sum(axis=1)
    factor = n_sites * (n_sites - 1) / 2 if bonus == "pairs" else n_sites - 1
    base = w.lam * factor * cells.weight.sum(axis=1)
    lists = gapped_step_lists(cells, w) if gaps else step_lists(cells, w, method, split)
    return Chains(cells, base, *lists)


def best_chains(chains: Chains, n: int, down_to: float | None = None, keep_scores: bool = False) -> list[tuple[float, list[int], np.ndarray]]:
    """The n best chains; with down_to, as many as score above it and one more.

    keep_scores takes further chains from the same scores, without working them out again: from the best cells whose
    chains share no cell with one already taken.
    """
    out = []
    if keep_scores:
        used = np.zeros(len(chains.base), bool)
        for c in np.argsort(-chains.score, kind="stable"):
            if len(out) >= n or not chains.score[c] > 0:
                break
            path = chains.path(int(c))
            if not used[path].any():
                used[path] = True
                out.append((float(chains.score[c]), path, chains.score[path].copy()))
        return out
    while (len(out) < n if down_to is None else not out or out[-1][0] > down_to) and (got := chains.pop()) is not None:
        out.append(got)
    return out


def _listed(sites: pd.DataFrame, labels: dict) -> pd.DataFrame:
    own = sites.sort_values(["begin", "end", "motif", "strand"], kind="stable").reset_index(drop=True)
    own["label"] = [labels[k] for k in zip(own["motif"], own["strand"], strict=True)]
    return own.rename(columns={"score": "weight"})


def aligned_frame(sites: pd.DataFrame, names: list[str], n: int, w: Weights, bonus: str = "pairs", gap_limit: int = 0, down_to: float | None = None, keep_scores: bool = False) -> pd.DataFrame:
    """Columns of the best modules of the named sequences. sites: seq, motif, begin, end, score, strand."""
    keys = sorted(set(zip(sites["motif"], sites["strand"], strict=True)))
    labels = {k: i for i, k in enumerate(keys)}
    lists = [_listed(sites[sites["seq"] == s], labels) for s in names]
    cells = cells_of(lists, gap_limit)
    chains = chains_of(cells, w, bonus, gaps=gap_limit > 0)
    rows = []
    for module, (score, path, running) in enumerate(best_chains(chains, n, down_to, keep_scores), 1):
        before = 0.0
        for col, (c, upto) in enumerate(zip(path, running, strict=True)):
            motif, strand = keys[cells.label[c]]
            for i, name in enumerate(names):
                if cells.site[c, i] >= 0:
                    rows.append((module, col, name, motif, strand, int(cells.begin[c, i]), int(cells.end[c, i]), float(cells.weight[c, i]), float(upto), float(upto - before), score))
            before = upto
    return pd.DataFrame(rows, columns=["module", "col", "seq", "motif", "strand", "begin", "end", "weight", "cum_score", "delta", "module_score"])


_SITE = ("seq", "motif", "begin", "end", "score", "strand")


def align_groups(sites: DataFrame, groups: DataFrame, n: int = 3, weights: Weights = Weights(), **how) -> DataFrame:
    """Columns of the n best modules of each group. groups: group, seq, nth (one row a sequence of a group, in order)."""
    return _aligned(sites.select(*_SITE).join(groups, "seq"), n, weights, **how)


def _aligned(grouped: DataFrame, n: int, weights: Weights, **how) -> DataFrame:
    schema = f"group string, {schemas.COLUMNS}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf[["nth", "seq"]].drop_duplicates().sort_values("nth")["seq"].tolist()
        out = aligned_frame(pdf, names, n, weights, **how)
        out.insert(0, "group", pdf["group"].iloc[0])
        return out

    return grouped.groupBy("group").applyInPandas(run, schema)


def groups_of(sites: DataFrame, names: list[str], group: str = "all") -> DataFrame:
    return sites.sparkSession.createDataFrame([(group, s, i) for i, s in enumerate(names)], "group string, seq string, nth int")


def align(sites: DataFrame, names: list[str], n: int = 3, weights: Weights = Weights(), **how) -> DataFrame:
    """Columns of the n best modules of the named sequences: two or more, every site of a column counted for each pair."""
    return align_groups(sites, groups_of(sites, names), n, weights, **how).drop("group")


def align_short(sites: DataFrame, names: list[str], gap_limit: int = 0, n: int = 3, weights: Weights = Weights()) -> DataFrame:
    """As align, every site counted once for each other sequence; columns may lack sites of gap_limit sequences."""
    return align(sites, names, n, weights, bonus="chain", gap_limit=gap_limit)


def packed_pairs(grouped: DataFrame, by: list[str]) -> DataFrame:
    """by and packed: the steps between the cells of many pairs, for best_scores. grouped: by, nth (0 or 1) and sites.

    A cell without a step counts only as its pair's best one; pairs without a cell have no place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, by, _ISLANDS // 8):
            pair = _runs(*(table[c] for c in by))
            heads = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
            named = [table[c].combine_chunks().take(pa.array(heads)) for c in by]
            for own in pair_cells(pair, _numbers(table, "nth"), _labels(table)[0], _numbers(table, "begin"), _numbers(table, "end"), _numbers(table, "score", np.float64)):
                if not len(own.pair):
                    continue
                cells, _ = own.apart()
                first, source, _ = step_lists(cells, Weights())
                target = np.repeat(np.arange(len(own.pair)), np.diff(first))
                gaps = (cells.begin[target] - cells.end[source] - 1).astype(np.int16)  # below REACH
                starts = np.flatnonzero(np.r_[True, np.diff(own.pair) != 0])
                group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(own.pair)]))
                total = own.weight.sum(axis=1)
                used = np.unique(np.r_[source, target])
                packed = (np.maximum.reduceat(total, starts), group[used].astype(np.int32), total[used], *(np.searchsorted(used, v).astype(np.int32) for v in (source, target)), gaps)
                names = [pa.array([x.take(pa.array(own.pair[starts])).to_pylist()], pa.list_(pa.string())) for x in named]
                yield pa.RecordBatch.from_arrays([*names, pa.array([pickle.dumps(packed)], pa.binary())], names=[*by, "packed"])

    own = grouped.select(*by, "nth", *_SITE).where("motif is not null and strand is not null")
    return _dealt(own, by).mapInArrow(run, ", ".join(f"{c} array<string>" for c in by) + ", packed binary")


def best_scores(packed: DataFrame, weights: Weights) -> DataFrame:
    """packed's pairs with the score of the best module."""
    by = [c for c in packed.columns if c != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column("packed")):
                names = [batch.column(c)[i].values for c in by]
                yield pa.RecordBatch.from_arrays([*names, pa.array(_best_scores(*pickle.loads(blob.as_py()), weights))], names=[*by, "score"])

    return packed.mapInArrow(run, ", ".join(f"{c} string" for c in by) + ", score double")


def _best_scores(single: np.ndarray, group: np.ndarray, total: np.ndarray, source: np.ndarray, target: np.ndarray, gaps: np.ndarray, w: Weights) -> np.ndarray:
    best = np.maximum(0.0, w.lam * 1.0 * single)
    if len(total):
        x, y = gaps.astype(np.int64).T
        s, off = x + y, x - y
        bent = w.nu * (off**2).astype(float) + w.xi * (folded_angle(np.arange(REACH), w.rotation) ** 2)[np.abs(off)]
        cost = np.where(s > 0, w.mu * s / 2 + bent / np.maximum(s, 1), 0.0)  # step_penalty of few different gaps
        base = w.lam * 1.0 * total
        score = base.copy()
        steps = Steps(np.searchsorted(target, np.arange(len(total) + 1)), source, cost)
        settle(base, steps, score, np.full(len(base), -1), steps.reached())
        heads = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        best[group[heads]] = np.maximum(best[group[heads]], np.maximum.reduceat(score, heads))
    return best


def align_near_pairs(sites: DataFrame, modules: DataFrame, names: list[str], gap_limit: int = 0, n: int = 1, buffer: int = 1000, weights: Weights = Weights()) -> DataFrame:
    """align_short on the sites within buffer of a pairwise module. modules: seq, begin, end."""
    return align_groups_near_pairs(sites, modules.withColumn("group", F.lit("all")), groups_of(sites, names), gap_limit, n, buffer, weights).drop("group")


def align_groups_near_pairs(sites: DataFrame, modules: DataFrame, groups: DataFrame, gap_limit: int = 0, n: int = 1, buffer: int = 1000, weights: Weights = Weights()) -> DataFrame:
    """For each group, the alignment of its sites within buffer of one of its pairwise modules. modules: group, seq, begin, end."""
    near = modules.select(F.col("group").alias("g_"), F.col("seq").alias("m_"), (F.col("begin") - buffer).alias("low_"), (F.col("end") + buffer).alias("high_"))
    inside = (F.col("group") == F.col("g_")) & (F.col("seq") == F.col("m_")) & (F.col("begin") >= F.col("low_")) & (F.col("end") <= F.col("high_"))
    grouped = sites.select(*_SITE).join(groups, "seq").join(near, inside, "left_semi")
    return _aligned(grouped, n, weights, bonus="chain", gap_limit=gap_limit)


def islands(cells: DataFrame) -> DataFrame:
    """cells with island: cells of different islands of a pair have no step between them."""
    order = Window.partitionBy("seq_x", "seq_y").orderBy("begin_x", "end_x", "begin_y", "motif", "strand")
    reach = F.max("end_x").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("begin_x") - reach >= REACH)).cast("int")
    return cells.withColumn("new_", new).withColumn("island", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new_")


_PAIRS = "seq_x string, seq_y string, score double, col int, motif string, strand string, begin_x int, end_x int, begin_y int, end_y int, weight_x double, weight_y double, cum_score double, rank int"


@dataclass
class PairCells:
    """Cells of many pairs of sequences, pair by pair, in order of begin, end, motif and strand."""

    pair: np.ndarray
    begin: np.ndarray  # n x 2
    end: np.ndarray
    weight: np.ndarray
    label: np.ndarray

    def apart(self) -> tuple[Cells, np.ndarray]:
        """As cells of one pair, in which no step leads from one pair to another; and where islands start."""
        begin, end = self.begin.copy(), self.end.copy()
        if len(begin):
            low, high = int(begin[:, 0].min()), int(end[:, 0].max())
            shift = self.pair * (high - low + 2 * REACH) - low
            begin[:, 0] += shift
            end[:, 0] += shift
        cells = Cells(begin, end, self.weight, self.label, np.zeros(begin.shape, np.int64))
        return cells, np.flatnonzero(np.r_[True, begin[1:, 0] - np.maximum.accumulate(end[:, 0])[:-1] >= REACH][: len(begin)])

    def taken(self, at: slice) -> PairCells:
        return PairCells(*(getattr(self, f)[at] for f in ("pair", "begin", "end", "weight", "label")))


def best_of_pairs(own: PairCells, n: int, w: Weights) -> tuple[np.ndarray, ...]:
    """For the n best modules of every pair, column by column: cell, rank, column, running score, module's score.

    A path takes cells of one island only, so the best of a pair are the best of its islands' best; equal scores go by
    where they begin.
    """
    cells, starts = own.apart()
    found = []
    cuts = [0]
    for i in range(1, len(starts)):
        if starts[i] - starts[cuts[-1]] > _ISLANDS:
            cuts.append(i)
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        if a == b:
            break
        at = slice(starts[a], starts[b] if b < len(starts) else len(cells.begin))
        some = Cells(*(getattr(cells, f)[at] for f in ("begin", "end", "weight", "label", "site")))
        base = w.lam * 1.0 * some.weight.sum(axis=1)
        for nth, (score, which, path, of, running) in enumerate(chains_by_part(base, Steps(*step_lists(some, w)), starts[a:b] - starts[a], n)):
            start = np.full(b - a, len(base))
            np.minimum.at(start, of, path)
            module = np.full(b - a, -1.0)
            module[which] = score
            found.append((path + at.start, of + a, np.full(len(path), nth), module[of], running, start[of] + at.start))
    if not found:
        return *(np.zeros(0, np.int64),) * 3, *(np.zeros(0),) * 2
    cell, island, nth, score, running, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((cell, nth, island, own.begin[start, 0], -score, own.pair[cell]))
    cell, island, nth, score, running = (x[order] for x in (cell, island, nth, score, running))
    pair = own.pair[cell]
    new = np.r_[True, (np.diff(pair) != 0) | (np.diff(island) != 0) | (np.diff(nth) != 0)]
    module = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    first = np.r_[True, np.diff(pair[heads]) != 0]
    rank = module - np.maximum.accumulate(np.where(first, np.arange(len(heads)), 0))[module] + 1
    keep = rank <= n
    return cell[keep], rank[keep], (np.arange(len(cell)) - heads[module])[keep], running[keep], score[keep]


def _whole(batches: Iterator[pa.RecordBatch], by: list[str], least: int) -> Iterator[pa.Table]:
    """Batches in order of by put together to tables of so many rows or more that part no group."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table[c][rows - 1].as_py() for c in by]
        same = np.ones(rows, bool)
        for c, value in zip(by, last, strict=True):
            same &= pc.equal(table[c], value).to_numpy(zero_copy_only=False)
        whole = rows - int(same.sum())
        if whole:
            yield table.slice(0, whole)
            held = table.slice(whole).combine_chunks().to_batches()
            rows -= whole
    if rows:
        yield pa.Table.from_batches(held)


def _labels(table: pa.Table) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Numbers of the rows' motifs and strands, in order, and what they stand for."""
    motif, strand = (table[c].combine_chunks().dictionary_encode() for c in ("motif", "strand"))
    names = [(m, s) for m in motif.dictionary.to_pylist() for s in strand.dictionary.to_pylist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    both = motif.indices.to_numpy().astype(np.int64) * len(strand.dictionary) + strand.indices.to_numpy()
    return place[both], [names[i] for i in order]


def _numbers(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table[name].to_numpy().astype(kind)


def pair_cells(pair: np.ndarray, nth: np.ndarray, label: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> Iterator[PairCells]:
    """The cells of pairs' sites (nth 0 and 1: the side), as many pairs at a time as have about _ISLANDS of them."""
    if not len(pair):
        return
    order = np.lexsort((weight, label, end, begin, pair))
    pair, nth, label, begin, end, weight = (v[order] for v in (pair, nth, label, begin, end, weight))
    x, y = (np.flatnonzero(nth == i) for i in (0, 1))
    key = pair * (int(label.max()) + 1) + label
    y = y[np.argsort(key[y], kind="stable")]
    low = np.searchsorted(key[y], key[x], "left")
    count = np.searchsorted(key[y], key[x], "right") - low
    upto = np.cumsum(count)
    last = np.flatnonzero(np.r_[np.diff(pair[x]) != 0, True][: len(x)])  # of each pair
    a = 0
    while a < len(x):
        begun = int(upto[a - 1]) if a else 0
        ends = last[last >= a]
        b = int(ends[max(0, int(np.searchsorted(upto[ends], begun + _ISLANDS, "right")) - 1)]) + 1
        i = np.repeat(x[a:b], count[a:b])
        j = y[np.arange(len(i)) + np.repeat(low[a:b] - (upto[a:b] - count[a:b] - begun), count[a:b])]
        yield PairCells(pair[i], np.stack([begin[i], begin[j]], axis=1), np.stack([end[i], end[j]], axis=1), np.stack([weight[i], weight[j]], axis=1), label[i])
        a = b


def _modules(own: PairCells, names: list[tuple[str, str]], x: pa.Array, y: pa.Array, n: int, w: Weights) -> pa.RecordBatch:
    """The pairs' best modules as rows of _PAIRS. x, y: the names of the pairs' sequences by pair."""
    cell, rank, col, running, score = best_of_pairs(own, n, w)
    label, pair = own.label[cell], own.pair[cell]
    motif, strand = (pa.array([k[i] for k in names], pa.string()).take(pa.array(label)) for i in (0, 1))
    whole = lambda v: pa.array(v, pa.int32())
    values = [x.take(pa.array(pair)), y.take(pa.array(pair)), pa.array(score), whole(col), motif, strand, *(whole(v[cell, i]) for i in (0, 1) for v in (own.begin, own.end)), *(pa.array(own.weight[cell, i]) for i in (0, 1)), pa.array(running), whole(rank)]
    return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in _PAIRS.split(", ")])


def _runs(*columns: pa.ChunkedArray) -> np.ndarray:
    """Numbers, from 0, of the runs of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        codes = c.combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= np.diff(codes) != 0
    return np.cumsum(new)


def align_pairs(cells: DataFrame, n: int = 3, weights: Weights = Weights()) -> DataFrame:
    """seq_x, seq_y, rank and columns of the n best modules of every pair in cells."""
    by = ["seq_x", "seq_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, by, _ISLANDS):
            label, names = _labels(table)
            pair = _runs(*(table[c] for c in by))
            two = lambda c, kind=np.int64, t=table: np.stack([_numbers(t, f"{c}_{s}", kind) for s in "xy"], axis=1)
            own = PairCells(pair, two("begin"), two("end"), two("weight", np.float64), label)
            order = np.lexsort((*own.weight.T, own.end[:, 1], own.begin[:, 1], label, own.end[:, 0], own.begin[:, 0], pair))
            heads = pa.array(np.flatnonzero(np.r_[True, np.diff(pair) != 0]))
            yield _modules(own.taken(order), names, *(table[c].combine_chunks().take(heads) for c in by), n, weights)

    return _dealt(cells, by).mapInArrow(run, _PAIRS)


def align_next(sites: DataFrame, n: int = 3, weights: Weights = Weights()) -> DataFrame:
    """As align_pairs, of every sequence with the one of the next number; the cells are made where they are worked on."""
    own = sites.select(*_SITE).where("motif is not null and strand is not null")
    number = F.col("seq").try_cast("long")
    sides = F.array(*(F.struct((number - i).alias("pair"), F.lit(i).alias("nth")) for i in (0, 1)))
    grouped = own.withColumn("side", F.explode(sides)).select("side.*", *_SITE).where("pair is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, ["pair"], _ISLANDS // 8):
            label, names = _labels(table)
            nth, pair = _numbers(table, "nth"), _runs(table["pair"])
            seq = table["seq"].combine_chunks()
            named = []
            for i in (0, 1):
                place = np.full(int(pair.max()) + 1, 0)
                place[pair[nth == i]] = np.flatnonzero(nth == i)
                named.append(seq.take(pa.array(place)))
            for cells in pair_cells(pair, nth, label, _numbers(table, "begin"), _numbers(table, "end"), _numbers(table, "score", np.float64)):
                yield _modules(cells, names, *named, n, weights)

    return _dealt(grouped, ["pair"]).mapInArrow(run, _PAIRS)


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in order of by, groups whole, over as many tasks as the session shuffles to, or 64."""
    tasks = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return rows.repartition(tasks, *by).sortWithinPartitions(*by)
