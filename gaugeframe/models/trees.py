"""Boosted regression trees of any number of settings, grown side by side from merged histograms.

Inputs are cut into bins once and stored. A level of a tree is then one pass over the training rows for all
settings: tasks sum up, by node, input and bin, what the earlier trees left of the target; the sums
are merged before anything reaches the driver, which holds one line per bin and picks the best cut of
every node. So the number of jobs follows the trees and levels of one setting, not the number of settings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.session import materialize

#: Levels a tree may have.
DEEPEST = 30
#: Bins summed up in one pass; nodes beyond that get a pass of their own.
CELLS = 1 << 21
#: Trees after which what they leave is stored anew, so that work grows with their number and not its square.
FOLD = 4
#: Inputs handled at once in a task.
VALUES = 1 << 20
#: Nodes up to which all cuts of a tree are tried on all rows, column by column; rows go through larger trees level by level.
SMALL = 64
#: A gain below the rounding of the sums is none.
ROUNDING = 1e-12


@dataclass
class Tree:
    """Nodes in the order they were made. A row goes on to ``left``, or to the node after it if its bin is above ``edge``; a leaf leads to itself."""

    feature: list[int] = field(default_factory=lambda: [0])
    edge: list[int] = field(default_factory=lambda: [1 << 40])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def arrays(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.depth, np.array(self.feature), np.array(self.edge), np.array(self.left), np.array(self.value)

    def cut(self, nodes: Sequence[int], n: np.ndarray, s: np.ndarray, deeper: bool) -> list[int]:
        """Set the means of ``nodes`` from counts and sums (node, input, bin), and cut them if they may go deeper; the new nodes."""
        rows, total = n[:, 0].sum(axis=1), s[:, 0].sum(axis=1)
        for k, node in enumerate(nodes):
            self.value[node] = float(total[k] / rows[k])
        if not deeper:
            return []
        n_low, s_low = n.cumsum(axis=2), s.cumsum(axis=2)
        n_high, s_high = rows[:, None, None] - n_low, total[:, None, None] - s_low
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = np.where((n_low > 0) & (n_high > 0), s_low * s_low / n_low + s_high * s_high / n_high, -np.inf)
        made = []
        for k, node in enumerate(nodes):
            at = np.unravel_index(int(np.argmax(kept[k])), kept[k].shape)
            most = kept[k][at]
            if not most - total[k] * total[k] / rows[k] > ROUNDING * most:
                continue
            first = len(self.left)
            self.feature[node], self.edge[node], self.left[node] = int(at[0]), int(at[1]), first
            self.feature += [0, 0]
            self.edge += [1 << 40, 1 << 40]
            self.left += [first, first + 1]
            self.value += [float(s_low[k][at] / n_low[k][at]), float(s_high[k][at] / n_high[k][at])]
            made += [first, first + 1]
        self.depth += bool(made)
        return made


@dataclass
class Fit:
    """A setting and its trees since what they leave was last stored, in place ``slot`` of a row's rests."""

    max_depth: int
    step: float
    max_bins: int
    trees: list[Tree] = field(default_factory=list)
    slot: int = 0

    def reason(self) -> str | None:
        """Why it cannot be fitted."""
        if not 0 <= self.max_depth <= DEEPEST:
            return f"max_depth {self.max_depth} is not between 0 and {DEEPEST}"
        return None if self.max_bins >= 2 else f"max_bins {self.max_bins} is below 2"


def _place(bins: np.ndarray, tree: tuple) -> np.ndarray:
    """The node every row ends in; ``bins`` holds a line per input."""
    depth, feature, edge, left, _ = tree
    n = bins.shape[1]
    if len(left) <= SMALL:
        # A node leads to later ones, so those are known when it is reached from the end.
        ends: list = [None] * len(left)
        for node in range(len(left) - 1, -1, -1):
            low = left[node]
            ends[node] = np.uint8(node) if low == node else np.where(bins[feature[node]] > int(edge[node]), ends[low + 1], ends[low])
        return np.broadcast_to(ends[0], n)
    at, rows = np.zeros(n, dtype=np.intp), np.arange(n)
    for _ in range(depth):
        at = left[at] + (bins[feature[at], rows] > edge[at])
    return at


def _rest(rests: np.ndarray, bins: np.ndarray, slot: int, step: float, trees: Sequence[tuple]) -> np.ndarray:
    """What the trees of a setting leave of the target."""
    rest = rests[slot]
    for tree in trees:
        rest = rest - (step * tree[4]).take(_place(bins, tree))
    return rest


def _column(max_bins: int) -> str:
    return f"bins_{max_bins}"


def _packed(bins: np.ndarray) -> pa.Array:
    n, size = bins.shape[0], bins.shape[1] * bins.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins))])


def _unpacked(column: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return held.view(kind).reshape(len(column), width)


def _kind(max_bins: int) -> np.dtype:
    return np.min_scalar_type(max_bins - 1)


def _parts(batches: Iterator[pa.RecordBatch], width: int, limits: Sequence[int]) -> Iterator[tuple[pa.RecordBatch, dict[int, np.ndarray], np.ndarray]]:
    """Slices of the stored rows, and their bins by limit and their rests, a line per input or setting."""
    for batch in batches:
        for first in range(0, batch.num_rows, max(VALUES // width, 1)):
            part = batch.slice(first, max(VALUES // width, 1))
            bins = {m: np.ascontiguousarray(_unpacked(part.column(_column(m)), width, _kind(m)).T) for m in limits}
            yield part, bins, np.ascontiguousarray(_unpacked(part.column("rests"), -1, np.dtype(float)).T)


def edges(rows: DataFrame, limits: Sequence[int]) -> dict[int, dict[int, np.ndarray]]:
    """The cuts of every input, by the largest number of bins: between all values if there are no more, else at quantiles.

    A value that holds several quantiles is cut off on both sides. Quantiles have a rank error of at most a twentieth of a bin.
    """
    values = rows.select(F.posexplode("features").alias("input", "value"))
    shares = [k / m for m in limits for k in range(1, m)]
    quantiles = F.percentile_approx("value", shares, max(10_000, 20 * max(limits)))
    found = values.groupBy("input").agg(quantiles.alias("quantiles"), F.approx_count_distinct("value").alias("n")).collect()
    few = [line["input"] for line in found if line["n"] <= 2 * max(limits)]
    known = {}
    if few:
        lines = values.where(F.col("input").isin(few)).groupBy("input").agg(F.collect_set("value").alias("all")).collect()
        known = {line["input"]: np.unique(line["all"]) for line in lines}
    cuts: dict[int, dict[int, np.ndarray]] = {m: {} for m in limits}
    for line in found:
        own, first = known.get(line["input"]), 0
        for m in limits:
            if own is not None and len(own) <= m:
                cuts[m][line["input"]] = (own[:-1] + own[1:]) / 2
            else:
                at, times = np.unique(line["quantiles"][first : first + m - 1], return_counts=True)
                cuts[m][line["input"]] = np.unique(np.concatenate([at, np.nextafter(at[times > 1], -np.inf)]))
            first += m - 1
    return cuts


class Boosting:
    """The binned rows of both sides, and the passes over them."""

    def __init__(self, rows: DataFrame, limits: Sequence[int]):
        """``rows`` (features, y, held_out) are complete and stored; ``limits`` are the numbers of bins that the settings ask for."""
        self.limits = sorted(set(limits))
        size, infinite = F.size("features"), float("inf")
        usable = (F.abs("y") < infinite) & F.forall("features", lambda v: F.abs(v) < infinite)
        fitted_on = rows.where("not held_out")
        about = fitted_on.agg(
            F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(~usable).alias("bad")
        ).first()
        self.width, self.reason = about["most"], None
        if not about["n"]:
            self.reason = "no rows to fit on"
        elif about["bad"]:
            self.reason = f"{about['bad']} rows with an input or target that is not finite"
        elif about["least"] != about["most"] or not about["most"]:
            self.reason = f"sequences of {about['least']} to {about['most']} inputs"
        if self.reason is None and self.limits:
            self.table = self._binned(rows, about["mean"], edges(fitted_on, self.limits))
            self.counts: dict[int, np.ndarray] = {}  # of all rows by input and bin, by limit

    def _binned(self, rows: DataFrame, mean: float, cuts: dict[int, dict[int, np.ndarray]]) -> DataFrame:
        width, limits = self.width, self.limits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                rest = batch.column("y").to_numpy(zero_copy_only=False)[:, None] - mean
                out = []
                for m in limits:
                    bins = np.empty(x.shape, dtype=_kind(m))
                    for j in range(width):
                        bins[:, j] = np.searchsorted(cuts[m][j], x[:, j])
                    out.append(_packed(bins))
                yield pa.RecordBatch.from_arrays(
                    [*out, _packed(rest), batch.column("held_out")], names=[*map(_column, limits), "rests", "held_out"]
                )

        schema = ", ".join([*(f"{_column(m)} binary" for m in limits), "rests binary", "held_out boolean"])
        fits = F.when(F.size("features") == width, F.col("features")).otherwise(F.raise_error(F.lit(f"a sequence does not have {width} inputs")))
        return materialize(rows.withColumn("features", fits).mapInArrow(run, schema), "boosting-bins")

    def grow(self, fits: dict[int, Fit]) -> None:
        """One more tree for every setting."""
        if any(len(fit.trees) >= FOLD for fit in fits.values()):
            self._fold(fits)
        for fit in fits.values():
            fit.trees.append(Tree())
        nodes, level = {key: [0] for key in fits}, 0
        while nodes:
            sums = self._sums(fits, nodes)
            made = {key: fits[key].trees[-1].cut(own, *sums[key], deeper=level < fits[key].max_depth) for key, own in nodes.items()}
            level += 1
            # The means of the last level come with the cuts that make it.
            nodes = {key: own for key, own in made.items() if own and level < fits[key].max_depth}

    def _sums(self, fits: dict[int, Fit], nodes: dict[int, list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Counts and sums of the rests by node, input and bin, in as many passes as the cells need."""
        found: dict[int, list] = {key: [] for key in nodes}
        share: dict[int, list[int]] = {}
        held = 0
        for key, own in nodes.items():
            cells = self.width * fits[key].max_bins
            while own:
                take = max((CELLS - held) // cells, 0 if share else 1)
                if take:
                    share[key], own = own[:take], own[take:]
                    held += cells * len(share[key])
                if own:
                    self._pass(fits, share, found)
                    share, held = {}, 0
        if share:
            self._pass(fits, share, found)
        return {key: tuple(np.concatenate(side) for side in zip(*parts)) for key, parts in found.items()}

    def _pass(self, fits: dict[int, Fit], nodes: dict[int, list[int]], found: dict[int, list]) -> None:
        width, limits, plan = self.width, sorted({fits[key].max_bins for key in nodes}), []
        for key, own in nodes.items():
            *earlier, tree = [tree.arrays() for tree in fits[key].trees]
            place = np.full(len(tree[3]), -1)
            place[own] = np.arange(len(own))
            plan.append((key, fits[key].slot, fits[key].step, fits[key].max_bins, earlier, tree, place, len(own)))

        # The rows of a first node are the same for all settings and trees.
        counted = {m for _, _, _, m, _, tree, _, _ in plan if len(tree[3]) == 1 and m in self.counts}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {key: np.zeros((2, width, n * m)) for key, _, _, m, _, _, _, n in plan}
            for _, bins, rests in _parts(batches, width, limits):
                for key, slot, step, m, earlier, tree, place, n in plan:
                    rest, at, columns, root = _rest(rests, bins[m], slot, step, earlier), None, bins[m], len(tree[3]) == 1
                    if not root:
                        at = place.take(_place(bins[m], tree))
                        if (at < 0).any():
                            own = np.flatnonzero(at >= 0)
                            rest, at, columns = rest[own], at[own], columns[:, own]
                        at = at * m
                    counts, totals = sums[key]
                    for j, column in enumerate(columns):
                        cell = column.astype(np.intp) if root else at + column
                        if not (root and m in counted):
                            counts[j] += np.bincount(cell, minlength=n * m)
                        totals[j] += np.bincount(cell, weights=rest, minlength=n * m)
            for key, _, _, m, _, tree, _, n in plan:
                counts, totals = (side.reshape(width, n, m).transpose(1, 0, 2).ravel() for side in sums[key])
                on = np.flatnonzero(totals if len(tree[3]) == 1 and m in counted else counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(on), key, dtype=np.int32)), pa.array(on), pa.array(counts[on].astype(np.int64)), pa.array(totals[on])],
                    names=["fit", "cell", "n", "s"],
                )

        rows = self.table.where("not held_out").select(*map(_column, limits), "rests")
        merged = rows.mapInArrow(run, "fit int, cell long, n long, s double").groupBy("fit", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
        fit, cell, n, s = (column.to_numpy() for column in merged.columns)
        for key, _, _, m, _, tree, _, count in plan:
            sides = np.zeros((2, count * width * m))
            sides[:, cell[fit == key]] = n[fit == key], s[fit == key]
            counts, totals = sides.reshape(2, count, width, m)
            if len(tree[3]) == 1:
                counts = self.counts.setdefault(m, counts)
            found[key].append((counts, totals))

    def losses(self, fits: dict[int, Fit]) -> dict[tuple[int, bool], float]:
        """The mean squared error of every setting on (fit, held out) rows; a side without rows has none."""
        width, limits = self.width, sorted({fit.max_bins for fit in fits.values()})
        plan = [(key, fit.slot, fit.step, fit.max_bins, [tree.arrays() for tree in fit.trees]) for key, fit in fits.items()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(plan)))
            rows = np.zeros(2, dtype=np.int64)
            for part, bins, rests in _parts(batches, width, limits):
                held_out = part.column("held_out").to_numpy(zero_copy_only=False)
                rows += np.bincount(held_out, minlength=2)
                for k, (_, slot, step, m, trees) in enumerate(plan):
                    rest = _rest(rests, bins[m], slot, step, trees)
                    sums[:, k] += np.bincount(held_out, weights=rest * rest, minlength=2)
            for side in np.flatnonzero(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key for key, *_ in plan], pa.int32()), pa.array([bool(side)] * len(plan)), pa.array([rows[side]] * len(plan), pa.int64()), pa.array(sums[side])],
                    names=["fit", "held_out", "n", "s"],
                )

        stored = self.table.select(*map(_column, limits), "rests", "held_out")
        lines = stored.mapInArrow(run, "fit int, held_out boolean, n long, s double").groupBy("fit", "held_out").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return {(line["fit"], line["held_out"]): line["s"] / line["n"] for line in lines.collect()}

    def _fold(self, fits: dict[int, Fit]) -> None:
        """Store what the trees of the settings leave; settings that are not named are given up."""
        width, limits = self.width, sorted({fit.max_bins for fit in fits.values()})
        plan = [(fit.slot, fit.step, fit.max_bins, [tree.arrays() for tree in fit.trees]) for fit in fits.values()]
        names = [*map(_column, limits), "rests", "held_out"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, bins, rests in _parts(batches, width, limits):
                left = np.column_stack([_rest(rests, bins[m], slot, step, trees) for slot, step, m, trees in plan])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(name) for name in names[:-2]), _packed(left), part.column("held_out")], names=names
                )

        table = self.table.select(*names)
        self.table = materialize(table.mapInArrow(run, table.schema), "boosting-rests")
        for slot, fit in enumerate(fits.values()):
            fit.slot, fit.trees = slot, []
