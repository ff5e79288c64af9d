"""Sufficient statistics of linear fits: one pass over the rows for any number of settings.

A part of a frame (training rows, held-out tail) is summed up by its row count, the means and
the covariances of inputs and target. Those of tasks are merged
before anything reaches the driver, which holds width x width numbers per part and group. Every penalty is
solved from the sums of the training part, and its squared losses follow from those of any part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.models.frames import complete

#: Inputs up to which the sums are kept (a matrix of their square per task).
WIDEST = 4096
#: Rows multiplied at once, and groups the tasks' results are merged in.
ROWS, GROUPS = 4096, 64


class Moments(NamedTuple):
    """``mean`` and population ``covariance`` of the inputs, the target last."""

    rows: int
    left_out: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def width(self) -> int:
        return len(self.mean) - 1


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of two sets of rows together."""
    if not a.rows or not b.rows:
        return (a if a.rows else b)._replace(left_out=a.left_out + b.left_out)
    share = b.rows / (a.rows + b.rows)
    apart = b.mean - a.mean
    covariance = (1 - share) * a.covariance + share * b.covariance + share * (1 - share) * np.outer(apart, apart)
    return Moments(a.rows + b.rows, a.left_out + b.left_out, a.mean + share * apart, covariance)


def _nothing(width: int) -> Moments:
    return Moments(0, 0, np.zeros(width + 1), np.zeros((width + 1, width + 1)))


def _of_rows(table: np.ndarray) -> Moments:
    mean = table.mean(axis=0)
    table = table - mean
    return Moments(len(table), 0, mean, table.T @ table / len(table))


def _as_batch(group: int, held: dict[str, Moments]) -> pa.RecordBatch:
    found = held.values()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(held), pa.string()), pa.array([group] * len(held), pa.int32()), pa.array([m.rows for m in found], pa.int64()),
            pa.array([m.left_out for m in found], pa.int64()), pa.array([m.mean for m in found], pa.list_(pa.float64())),
            pa.array([m.covariance.ravel() for m in found], pa.list_(pa.float64())),
        ],
        names=["part", "grp", "n", "left_out", "mean", "covariance"],
    )


def _from_rows(rows: list[dict], width: int) -> dict[str, Moments]:
    held: dict[str, Moments] = {}
    for row in rows:
        own = Moments(row["n"], row["left_out"], np.array(row["mean"]), np.array(row["covariance"]).reshape(width + 1, width + 1))
        held[row["part"]] = merged(held.get(row["part"], _nothing(width)), own)
    return held


PARTIAL = "part string, grp int, n long, left_out long, mean array<double>, covariance array<double>"


def _summed(width: int):
    """The moments of every part in a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Moments] = {}
        for batch in batches:
            part, flat, target = batch.columns
            for name in part.unique().to_pylist():
                own = pc.equal(part, name)
                rows = flat.filter(own)
                used = pc.is_valid(rows)
                n = pc.sum(used).as_py() or 0
                held[name] = merged(held.get(name, _nothing(width)), _nothing(width)._replace(left_out=len(rows) - n))
                if not n:
                    continue
                rows, y = rows.filter(used), target.filter(own).filter(used).to_numpy(zero_copy_only=False)
                if pc.min_max(pc.list_value_length(rows)).as_py() != {"min": width, "max": width}:
                    raise ValueError(f"a sequence does not have {width} inputs")
                x = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for first in range(0, n, ROWS):
                    held[name] = merged(held[name], _of_rows(np.column_stack([x[first : first + ROWS], y[first : first + ROWS]])))
        if held:
            yield _as_batch(TaskContext.get().partitionId() % GROUPS, held)

    return run


def moments(frame: DataFrame, width: int, part: Column | None = None) -> dict[str, Moments]:
    """The moments of every part of a sequence frame (``to_frame``), in one pass over its rows.

    ``part`` is a text column; a NULL is no part. Rows with a missing input or target are
    counted as left out. Means and covariances are merged, not raw sums, so that columns far from
    zero lose no digits.
    """
    if width > WIDEST:
        raise ValueError(f"{width} inputs; the sums are kept for at most {WIDEST}")
    part = F.lit("all") if part is None else part
    usable = complete() & F.col("y").isNotNull() & ~F.isnan("y")
    flat = F.transform(F.flatten("X"), lambda v: v.cast("double"))
    whole = F.when(usable & F.forall(flat, lambda v: ~F.isnan(v)), flat)
    rows = frame.select(part.cast("string").alias("part"), whole.alias("flat"), F.col("y").cast("double").alias("y")).where("part is not null")

    def together(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_batches([_as_batch(rows[0]["grp"], _from_rows(rows, width))])

    # Two levels: many tasks into few groups, the groups on the driver.
    groups = rows.mapInArrow(_summed(width), PARTIAL).groupBy("grp").applyInArrow(together, PARTIAL)
    return dict(sorted(_from_rows(groups.toArrow().to_pylist(), width).items()))


def _with_signs(c: np.ndarray, target: np.ndarray, spread: np.ndarray, sign: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The weights if those that are not 0 have these signs; None if they do not."""
    on = np.flatnonzero(sign)
    v = np.zeros(len(sign))
    scale = np.outer(spread[on], spread[on])
    v[on] = np.linalg.lstsq((c[np.ix_(on, on)] + l2 * np.eye(len(on))) / scale, (target[on] - l1 / 2 * sign[on]) / spread[on], rcond=1e-13)[0] / spread[on]
    rest = np.abs(target - c @ v - l2 * v)
    slack = 1e-9 * (l1 / 2 + np.abs(target))
    right = np.all(v[on] * sign[on] > 0) and np.all(np.abs(rest[on] - l1 / 2) <= slack[on]) and np.all(rest <= l1 / 2 + slack)
    return v if right else None


def solve(found: Moments, l1: float = 0.0, l2: float = 0.0, tolerance: float = 1e-12, sweeps: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean(e^2) + l1*sum|w| + l2*sum(w^2).

    Without L1 by a direct solve (of least norm in units of each input's deviation if inputs depend on each other), else by
    coordinate descent. Constant inputs get no weight.
    """
    if not found.rows:
        raise ValueError("no complete row to fit on")
    c, target = found.covariance[:-1, :-1], found.covariance[:-1, -1]
    spread = np.sqrt(np.maximum(np.diag(c), 0.0))
    # A deviation below the rounding of the sums is none.
    live = np.flatnonzero(spread > 1e-10 * np.maximum(np.abs(found.mean[:-1]), 1e-300))
    w = np.zeros(found.width)
    if len(live):
        c, target, spread = c[np.ix_(live, live)], target[live], spread[live]
        if not l1:
            scale = np.outer(spread, spread)
            w[live] = np.linalg.lstsq((c + l2 * np.eye(len(live))) / scale, target / spread, rcond=1e-13)[0] / spread
        else:
            v, gradient = np.zeros(len(live)), target.copy()
            for sweep in range(1, sweeps + 1):
                moved = 0.0
                for j in range(len(live)):
                    inner = gradient[j] + c[j, j] * v[j]
                    new = np.sign(inner) * max(abs(inner) - l1 / 2, 0.0) / (c[j, j] + l2)
                    if new != v[j]:
                        gradient -= c[:, j] * (new - v[j])
                        moved = max(moved, abs(new - v[j]) * spread[j])
                        v[j] = new
                if moved <= tolerance * max(np.sqrt(found.covariance[-1, -1]), 1e-300):
                    break
                # Inputs that nearly depend on each other move slowly; with the right signs one solve ends it.
                if sweep % 20 == 0 and (direct := _with_signs(c, target, spread, np.sign(v), l1, l2)) is not None:
                    v = direct
                    break
            else:
                raise RuntimeError(f"not converged after {sweeps} sweeps")
            w[live] = v
    return w, float(found.mean[-1] - found.mean[:-1] @ w)


def squared_loss(found: Moments, weights: np.ndarray, intercept: float) -> float | None:
    """mean(e^2) of a linear model on the rows summed up, NULL without rows."""
    if not found.rows:
        return None
    error = np.append(weights, -1.0)
    bias = intercept + found.mean @ error
    return float(max(error @ found.covariance @ error, 0.0) + bias * bias)


def slopes(found: Moments, weights: np.ndarray) -> np.ndarray:
    """Half the gradient of mean(e^2) by each weight at the best intercept."""
    return found.covariance[:-1, :-1] @ weights - found.covariance[:-1, -1]
