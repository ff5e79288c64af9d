"""Hyper-parameter grids, grid search, successive halving and Hyperband."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.models.frames import fit_rows, predict
from gaugeframe.models.linear import fitted
from gaugeframe.models.moments import Moments, moments, squared_loss
from gaugeframe.models.nonlinear import fit_nonlinear
from gaugeframe.models.trees import Boosting, Fit
from gaugeframe.operators.metrics import loss_mse
from gaugeframe.session import materialize
from gaugeframe.sources.sinks import append_experiments

# The searched settings.
RECURRENT_GRID = {
    "seq_length": [5, 10],
    "hidden_units": [50, 100],
    "num_layers": [1, 2],
    "dropout_rate": [0.2, 0.3],
    "learning_rate": [0.001, 0.0005],
    "bidirectional": [False, True],
}
TRANSFORMER_GRID = {
    "seq_length": [5, 10],
    "dropout_rate": [0.2, 0.3],
    "learning_rate": [0.001, 0.0005],
    "num_heads": [2, 4],
    "ff_dim": [64, 128],
}
GRIDS = {"lstm": RECURRENT_GRID, "gru": RECURRENT_GRID, "transformer": TRANSFORMER_GRID}

# The named linear variants and their penalties (l1, l2).
LINEAR_VARIANTS = {
    "linear_basic": (0.0, 0.0),
    "linear_with_l1_reg": (0.01, 0.0),
    "linear_with_l2_reg": (0.0, 0.01),
    "linear_with_elastic_net": (0.005, 0.005),
}

_TYPES = {"seq_length": "int", "hidden_units": "int", "num_layers": "int", "dropout_rate": "double",
          "learning_rate": "double", "bidirectional": "boolean", "num_heads": "int", "ff_dim": "int"}
GRID_COLUMNS = list(_TYPES)


def config_key() -> Column:
    """One text per setting; a setting that does not apply counts as ``-``."""
    return F.concat_ws("|", "model_type", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in GRID_COLUMNS])


def param_grid(spark: SparkSession) -> DataFrame:
    """All settings of the searched families: (config_id, model_type, settings), NULL where a setting does not apply."""
    parts = None
    for model_type, grid in GRIDS.items():
        part = spark.range(1).select(F.lit(model_type).alias("model_type"))
        for name, values in grid.items():
            part = part.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        part = part.select(
            "model_type",
            *[(F.col(c) if c in grid else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()],
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("config_id", config_key())


RUNS = "run_id INT, model_type STRING, config STRING, test_loss DOUBLE, reason STRING"


def settings_text(config: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(config.items()) if k != "model_type")


def _loss(model, frame: DataFrame) -> float:
    scored = predict(model, frame)
    return float(scored.agg(loss_mse(F.col("y"), F.col("prediction"))).first()[0])


def linear_grid(spark: SparkSession, frame: DataFrame, part: Column, n_features: int, configs: Sequence[dict]) -> DataFrame:
    """The run table of any number of linear settings, from one pass over ``frame``.

    ``part`` is "train" for the rows to fit on and "test" for those that give the loss.
    """
    sums = moments(frame, n_features, part)
    return spark.createDataFrame([(i, "linear", settings_text(c), *_linear_run(sums, c)) for i, c in enumerate(configs)], RUNS)


def _linear_run(sums: dict[str, Moments], config: dict) -> tuple[float | None, str | None]:
    """(loss, reason why there is none)."""
    if "train" not in sums or "test" not in sums:
        return None, "no rows to fit on or to test with"
    try:
        model = fitted(sums["train"], config.get("l1", 0.0), config.get("l2", 0.0))
    except (ValueError, RuntimeError) as error:
        return None, str(error)
    loss = squared_loss(sums["test"], np.array(model.weights), model.intercept)
    return loss, None if loss is not None else "no complete row to test with"


def grid_search(
    spark: SparkSession, train: DataFrame, validation: DataFrame, n_features: int, configs: Sequence[dict], path: str | None = None
) -> DataFrame:
    """Fit every setting, log its loss on the time-ordered validation tail.

    A run table with (run_id, model_type, config, test_loss, reason); a failing setting gets a NULL
    loss and the reason. With ``path`` each run is appended as soon as it is done. All linear settings
    together read both sides once (:func:`linear_grid` reads a frame that holds both only once);
    a boosted setting reads them once per tree and level, so they should be stored.
    """
    runs, sums = [], None
    for run_id, config in enumerate(configs):
        if config["model_type"] == "linear":
            if sums is None:
                side = train.withColumn("_part", F.lit("train")).unionByName(validation.withColumn("_part", F.lit("test")))
                sums = moments(side, n_features, F.col("_part"))
            loss, reason = _linear_run(sums, config)
        else:
            try:
                model = fit_nonlinear(train, config.get("max_depth", 3), config.get("max_iter", 10), config.get("step", 0.1))
                loss, reason = _loss(model, validation), None
            except Exception as error:  # noqa: BLE001
                loss, reason = None, str(error).splitlines()[0]
        runs.append((run_id, config["model_type"], settings_text(config), loss, reason))
        if path:
            append_experiments(spark.createDataFrame(runs[-1:], RUNS), path)
    return spark.createDataFrame(runs, RUNS)


@dataclass(frozen=True)
class Rung:
    """``settings`` of ``bracket`` reach ``budget`` trees, and the best ``kept`` go on."""

    bracket: int
    rung: int
    budget: int
    settings: int
    kept: int


def hyperband_rungs(largest: int, factor: int = 3) -> list[Rung]:
    """The brackets of Hyperband: from many settings with a small budget to few with ``largest`` from the start.

    Bracket s begins with ceil((s_max + 1) / (s + 1) * factor^s) settings at largest / factor^s trees;
    each rung keeps a ``factor``-th and multiplies the budget.
    """
    deepest = 0
    while factor ** (deepest + 1) <= largest:
        deepest += 1
    rungs = []
    for s in range(deepest, -1, -1):
        n = -(-(deepest + 1) * factor**s // (s + 1))
        for i in range(s + 1):
            here = n // factor**i
            rungs.append(Rung(deepest - s, i, max(largest * factor**i // factor**s, 1), here, here // factor if i < s else min(here, 1)))
    return rungs


def drawn_settings(space: dict[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """``n`` boosted settings; a value is drawn from a list, or from (low, high, step) with its ends."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        config = {"model_type": "boosted"}
        for name, values in space.items():
            if isinstance(values, tuple):
                low, high, step = values
                config[name] = round(low + step * rng.randint(0, int((high - low) / step + 1e-9)), 10)
            else:
                config[name] = rng.choice(list(values))
        out.append(config)
    return out


HALVING = (
    "bracket INT, rung INT, budget INT, fitted INT, config STRING, train_loss DOUBLE, loss DOUBLE, kept BOOLEAN, reason STRING"
)


def _brackets(train: DataFrame, validation: DataFrame, brackets: Sequence[tuple[Sequence[dict], Sequence[Rung]]]) -> list[tuple]:
    """One row per setting and rung. The settings of all brackets get their trees side by side (``models.trees``)."""
    settings = [(b, config) for b, (configs, _) in enumerate(brackets) for config in configs]
    fits = {
        key: Fit(int(config.get("max_depth", 3)), float(config.get("step", 0.1)), int(config.get("max_bins", 32)))
        for key, (_, config) in enumerate(settings)
    }
    failed = {key: fit.reason() for key, fit in fits.items() if fit.reason()}
    sides = [
        fit_rows(side).select(vector_to_array("features").alias("features"), "y", F.lit(held_out).alias("held_out"))
        for held_out, side in ((False, train), (True, validation))
    ]
    boosting = Boosting(materialize(sides[0].unionByName(sides[1]), "boosting"), [fit.max_bins for key, fit in fits.items() if key not in failed])
    if boosting.reason:
        failed = {key: failed.get(key, boosting.reason) for key in fits}
    alive = [[key for key, (b, _) in enumerate(settings) if b == own] for own in range(len(brackets))]
    waiting = [list(rungs) for _, rungs in brackets]
    done, rows = [0] * len(brackets), []
    for trees in range(max((rung.budget for rungs in waiting for rung in rungs), default=0) + 1):
        growing = {key: fits[key] for b, keys in enumerate(alive) if waiting[b] for key in keys if key not in failed}
        if trees and growing:
            boosting.grow(growing)
        while due := [b for b, rungs in enumerate(waiting) if rungs and rungs[0].budget == trees]:
            measured = {key: fits[key] for b in due for key in alive[b] if key not in failed}
            losses = boosting.losses(measured) if measured else {}
            for b in due:
                rung = waiting[b].pop(0)
                loss = {key: losses.get((key, True)) for key in alive[b]}
                order = sorted(alive[b], key=lambda key: (loss[key] is None, loss[key] or 0.0, key))
                for place, key in enumerate(order):
                    text = ",".join(f"{k}={v}" for k, v in sorted(settings[key][1].items()))
                    rows.append((
                        rung.bracket, rung.rung, rung.budget, rung.budget - done[b], text, losses.get((key, False)), loss[key], place < rung.kept, failed.get(key),
                    ))
                done[b] = rung.budget
                alive[b] = [key for key in order[: rung.kept] if key not in failed]
                if not alive[b]:
                    waiting[b] = []
    return sorted(rows, key=lambda row: row[:2])


def successive_halving(
    spark: SparkSession,
    train: DataFrame,
    validation: DataFrame,
    n_features: int,
    configs: Sequence[dict],
    budget: int = 2,
    factor: int = 3,
) -> DataFrame:
    """Give all settings a small budget, keep the best third, raise the budget, repeat.

    (bracket, rung, budget, fitted, config, train_loss, loss, kept, reason). The budget is the number of boosted
    trees; a setting that goes on keeps its trees and fits ``fitted`` more on what they leave. A
    setting that fails is placed last with a NULL loss and the reason.
    """
    if any(c["model_type"] == "linear" for c in configs):
        raise ValueError("linear fits are solved in one pass whatever the budget; use grid_search")
    rungs, n = [], len(configs)
    while n:
        keep = 0 if n == 1 else -(-n // factor)
        rungs.append(Rung(0, len(rungs), budget * factor ** len(rungs), n, max(keep, 1)))
        n = keep
    rows = _brackets(train, validation, [(configs, rungs)]) if rungs else []
    return spark.createDataFrame(rows, HALVING)


def hyperband(
    spark: SparkSession, train: DataFrame, validation: DataFrame, space: dict[str, Sequence], largest: int = 27, factor: int = 3, seed: int = 0
) -> DataFrame:
    """Every bracket of :func:`hyperband_rungs` with settings of its own, drawn from ``space``; columns as above.

    ``space`` names lists of values or (low, high, step) ranges of ``max_depth``, ``step`` and ``max_bins``.
    """
    rungs, brackets = hyperband_rungs(largest, factor), []
    for bracket in sorted({rung.bracket for rung in rungs}):
        own = [rung for rung in rungs if rung.bracket == bracket]
        brackets.append((drawn_settings(space, own[0].settings, seed + bracket), own))
    return spark.createDataFrame(_brackets(train, validation, brackets), HALVING)


def linear_configs(l1: Sequence[float], l2: Sequence[float]) -> list[dict]:
    return [{"model_type": "linear", "l1": a, "l2": b} for a, b in product(l1, l2)]


def variant_configs() -> list[dict]:
    """The named linear variants as settings for :func:`grid_search`."""
    return [{"model_type": "linear", "name": n, "l1": a, "l2": b} for n, (a, b) in LINEAR_VARIANTS.items()]
