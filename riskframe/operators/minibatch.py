"""Mini-batch training of many networks in shared passes (M2-M5).

The rows are dealt by the hash of their key into blocks of some thousand rows,
once, and as many to every task.  An epoch is one pass over the blocks for all networks that still
train: every block starts from the epoch's weights, shuffles its rows by a seed
of (seed, epoch, block), and takes Adam steps over its batches; the networks'
new weights and moments are the averages over blocks, weighted by their training
rows.  What a block does depends on its rows, the weights and the seed only, not
on tasks or files, so runs repeat.  A task takes its blocks' steps some blocks at
a time, in matrix products over all of them.  Tasks add up their blocks before Spark adds
up the tasks; the driver sees the weights and a few sums per network.

The same pass measures the epoch's first weights on every split, so the history
costs no scan of its own, and scans do not grow with the number of networks.  A
network stops when its validation loss has not improved by ``min_delta`` for
``patience`` epochs; its best weights are returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.hashing import hash_hex, uniform
from riskframe.operators.networks import (Stack, flatten, init_layers, log_loss, n_parameters,
                                          unflatten)
from riskframe.operators.scoring import MLP
from riskframe.session import ship_package

#: Rows of a block, on average.
BLOCK_ROWS = 4_096
#: Blocks of a task at most, and those that a task trains together.
TASK_BLOCKS = 64
STACKED = 16
#: Rows measured together.
MEASURED_ROWS = 1_024
#: Adam's decay rates and the guard of its quotient.
BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


@dataclass
class Trained:
    """A network with its best weights, and how it got there."""

    model: MLP
    history: list = field(default_factory=list)      # one dict per epoch
    best_epoch: int = 0
    stopped_early: bool = False
    test_accuracy: float | None = None               # of the best weights
    passes: int = 0                                  # over the blocks, for all networks


@dataclass
class _Run:
    sizes: list[int]
    activation: str
    lr: float
    batch: int
    epochs: int
    vec: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: int = 0
    best: tuple = (float("inf"), None, 0, None)
    waited: int = 0
    history: list = field(default_factory=list)
    done: bool = False
    early: bool = False


def blocks_of(data: DataFrame, features: Sequence[str], label: str, key: str, split_col: str,
              seed: int = 42, block_rows: int = BLOCK_ROWS,
              splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """``(block, n, x, y)``, kept by the executors: about ``block_rows`` rows each,
    dealt by the hash of the key, by split and then by that hash; ``n`` counts the
    rows of every split, ``x`` has their features end to end.  Every task gets as
    many blocks as the others, or one less.  Rows without a label or with a missing
    feature are left out, so are rows of no split, which no pass would use."""
    x = [F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")) for f in features]
    part = F.col(split_col).cast("string")
    rows = data.select(hash_hex(key, seed, "order").alias("h"),
                       uniform(key, seed, "block").alias("u"), F.array(*x).alias("x"),
                       F.col(label).cast("double").alias("y"),
                       F.coalesce(*[F.when(part == s, i) for i, s in enumerate(splits)]).alias("s"))
    rows = rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    n = max(1, round(rows.count() / block_rows))
    cores = data.sparkSession.sparkContext.defaultParallelism
    tasks = min(n, cores * -(-n // (cores * TASK_BLOCKS)))
    made = (rows.where("s IS NOT NULL").groupBy(F.floor(F.col("u") * n).alias("block"))
            .agg(F.array(*[F.count_if(F.col("s") == i) for i in range(len(splits))]).alias("n"),
                 F.sort_array(F.collect_list(F.struct("s", "h", "x", "y"))).alias("rows")))
    return made.select(
        "block", "n", F.flatten("rows.x").alias("x"), F.col("rows.y").alias("y")
    ).repartitionById(tasks, (F.col("block") % tasks).cast("int")).persist(
        StorageLevel.MEMORY_AND_DISK)


def dealt(x: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int
          ) -> tuple[np.ndarray, np.ndarray]:
    """The rows that ``order`` names, a row per block, as (blocks, inputs, rows) and
    (blocks, rows), with room for a last batch behind them."""
    blocks, n = order.shape
    xs, ys = np.zeros((blocks, x.shape[1], n + batch)), np.zeros((blocks, n + batch))
    for own, to in zip(order, xs):
        to[:, :n] = x[own].T
    ys[:, :n] = y[order]
    return xs, ys


def _one_epoch(run: _Run, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> tuple:
    """Weights and moments after a block's batches."""
    *state, steps = _together(run, *dealt(x, y, order[None], run.batch), np.array([len(order)]))
    return *(a[0] for a in state), int(steps[0])


def _together(run: _Run, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple:
    """Weights and moments after the batches of several blocks, a row per block, and
    their steps.  ``x`` and ``y`` are dealt; the first ``counts`` rows belong to a
    block, and blocks come by falling count.  Every block takes the steps that it
    would take alone."""
    steps = -(-counts // run.batch)
    stack = Stack(run.sizes, run.activation, len(counts), run.batch)
    state = [np.repeat(a[None, stack.order], len(counts), axis=0) for a in (run.vec, run.m, run.v)]
    scratch = np.empty_like(state[0])
    for t in range(int(steps.max(initial=0))):
        k, at = int((steps > t).sum()), t * run.batch
        sizes = np.minimum(counts[:k] - at, run.batch)
        real = np.arange(run.batch) < sizes[:, None] if sizes[-1] < run.batch else None
        vec, m, v, s = (a[:k] for a in (*state, scratch))
        g = stack.gradients(stack.layers(vec), x[:k, :, at:at + run.batch],
                            y[:k, at:at + run.batch], real)
        g /= sizes[:, None]
        step = run.steps + t + 1
        m *= BETA1
        m += np.multiply(g, 1 - BETA1, out=s)
        v *= BETA2
        np.multiply(g, 1 - BETA2, out=s)
        s *= g
        v += s
        np.sqrt(v, out=s)
        s *= (1 - BETA2 ** step) ** -0.5
        s += EPS
        np.multiply(m, run.lr / (1 - BETA1 ** step), out=g)
        g /= s
        vec -= g
    return *(a[:, stack.back] for a in state), steps


def _measured(run: _Run, x: np.ndarray, y: np.ndarray, part: np.ndarray, splits: int) -> np.ndarray:
    """Count, loss and hits of the first weights on every split; ``part`` numbers the
    rows' splits, ``x`` is (inputs, rows) and goes on to a whole number of
    ``MEASURED_ROWS``, which are taken together so that they stay in the cache."""
    stack = Stack(run.sizes, run.activation, 1, MEASURED_ROWS)
    layers, p = stack.layers(run.vec[None, stack.order]), np.empty(x.shape[1])
    for at in range(0, len(p), MEASURED_ROWS):
        rows = slice(at, at + MEASURED_ROWS)
        p[rows] = stack.forward(layers, x[None, :, rows])[0, 0]
    p = p[:len(y)]
    return np.column_stack([np.bincount(part, w, splits) for w in (
        np.ones(len(y)), log_loss(y, p), (p >= 0.5) == (y == 1))]).ravel()


def _pass(runs: dict[int, _Run], epoch: int, seed: int, width: int):
    """mapInArrow body: per network the weighted sums of the blocks' weights,
    moments and steps, then per split the count, loss and hits of the first weights."""
    most = max(run.batch for run in runs.values())

    def work(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STACKED):
                some = batch.slice(at, STACKED)
                n = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1)
                x = some.column(2).flatten().to_numpy().reshape(-1, width)
                y = some.column(3).flatten().to_numpy()
                starts = np.cumsum([0, *n.sum(axis=1)])
                falling = np.argsort(-n[:, 0], kind="stable")
                trained = n[falling, 0]
                order = np.zeros((len(n), int(trained.max(initial=0))), np.int64)
                blocks = some.column(0).to_pylist()
                for row, b in zip(order, falling.tolist()):
                    row[:n[b, 0]] = np.random.default_rng((seed, epoch, int(blocks[b]))) \
                        .permutation(np.arange(n[b, 0])) + starts[b]
                xs, ys = dealt(x, y, order, most)
                part = np.repeat(np.tile(np.arange(n.shape[1]), len(n)), n.ravel())
                every = np.zeros((width, -(-len(y) // MEASURED_ROWS) * MEASURED_ROWS))
                every[:, :len(y)] = x.T
                weights = trained.astype(float)
                for k, run in runs.items():
                    measured = _measured(run, every, y, part, n.shape[1])
                    *state, steps = _together(run, xs, ys, trained)
                    row = np.concatenate([*(weights @ a for a in state), [weights @ steps],
                                          [weights.sum()], measured])
                    sums[k] = sums[k] + row if k in sums else row
        for k, row in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), k, np.int32)),
                 pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], ["k", "i", "v"])
    return work


def train_shared(data: DataFrame, features: Sequence[str], label: str, configs: Sequence[dict],
                 key: str, split_col: str = "split", train: str = "train", val: str = "val",
                 test: str = "test", epochs: int = 100, batch: int = 128, lr: float = 1e-3,
                 patience: int = 10, min_delta: float = 1e-4, seed: int = 42,
                 block_rows: int = BLOCK_ROWS) -> list[Trained]:
    """Train one network per config (``hidden`` and optionally ``activation``,
    ``lr``, ``batch``, ``epochs``, ``run_id``) side by side; results in config
    order.  Without validation rows the training loss decides."""
    ship_package(data.sparkSession)
    width = len(features)
    runs: dict[int, _Run] = {}
    for k, cfg in enumerate(configs):
        sizes = [width, *cfg["hidden"], 1]
        vec = flatten(init_layers(sizes, seed, cfg.get("activation", "sigmoid")))
        runs[k] = _Run(sizes, cfg.get("activation", "sigmoid"), cfg.get("lr", lr),
                       cfg.get("batch", batch), cfg.get("epochs", epochs), vec,
                       np.zeros_like(vec), np.zeros_like(vec))
    splits, passes = (train, val, test), 0
    blocks = blocks_of(data, features, label, key, split_col, seed, block_rows, splits)
    while any(not r.done for r in runs.values()):
        active = {k: r for k, r in runs.items() if not r.done}
        rows = (blocks.mapInArrow(_pass(active, passes, seed, width),
                                  "k int, i int, v double")
                .groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow())
        got = {k: np.zeros(3 * n_parameters(r.sizes) + 2 + 3 * len(splits))
               for k, r in active.items()}
        for k, i, v in zip(*(rows[c].to_pylist() for c in ("k", "i", "v"))):
            got[k][i] = v
        for k, r in active.items():
            _take(r, got[k], configs[k].get("run_id", f"config_{k}"), passes, patience, min_delta)
        passes += 1
    blocks.unpersist()
    out = []
    for r in runs.values():
        _, vec, epoch, accuracy = r.best
        model = MLP([(w.tolist(), b.tolist()) for w, b in unflatten(vec, r.sizes)],
                    r.activation, "sigmoid")
        out.append(Trained(model, r.history, epoch, r.early, accuracy, passes))
    return out


def _take(r: _Run, sums: np.ndarray, run_id: str, epoch: int, patience: int,
          min_delta: float) -> None:
    """Judge the weights the pass began with (those after ``epoch`` epochs), then
    move on to the averages."""
    n = n_parameters(r.sizes)
    trained, measured = sums[3 * n + 1], sums[3 * n + 2:].reshape(-1, 3)
    (tl, ta), (vl, va), (_, xa) = (
        (float(loss / k), float(hits / k)) if k else (None, None) for k, loss, hits in measured)
    if epoch:
        r.history.append({"run_id": run_id, "epoch": epoch, "train_loss": tl, "val_loss": vl,
                          "train_accuracy": ta, "val_accuracy": va})
    decisive = vl if vl is not None else tl
    if r.best[1] is None or (decisive is not None and decisive < r.best[0] - min_delta):
        r.best = (float("inf") if decisive is None else decisive, r.vec, epoch, xa)
        r.waited = 0
    else:
        r.waited += 1
        r.early = r.waited >= patience
    if r.early or epoch >= r.epochs or not trained:
        r.done = True
        return
    r.vec, r.m, r.v = (sums[i * n:(i + 1) * n] / trained for i in range(3))
    r.steps += max(1, round(sums[3 * n] / trained))


def sweep_rows(configs: Sequence[dict], trained: Sequence[Trained]) -> list[dict]:
    """One result row per configuration."""
    return [{"config_idx": k, "hidden": "x".join(map(str, cfg["hidden"])),
             "activation": cfg.get("activation", "sigmoid"),
             "val_loss": min((h["val_loss"] for h in t.history if h["val_loss"] is not None),
                             default=None),
             "test_accuracy": t.test_accuracy, "epochs": len(t.history),
             "best_epoch": t.best_epoch, "stopped_early": t.stopped_early}
            for k, (cfg, t) in enumerate(zip(configs, trained))]
