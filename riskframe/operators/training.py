"""Training of MLP classifiers on Spark (M1-M5).

M1  one hidden sigmoid layer: Spark ML ``MultilayerPerceptronClassifier``
    (``layers=[d, h, 2]``, sigmoid hidden units, 2-way softmax = sigmoid of
    the logit difference: the same function class as d -> h -> 1 sigmoid).
M2  deeper networks with relu (not offered by Spark ML): full-batch
    gradient descent where every step is one Spark job - per-partition
    gradient sums in numpy over Arrow batches (``mapInPandas``), summed by a
    group-by on the parameter index, Adam update on the driver (the weights
    are a few hundred numbers).
M3  training in rounds of ``iters_per_round`` optimiser iterations, metrics
    per round (the history table).
M4  early stopping on validation loss with patience, best weights restored.
M5  sweep over configurations, one result row per configuration.

The training frame is checkpointed once into the shared checkpoint folder, so
every round re-reads materialised rows instead of the whole lineage.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.encoders import assemble
from riskframe.operators.metrics import bce_column
from riskframe.operators.networks import flatten as _flatten
from riskframe.operators.networks import gradient, log_loss, n_parameters
from riskframe.operators.networks import init_layers as _init_layers
from riskframe.operators.networks import unflatten as _unflatten
from riskframe.operators.scoring import MLP, mlp_from_spark, score
from riskframe.session import cut_lineage, ship_package


@dataclass
class TrainResult:
    model: MLP
    history: list = field(default_factory=list)     # dict rows
    best_round: int = 0
    seconds: float = 0.0


def round_metrics(df: DataFrame, mlp: MLP, features: Sequence[str], label: str,
                  split_col: str = "split", threshold: float = 0.5) -> dict:
    """Loss and accuracy per split for the current weights (one aggregation)."""
    scored = score(df.select(*features, split_col, label), mlp, features, "__p", None)
    rows = scored.groupBy(split_col).agg(
        F.avg(bce_column(label, "__p")).alias("loss"),
        F.avg(((F.col("__p") >= threshold).cast("int") == F.col(label)).cast("double"))
        .alias("acc")).collect()
    return {r[split_col]: (r["loss"], r["acc"]) for r in rows}


def _history_row(run_id: str, epoch: int, m: dict, train: str, val: str) -> dict:
    tl, ta = m.get(train, (None, None))
    vl, va = m.get(val, (None, None))
    return {"run_id": run_id, "epoch": epoch, "train_loss": tl, "val_loss": vl,
            "train_accuracy": ta, "val_accuracy": va}


def assembled_frame(data: DataFrame, features: Sequence[str], label: str,
                    split_col: str = "split") -> DataFrame:
    """Features, label and split with the assembled vector, materialised once
    so every round (and every configuration of a sweep) re-reads it."""
    cols = list(features)
    return cut_lineage(assemble(data.select(*cols, label, split_col), cols)
                       .withColumn("__label", F.col(label).cast("double")))


def train_mlpc(data: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int],
               split_col: str = "split", train: str = "train", val: str = "val",
               rounds: int = 10, iters_per_round: int = 10, patience: int = 3,
               min_delta: float = 1e-4, seed: int = 42, run_id: str | None = None,
               block_size: int = 128) -> TrainResult:
    """M1 + M3 + M4 with Spark ML's L-BFGS multilayer perceptron.

    ``data`` holds train and validation rows (``split_col``).  Each round
    continues from the previous weights (``initialWeights``) for
    ``iters_per_round`` iterations; validation loss decides early stopping
    and the best round's weights are returned.
    """
    t0 = time.time()
    run_id = run_id or f"mlpc_{'x'.join(map(str, hidden))}"
    cols = list(features)
    frame = (data if "features" in data.columns and "__label" in data.columns
             else assembled_frame(data, cols, label, split_col))
    train_df = frame.where(F.col(split_col) == train)
    layers = [len(cols), *hidden, 2]
    weights = None
    best = (float("inf"), None, 0)
    history, waited = [], 0
    for r in range(rounds):
        est = MultilayerPerceptronClassifier(
            layers=layers, maxIter=iters_per_round, solver="l-bfgs", seed=seed,
            blockSize=block_size, featuresCol="features", labelCol="__label")
        if weights is not None:
            est.setInitialWeights(weights)
        model = est.fit(train_df)
        weights = model.weights
        mlp = mlp_from_spark(model)
        m = round_metrics(frame, mlp, cols, label, split_col)
        history.append(_history_row(run_id, (r + 1) * iters_per_round, m, train, val))
        vloss = m.get(val, m.get(train))[0]
        if vloss < best[0] - min_delta:
            best, waited = (vloss, mlp, r), 0
        else:
            waited += 1
            if waited >= patience:
                break
    return TrainResult(best[1], history, best[2], time.time() - t0)


# --------------------------------------------------------------------------- M2
def _partition_gradients(sizes, activation, features, label, vec_bc):
    """mapInPandas body: sum of BCE gradients (and loss, count) of a partition,
    emitted as (index, value) rows - index -1 loss, -2 count."""
    def run(batches):
        layers = _unflatten(np.asarray(vec_bc.value), sizes)
        grad, loss, count = np.zeros(n_parameters(sizes)), 0.0, 0
        for pdf in batches:
            if len(pdf):
                y = pdf[label].to_numpy(dtype=float)
                g, p = gradient(layers, activation, pdf[list(features)].to_numpy(dtype=float), y)
                grad += g
                loss += float(log_loss(y, p).sum())
                count += len(y)
        idx = np.arange(len(grad), dtype=np.int64)
        yield pd.DataFrame({"i": np.concatenate([idx, [-1, -2]]),
                            "v": np.concatenate([grad, [loss, float(count)]])})
    return run


def train_dense(data: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int],
                activation: str = "relu", split_col: str = "split", train: str = "train",
                val: str = "val", steps: int = 50, lr: float = 0.05, eval_every: int = 10,
                patience: int = 3, seed: int = 42, run_id: str | None = None) -> TrainResult:
    """M2: full-batch Adam on a d -> hidden... -> 1 sigmoid network with relu
    or sigmoid hidden layers; one Spark job per step, metrics every
    ``eval_every`` steps with early stopping on validation loss."""
    t0 = time.time()
    spark = data.sparkSession
    ship_package(spark)               # the gradient function runs in Python workers
    cols = list(features)
    run_id = run_id or f"dense_{activation}_{'x'.join(map(str, hidden))}"
    frame = cut_lineage(data.select(*[F.col(c).cast("double").alias(c) for c in cols],
                                    F.col(label).cast("double").alias(label), split_col))
    train_df = frame.where(F.col(split_col) == train).select(*cols, label)
    sizes = [len(cols), *hidden, 1]
    vec = _flatten(_init_layers(sizes, seed))
    m1, m2 = np.zeros_like(vec), np.zeros_like(vec)
    b1, b2, eps = 0.9, 0.999, 1e-8
    history, best, waited = [], (float("inf"), None, 0), 0

    def as_mlp(v):
        return MLP([(w.tolist(), b.tolist()) for w, b in _unflatten(v, sizes)], activation,
                   "sigmoid")

    for step in range(1, steps + 1):
        bc = spark.sparkContext.broadcast(vec.tolist())
        parts = train_df.mapInPandas(_partition_gradients(sizes, activation, cols, label, bc),
                                     "i long, v double")
        sums = dict(parts.groupBy("i").agg(F.sum("v").alias("v")).collect())
        bc.unpersist()
        n = max(sums.get(-2, 0.0), 1.0)
        g = np.array([sums.get(i, 0.0) for i in range(len(vec))]) / n
        m1 = b1 * m1 + (1 - b1) * g
        m2 = b2 * m2 + (1 - b2) * g * g
        vec = vec - lr * (m1 / (1 - b1 ** step)) / (np.sqrt(m2 / (1 - b2 ** step)) + eps)
        if step % eval_every == 0 or step == steps:
            mlp = as_mlp(vec)
            m = round_metrics(frame, mlp, cols, label, split_col)
            history.append(_history_row(run_id, step, m, train, val))
            vloss = m.get(val, m.get(train))[0]
            if vloss < best[0] - 1e-4:
                best, waited = (vloss, mlp, step), 0
            else:
                waited += 1
                if waited >= patience:
                    break
    return TrainResult(best[1], history, best[2], time.time() - t0)


# --------------------------------------------------------------------------- M5
def sweep(data: DataFrame, features: Sequence[str], label: str, configs: Sequence[dict],
          test: str = "test", split_col: str = "split", parallelism: int = 4,
          **kw) -> tuple[list, list]:
    """Train one model per config (``{"hidden": [..], "activation": ..}``);
    returns result rows ``(config_idx, hidden, activation, val_loss,
    test_accuracy, seconds)`` and the fitted models, in config order.

    Up to ``parallelism`` configurations train at once (concurrent Spark jobs
    from driver threads, as ``CrossValidator(parallelism=n)`` does); the
    training table is materialised once and shared."""
    from concurrent.futures import ThreadPoolExecutor
    data = assembled_frame(data, features, label, split_col)
    if any(c.get("activation", "sigmoid") != "sigmoid" or c.get("trainer") == "dense"
           for c in configs):
        ship_package(data.sparkSession)

    def one(i_cfg):
        i, cfg = i_cfg
        act = cfg.get("activation", "sigmoid")
        hidden = list(cfg["hidden"])
        if act == "sigmoid" and cfg.get("trainer", "mlpc") == "mlpc":
            res = train_mlpc(data, features, label, hidden, split_col=split_col,
                             run_id=f"config_{i}", **{k: v for k, v in kw.items()
                                                      if k not in ("steps", "lr")})
        else:
            res = train_dense(data, features, label, hidden, act, split_col=split_col,
                              run_id=f"config_{i}", **{k: v for k, v in kw.items()
                                                        if k in ("steps", "lr", "seed")})
        m = round_metrics(data.where(F.col(split_col) == test), res.model, features, label,
                          split_col)
        best_hist = [h for h in res.history if h["val_loss"] is not None]
        vl = min(h["val_loss"] for h in best_hist) if best_hist else None
        return ({"config_idx": i, "hidden": "x".join(map(str, hidden)),
                 "activation": act, "val_loss": vl,
                 "test_accuracy": m.get(test, (None, None))[1],
                 "seconds": res.seconds}, res)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        done = list(pool.map(one, enumerate(configs)))
    return [d[0] for d in done], [d[1] for d in done]


def history_frame(spark, rows: list) -> DataFrame:
    """The S3 history table ``(run_id, epoch, train_loss, val_loss,
    train_accuracy, val_accuracy)``."""
    schema = ("run_id string, epoch int, train_loss double, val_loss double, "
              "train_accuracy double, val_accuracy double")
    return spark.createDataFrame([tuple(r[k] for k in ("run_id", "epoch", "train_loss", "val_loss",
                                                        "train_accuracy", "val_accuracy"))
                                  for r in rows], schema)

