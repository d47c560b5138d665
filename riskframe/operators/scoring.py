"""Batch scoring of multilayer perceptrons.

Small networks are compiled: the forward pass is written as plain Column
arithmetic (one projection per layer, hidden units as named columns), so scoring
is whole-stage-codegen work with no Python, no UDF and no model broadcast.  The
same expressions score streaming frames unchanged.

The generated code grows with the weights, and beyond the JVM's limit for one
method (64 KB) it would be interpreted.  Larger networks go through
:func:`batched_probabilities`: matrix products layer by layer over Arrow
batches, whose cost per weight does not depend on the network's depth.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import threshold
from riskframe.session import ship_package


@dataclass
class MLP:
    """Dense network: ``layers[i] = (W, b)`` with ``W[out][in]``.

    Hidden layers use ``hidden_activation`` (sigmoid or relu).  ``output`` is
    ``"sigmoid"`` (one logit -> P(class 1)) or ``"softmax2"`` (two logits, as
    Spark's MultilayerPerceptronClassifier ends; P(1) = sigmoid(z1 - z0)).
    """

    layers: list
    hidden_activation: str = "sigmoid"
    output: str = "sigmoid"

    @property
    def n_inputs(self) -> int:
        return len(self.layers[0][0][0])

    def to_json(self) -> str:
        return json.dumps({"layers": self.layers, "hidden_activation": self.hidden_activation,
                           "output": self.output})

    @classmethod
    def from_json(cls, s: str) -> "MLP":
        d = json.loads(s)
        return cls([(w, b) for w, b in d["layers"]], d["hidden_activation"], d["output"])

    def forward_numpy(self, x):
        """Reference forward pass on a numpy matrix (tests, small checks)."""
        a = np.asarray(x, dtype=float)
        for i, (w, b) in enumerate(self.layers):
            z = a @ np.asarray(w, dtype=float).T + np.asarray(b, dtype=float)
            if i < len(self.layers) - 1:
                a = 1 / (1 + np.exp(-z)) if self.hidden_activation == "sigmoid" else np.maximum(z, 0)
            else:
                a = z
        if self.output == "softmax2":
            return 1 / (1 + np.exp(-(a[:, 1] - a[:, 0])))
        return 1 / (1 + np.exp(-a[:, 0]))


def mlp_from_spark(model) -> MLP:
    """Convert a fitted ``MultilayerPerceptronClassificationModel`` with two
    output classes.  Spark stores each layer as a column-major ``out x in``
    matrix followed by the bias vector, layer after layer."""
    sizes = list(model.getLayers())
    w = model.weights.toArray().tolist()
    layers, pos = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        flat = w[pos: pos + n_in * n_out]
        pos += n_in * n_out
        mat = [[flat[o + i * n_out] for i in range(n_in)] for o in range(n_out)]
        bias = w[pos: pos + n_out]
        pos += n_out
        layers.append((mat, bias))
    if sizes[-1] != 2:
        raise ValueError("only two-class networks are compiled")
    return MLP(layers, "sigmoid", "softmax2")


def sql_double(x: float) -> str:
    """A double literal in Spark SQL text (exact round trip)."""
    return f"({float(x)!r}D)".replace("inf", "Infinity")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sigmoid(z: str) -> str:
    return f"(1.0D / (1.0D + exp(-({z}))))"


def affine(inputs: Sequence[str], w_row: Sequence[float], bias: float) -> str:
    terms = [sql_double(bias)] + [f"{x} * {sql_double(wi)}" for x, wi in zip(inputs, w_row)]
    return "(" + " + ".join(terms) + ")"


def _activate(z: str, kind: str) -> str:
    if kind == "sigmoid":
        return _sigmoid(z)
    if kind == "relu":
        return f"greatest({z}, 0.0D)"
    raise ValueError(f"unknown activation {kind}")


def probability_columns(df: DataFrame, mlp: MLP, inputs: Mapping[str, Sequence[str]],
                        keep: Sequence[str] | None = None,
                        first_preactivations: Mapping[str, Sequence[str]] | None = None
                        ) -> DataFrame:
    """Evaluate the network once per entry of ``inputs`` (output name ->
    input expressions as Spark SQL text, e.g. quoted column names) and add
    the probabilities as columns.  One projection per layer keeps every
    expression small however many evaluations are asked; the layers are
    written as SQL text so building a wide evaluation costs one call per
    column, and Catalyst sees the same expression trees as with Columns.

    ``first_preactivations`` (name -> first-layer ``W x + b`` expressions)
    lets a caller supply cheaper equivalent first-layer values (see the Sobol
    rank-one update); ``inputs`` is then ignored."""
    keep = [quote(k) for k in (keep if keep is not None else df.columns)]
    current = {name: list(cols) for name, cols in (first_preactivations or inputs).items()}
    frame = df
    n_layers = len(mlp.layers)
    for li, (w, b) in enumerate(mlp.layers):
        last = li == n_layers - 1
        exprs, nxt = [], {}
        for name, xs in current.items():
            outs = []
            for o, (w_row, bias) in enumerate(zip(w, b)):
                if li == 0 and first_preactivations is not None:
                    z = xs[o]
                else:
                    z = affine(xs, w_row, bias)
                col_name = f"__{name}_l{li}_{o}"
                exprs.append(f"{z if last else _activate(z, mlp.hidden_activation)} AS "
                             f"{quote(col_name)}")
                outs.append(quote(col_name))
            nxt[name] = outs
        frame = frame.selectExpr(*keep, *exprs)
        current = nxt
    finals = []
    for name, zs in current.items():
        p = _sigmoid(f"{zs[1]} - {zs[0]}") if mlp.output == "softmax2" else _sigmoid(zs[0])
        finals.append(f"{p} AS {quote(name)}")
    return frame.selectExpr(*keep, *finals)


#: Weights up to which a network's generated code stays well below the limit.
COMPILED_WEIGHTS = 300


def n_weights(mlp: MLP) -> int:
    return sum(len(b) * (1 + len(w[0])) for w, b in mlp.layers)


def batched_probabilities(df: DataFrame, models: Mapping[str, MLP],
                          features: Sequence[str]) -> DataFrame:
    """``df`` plus P(class 1) of each model (output name -> network) on the named
    feature columns, computed in Arrow batches; all models share one pass.  A row
    with a missing feature has NULL."""
    ship_package(df.sparkSession)
    given = df.columns
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    schema = T.StructType(fields + [T.StructField(f"p{i}", T.DoubleType())
                                    for i in range(len(models))])
    inputs = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    nets, kept = list(models.values()), len(given)

    def run(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float)
                                 for c in batch.columns[kept:]])
            known = ~np.isnan(x).any(axis=1)
            out = []
            for net in nets:
                with np.errstate(over="ignore"):
                    out.append(pa.array(net.forward_numpy(x), pa.float64(), mask=~known))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *out], schema.names)

    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)], *inputs)
    return renamed.mapInArrow(run, schema).toDF(*given, *models)


def feature_inputs(features: Sequence[str]) -> list[str]:
    """Input expressions for named feature columns (as doubles)."""
    return [f"CAST({quote(f)} AS DOUBLE)" for f in features]


def score(df: DataFrame, mlp: MLP, features: Sequence[str], output: str = "probability",
          prediction: str | None = "prediction", t: float = 0.5) -> DataFrame:
    """Append P(class 1) (and the thresholded class, ``p >= t`` -> 1)."""
    out = (probability_columns(df, mlp, {output: feature_inputs(features)})
           if n_weights(mlp) <= COMPILED_WEIGHTS
           else batched_probabilities(df, {output: mlp}, features))
    if prediction:
        out = out.withColumn(prediction, threshold(output, t))
    return out


def rule_weights(layer_sizes: Sequence[int], scale: float = 0.8, phase: float = 0.0) -> MLP:
    """A deterministic fixed-weight network (from a formula, no training);
    used as the literal-weight model of oracle checks and benchmarks."""
    import math
    layers = []
    for li, (n_in, n_out) in enumerate(zip(layer_sizes[:-1], layer_sizes[1:])):
        w = [[round(scale * math.sin(1.3 * (o + 1) + 0.7 * (i + 1) + 0.5 * li + phase), 4)
              for i in range(n_in)] for o in range(n_out)]
        b = [round(0.3 * math.cos(0.9 * (o + 1) + li + phase), 4) for o in range(n_out)]
        layers.append((w, b))
    return MLP(layers, "sigmoid", "sigmoid")
