"""Dense networks in numpy: weights, forward pass and gradients of the binary
cross-entropy.  Small helpers of the trainers, which run them inside tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def init_layers(sizes: Sequence[int], seed: int, activation: str = "sigmoid") -> list:
    """Uniform random weights scaled to the layer (He for relu, Glorot otherwise)."""
    rng = np.random.RandomState(seed)
    layers = []
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / n_in if activation == "relu" else 6.0 / (n_in + n_out))
        layers.append((rng.uniform(-lim, lim, (n_out, n_in)), np.zeros(n_out)))
    return layers


def n_parameters(sizes: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(sizes[:-1], sizes[1:]))


def flatten(layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])


def unflatten(vec: np.ndarray, sizes: Sequence[int]) -> list:
    out, pos = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        w = vec[pos: pos + n_in * n_out].reshape(n_out, n_in)
        pos += n_in * n_out
        b = vec[pos: pos + n_out]
        pos += n_out
        out.append((w, b))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _forward(layers, activation: str, x: np.ndarray) -> tuple[list, list]:
    acts, pre = [x], []
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w.T + b
        pre.append(z)
        if i == len(layers) - 1:
            acts.append(_sigmoid(z[:, 0]))
        else:
            acts.append(np.maximum(z, 0) if activation == "relu" else _sigmoid(z))
    return acts, pre


def probabilities(layers, activation: str, x: np.ndarray) -> np.ndarray:
    return _forward(layers, activation, x)[0][-1]


def log_loss(y: np.ndarray, p: np.ndarray, eps: float = 1e-7) -> np.ndarray:
    """Binary cross-entropy of each row, the probability clipped."""
    p = np.clip(p, eps, 1 - eps)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def gradient(layers, activation: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the rows of the loss's gradient (flat), and the probabilities."""
    acts, pre = _forward(layers, activation, x)
    delta = (acts[-1] - y)[:, None]                       # dL/dz of the output
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append((delta.T @ acts[i], delta.sum(axis=0)))
        if i > 0:
            da = delta @ layers[i][0]
            if activation == "relu":
                delta = da * (pre[i - 1] > 0)
            else:
                delta = da * acts[i] * (1 - acts[i])
    return flatten(list(reversed(grads))), acts[-1]


class Stack:
    """Copies of one network, each with weights of its own, that take their steps
    together: a matrix product or an element-wise call goes over all copies.

    A layer's weights and biases lie side by side here (``units x (inputs + 1)``),
    and activations are ``(inputs + 1) x rows`` with a last row of ones, so that
    biases need no calls of their own.  ``weights``, ``m`` and ``v`` are matrices
    of a row per copy in that order; ``back`` brings them into ``flatten``'s."""

    def __init__(self, sizes: Sequence[int], activation: str, copies: int, rows: int):
        self.activation, own, order = activation, np.arange(n_parameters(sizes)), []
        for w, b in unflatten(own, sizes):
            order.append(np.column_stack([w, b]).ravel())
        self.order = np.concatenate(order)
        self.back = np.argsort(self.order)
        self.shapes = [(n_out, n_in + 1) for n_in, n_out in zip(sizes[:-1], sizes[1:])]
        self.grads = np.empty((copies, len(own)))
        self.acts = [np.ones((copies, n_in, rows)) for _, n_in in self.shapes]
        self.last = np.empty((copies, 1, rows))
        self.deltas = [np.empty((copies, n_in, rows)) for _, n_in in self.shapes[1:]]

    def layers(self, weights: np.ndarray) -> list[np.ndarray]:
        """Views of ``weights`` as one stack of matrices per layer."""
        out, at = [], 0
        for n_out, n_in in self.shapes:
            out.append(weights[..., at:at + n_out * n_in].reshape(*weights.shape[:-1], n_out, n_in))
            at += n_out * n_in
        return out

    def _activate(self, z: np.ndarray, output: bool = False) -> None:
        if self.activation == "relu" and not output:
            np.maximum(z, 0, out=z)
            return
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)

    def forward(self, layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """Probabilities of ``x`` (copies, inputs, rows), (copies, 1, rows).  The
        element-wise calls take the ones along, so that they run over whole blocks
        of memory."""
        k = len(x)
        self.acts[0][:k, :-1] = x
        for i, w in enumerate(layers[:-1]):
            a = self.acts[i + 1][:k]
            np.matmul(w, self.acts[i][:k], out=a[:, :-1])
            self._activate(a)
            a[:, -1] = 1
        np.matmul(layers[-1], self.acts[-1][:k], out=self.last[:k])
        self._activate(self.last[:k], output=True)
        return self.last[:k]

    def gradients(self, layers: list[np.ndarray], x: np.ndarray, y: np.ndarray,
                  real: np.ndarray | None = None) -> np.ndarray:
        """Sums over the rows of the loss's gradients, a row per copy; ``y`` and
        ``real`` (0 for a row that is not there) are (copies, rows)."""
        k = len(x)
        delta = self.forward(layers, x)
        delta -= y[:, None]
        if real is not None:
            delta *= real[:, None]
        for i, grad in reversed(list(enumerate(self.layers(self.grads[:k])))):
            a = self.acts[i][:k]
            np.matmul(delta, a.transpose(0, 2, 1), out=grad)
            if i > 0:
                da = self.deltas[i - 1][:k]               # its last row is of no use
                np.matmul(layers[i].transpose(0, 2, 1), delta, out=da)
                if self.activation == "relu":
                    da *= a > 0
                else:
                    da *= a
                    da *= 1 - a
                delta = da[:, :-1]
        return self.grads[:k]
