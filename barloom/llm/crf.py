"""A linear-chain conditional random field in numpy, small enough to train on the driver.

Features are binary and hashed; every item has the same number of them.  Training
maximises the regularised log-likelihood of a small labelled table by Adam with
forward-backward over padded batches; decoding is Viterbi over many sequences at
once, one numpy step per position.
"""

from __future__ import annotations

import zlib

import numpy as np

WIDTH = 1 << 16


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """``weights`` (features x labels), ``move`` (from x to), ``first`` (label of the first item)."""

    def __init__(self, n_labels: int):
        self.weights = np.zeros((WIDTH, n_labels))
        self.move = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def fit(self, items: list[np.ndarray], labels: list[np.ndarray], *, epochs: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Crf:
        """``items``: per sequence an array (length, features each) of feature ids; ``labels``: per sequence its labels."""
        n, most, k = len(items), max(map(len, items)), len(self.first)
        ids = np.zeros((n, most, items[0].shape[1]), np.int64)
        gold, inside = np.zeros((n, most), int), np.zeros((n, most), bool)
        for i, (x, y) in enumerate(zip(items, labels, strict=True)):
            ids[i, : len(x)], gold[i, : len(x)], inside[i, : len(x)] = x, y, True
        one = np.eye(k)[gold] * inside[..., None]
        pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
        params = [self.weights, self.move, self.first]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, epochs + 1):
            emit = self.weights[ids].sum(2)
            fwd, bwd = np.zeros((n, most, k)), np.zeros((n, most, k))
            fwd[:, 0] = emit[:, 0] + self.first
            for t in range(1, most):
                x = _lse(fwd[:, t - 1, :, None] + self.move, 1) + emit[:, t]
                fwd[:, t] = np.where(inside[:, t, None], x, fwd[:, t - 1])
            for t in range(most - 2, -1, -1):
                x = _lse(self.move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(inside[:, t + 1, None], x, 0)
            z = _lse(fwd[:, -1], 1)
            prob = np.exp(fwd + bwd - z[:, None, None]) * inside[..., None]
            g_w = np.zeros_like(self.weights)
            flat = (one - prob)[inside]
            for j in range(ids.shape[2]):
                np.add.at(g_w, ids[inside][:, j], flat)
            both = inside[:, 1:]
            joint = np.exp(fwd[:, :-1, :, None] + self.move + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            grads = [g_w - decay * n * self.weights, pairs - joint.sum((0, 1)), one[:, 0].sum(0) - prob[:, 0].sum(0)]
            for p, g, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, emit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best labels of sequences that lie one after another; ``emit`` is (items, labels)."""
        out = np.zeros(len(emit), np.int64)
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        start, size = bounds[:-1][order], size[order]
        if not len(emit):
            return out
        from_ = np.zeros((len(emit), len(self.first)), np.int8)
        live = int((size > 0).sum())
        score = emit[start[:live]] + self.first
        final = np.zeros((len(size), len(self.first)))
        final[:live] = score
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t, side="left"))
            ways = score[:live, :, None] + self.move
            best = ways.argmax(1)
            at = start[:live] + t
            from_[at] = best
            score = np.take_along_axis(ways, best[:, None, :], 1)[:, 0] + emit[at]
            final[:live] = score
        full = int((size > 0).sum())
        label = final[:full].argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = start[:live] + t
            out[at] = label[:live]
            label[:live] = from_[at, label[:live]]
        return out
