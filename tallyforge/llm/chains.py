"""Linear-chain conditional random fields over many chains at once, in numpy.

Chains lie time-major: those with a position t come first, longest chain first, so each step of the
forward-backward recursion is one small matrix product for all chains.
"""

from __future__ import annotations

import numpy as np


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of chains, active chains at each step, for each time-major slot its place in the concatenated chains)."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(lengths) else np.zeros(0, int)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    places = np.concatenate([starts[:k] + t for t, k in enumerate(active)]) if longest else np.zeros(0, int)
    return order, active, places


def forward_backward(emit: np.ndarray, move: np.ndarray, first: np.ndarray, active: np.ndarray, want_pairs: bool = False):
    """Marginals of each slot, from log potentials emit (slots x labels), move (labels x labels) and first.

    With want_pairs also the expected number of moves and the log partition sum over all chains.
    """
    slots, labels = emit.shape
    top = emit.max(1, keepdims=True) if slots else emit
    e = np.exp(emit - top)
    m, begin = np.exp(move), np.exp(first)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(slots)
    at, before = 0, None
    bounds = []
    for k in active.tolist():
        here = slice(at, at + k)
        a = e[here] * (begin if before is None else alpha[before.start : before.start + k] @ m)
        s = a.sum(1)
        scale[here] = s
        alpha[here] = a / s[:, None]
        bounds.append(here)
        before, at = here, at + k
    mt = m.T
    pairs = np.zeros_like(m)
    for t in range(len(bounds) - 1, 0, -1):
        here, prev = bounds[t], bounds[t - 1]
        k = here.stop - here.start
        w = e[here] * beta[here] / scale[here][:, None]
        beta[prev.start : prev.start + k] = w @ mt
        if want_pairs:
            pairs += alpha[prev.start : prev.start + k].T @ w
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    if want_pairs:
        return marginal, pairs * m, float(np.log(scale).sum() + top.sum())
    return marginal


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        """Moves value up the gradient, in place; the caller counts t up once a round."""
        m, v = self.m.setdefault(name, np.zeros_like(value)), self.v.setdefault(name, np.zeros_like(value))
        t = self.t + 1
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value += self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
