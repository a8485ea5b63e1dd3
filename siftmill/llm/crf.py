"""A linear-chain conditional random field over batches of padded chains, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights of features by label, of transitions, and of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def padded(emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of all items, chain after chain, as (chains, longest, labels), and which places are real."""
    real = np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]
    out = np.zeros((*real.shape, emissions.shape[1]), dtype=emissions.dtype)
    out[real] = emissions
    return out, real


def forward_backward(chain: Chain, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Marginals of every item, and with ``pairs`` the sums of the marginals of first labels and of transitions too."""
    e, real = padded(emissions, lengths)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    move = np.exp(chain.moves - chain.moves.max()).astype(e.dtype)
    start = np.exp(chain.start - chain.start.max()).astype(e.dtype)
    steps = e.shape[1]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = start * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(real[:, t + 1, None], b, 1.0)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    if not pairs:
        return gamma[real]
    joint = alpha[:, :-1, :, None] * move[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= np.maximum(joint.sum(axis=(2, 3), keepdims=True), 1e-30)
    return gamma[real], gamma[:, 0].sum(axis=0), (joint * real[:, 1:, None, None]).sum(axis=(0, 1))


def viterbi(chain: Chain, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every item."""
    e, real = padded(emissions, lengths)
    n, steps, k = e.shape
    back = np.zeros((n, steps, k), dtype=np.int64)
    best = chain.start + e[:, 0]
    for t in range(1, steps):
        through = best[:, :, None] + chain.moves[None]
        back[:, t] = through.argmax(axis=1)
        best = np.where(real[:, t, None], through.max(axis=1) + e[:, t], best)
    labels = np.zeros((n, steps), dtype=np.int64)
    last = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        labels[:, t] = last
        last = np.where(real[:, t], back[np.arange(n), t, last], last)
    return labels[real]


def summed(weights: np.ndarray, ids: np.ndarray, owner_starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``ids`` of the weights by owner; every owner has at least one id."""
    return np.add.reduceat(weights[ids], owner_starts, axis=0)


def fit(ids: np.ndarray, starts: np.ndarray, gold: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Chain:
    """Maximum likelihood by Adam over mini-batches of chains.

    ``ids`` are the features of all items one after another, ``starts`` where each item's begin, ``gold`` the items'
    labels and ``lengths`` the items of each chain.
    """
    rng = np.random.default_rng(seed)
    shapes = [(n_features, n_labels), (n_labels, n_labels), (n_labels,)]
    theta = [np.zeros(s, dtype=np.float32) for s in shapes]
    m, v = ([np.zeros(s, dtype=np.float32) for s in shapes] for _ in range(2))
    ends = np.r_[starts[1:], len(ids)]
    chain_ends = np.cumsum(lengths)
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // batch)):
            items = np.concatenate([np.arange(chain_ends[c] - lengths[c], chain_ends[c]) for c in chosen])
            sizes = ends[items] - starts[items]
            flat = np.concatenate([ids[starts[i] : ends[i]] for i in items])
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            chain = Chain(*theta)
            gamma, first, moved = forward_backward(chain, summed(theta[0], flat, at), lengths[chosen], pairs=True)
            want = np.eye(n_labels, dtype=np.float32)[gold[items]]
            miss = np.repeat(want - gamma, sizes, axis=0)
            grads = [np.stack([np.bincount(flat, miss[:, k], n_features) for k in range(n_labels)], axis=1)]
            begins = np.r_[0, np.cumsum(lengths[chosen])[:-1]]
            inner = np.ones(len(items), dtype=bool)
            inner[begins] = False
            seen = np.zeros((n_labels, n_labels))
            np.add.at(seen, (gold[items[np.flatnonzero(inner) - 1]], gold[items[inner]]), 1)
            grads += [seen - moved, want[begins].sum(axis=0) - first]
            step += 1
            for k, g in enumerate(grads):
                g = (g / len(chosen) - decay * theta[k]).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Chain(*theta)
