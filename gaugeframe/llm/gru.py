"""A bidirectional gated recurrent network with attention pooling, in numpy.

Texts are sequences of word pieces. A piece is read byte by byte by a recurrent layer whose
states are pooled by attention; the result, next to a learned vector of the piece if it is a known
word, is the input of a second such layer over the pieces of a window. A linear unit on the
pooled states gives the logit. Pieces of one length are worked on together, and a window with too few
pieces reads them again, so nothing is padded.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BYTE_DIM, BYTE_HIDDEN, WORD_DIM, WORD_HIDDEN, ATTENTION = 8, 8, 8, 12, 8
BATCH = 512


class Pieces(NamedTuple):
    """Distinct pieces: bytes ``data[start:end]`` and the number of the known word (0: none)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray


def initial(known_words: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights by name; those of recurrent layers are (gate, direction, ...), gates being update, reset and new state."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 1.5 / np.sqrt(shape[-2])).astype(np.float32)

    net = {"bytes": 0.5 * rng.standard_normal((256, BYTE_DIM)).astype(np.float32), "words": np.zeros((known_words + 1, WORD_DIM), dtype=np.float32)}
    for name, inputs, hidden in (("b", BYTE_DIM, BYTE_HIDDEN), ("w", 2 * BYTE_HIDDEN + WORD_DIM, WORD_HIDDEN)):
        net |= {
            f"{name}_in": normal(3, 2, inputs, hidden), f"{name}_bias": np.zeros((3, 2, hidden), dtype=np.float32),
            f"{name}_state": normal(3, 2, hidden, hidden), f"{name}_att": normal(2 * hidden, ATTENTION), f"{name}_ask": normal(ATTENTION, 1)[:, 0],
        }
    return net | {"out": normal(2 * WORD_HIDDEN, 1)[:, 0], "offset": np.zeros(1, dtype=np.float32)}


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: as a hyperbolic tangent, at a fifth of its cost."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``squash`` where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


def recur(inputs: np.ndarray, weights: np.ndarray, keep: bool = False):
    """States (2, T, B, H) of both directions from projected inputs (3, 2, T, B, H), each in its own order of time."""
    _, _, steps, batch, h = inputs.shape
    state = np.zeros((2, batch, h), dtype=np.float32)
    states = np.empty((2, steps, batch, h), dtype=np.float32)
    kept = []
    for t in range(steps):
        from_state = state @ weights
        gates = squash(from_state[:2] + inputs[:2, :, t])
        gates *= 0.5
        gates += 0.5
        update, reset = gates
        new = reset * from_state[2]
        new += inputs[2, :, t]
        squash(new)
        if keep:
            kept.append((state, from_state[2], update, reset, new))
        state = state - new
        state *= update
        state += new
        states[:, t] = state
    return states, kept


def recur_back(d_states: np.ndarray, kept: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the state weights."""
    _, steps, batch, h = d_states.shape
    d_inputs = np.empty((3, 2, steps, batch, h), dtype=np.float32)
    d_weights = np.zeros_like(weights)
    d_state = np.zeros((2, batch, h), dtype=np.float32)
    back = weights.transpose(0, 1, 3, 2)
    for t in range(steps - 1, -1, -1):
        state, from_new, update, reset, new = kept[t]
        d = d_state + d_states[:, t]
        d_new = d * (1 - update) * slope(new)
        d_from = np.stack([d * (state - new) * 0.5 * slope(2 * update - 1), d_new * from_new * 0.5 * slope(2 * reset - 1), d_new * reset])
        d_inputs[:2, :, t] = d_from[:2]
        d_inputs[2, :, t] = d_new
        d_state = d * update + (d_from @ back).sum(axis=0)
        d_weights += state.transpose(0, 2, 1) @ d_from
    return d_inputs, d_weights


def both(states: np.ndarray) -> np.ndarray:
    """(T, B, 2H): the states of both directions at each place."""
    return np.concatenate([states[0], states[1, ::-1]], axis=2)


def apart(d_states: np.ndarray) -> np.ndarray:
    """The reverse of ``both``, for gradients."""
    h = d_states.shape[2] // 2
    return np.stack([d_states[..., :h], d_states[::-1, :, h:]])


def pooled(states: np.ndarray, att: np.ndarray, ask: np.ndarray):
    """Attention-weighted mean over time, and what its gradient needs."""
    seen = squash(states @ att)
    weight = seen @ ask
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return (weight[..., None] * states).sum(axis=0), (seen, weight)


def pooled_back(d: np.ndarray, states: np.ndarray, cache, att: np.ndarray, ask: np.ndarray):
    seen, weight = cache
    d_weight = np.einsum("bh,tbh->tb", d, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d_seen = d_score[..., None] * ask * slope(seen)
    d_states = weight[..., None] * d + d_seen @ att.T
    return d_states, np.einsum("tbh,tbk->hk", states, d_seen), np.einsum("tbk,tb->k", seen, d_score)


def looked_up(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` (T, B) of (3, 2, n, H) as (3, 2, T, B, H), the second direction in reversed time."""
    out = np.empty((3, 2, *at.shape, table.shape[3]), dtype=np.float32)
    for gate in range(3):
        np.take(table[gate, 0], at, axis=0, out=out[gate, 0], mode="clip")
        np.take(table[gate, 1], at[::-1], axis=0, out=out[gate, 1], mode="clip")
    return out


def looked_up_back(d_inputs: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """Gradient of the table from that of ``looked_up``."""
    out = np.zeros((3, 2, rows, d_inputs.shape[4]), dtype=np.float32)
    for direction, places in ((0, at), (1, at[::-1])):
        order = np.argsort(places, axis=None, kind="stable")
        ranked = places.ravel()[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        for gate in range(3):
            flat = d_inputs[gate, direction].reshape(places.size, -1)
            out[gate, direction, ranked[first]] = np.add.reduceat(flat[order], first, axis=0)
    return out


def groups(length: np.ndarray, size: int = BATCH):
    """Rows of equal length, at most ``size`` together."""
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order])) + 1
    for rows in np.split(order, edges):
        for first in range(0, len(rows), size):
            yield rows[first : first + size]


def piece_vectors(net: dict, pieces: Pieces, keep: bool = False):
    """Pooled states of the bytes of each piece (n, 2 * BYTE_HIDDEN)."""
    length = pieces.end - pieces.start
    out = np.empty((len(length), 2 * BYTE_HIDDEN), dtype=np.float32)
    table = net["bytes"] @ net["b_in"] + net["b_bias"][:, :, None]
    caches = []
    for rows in groups(length, 4 * BATCH):
        if not len(rows):
            continue
        read = pieces.data[pieces.start[rows] + np.arange(length[rows[0]])[:, None]]
        states, kept = recur(looked_up(table, read), net["b_state"], keep)
        states = both(states)
        out[rows], cache = pooled(states, net["b_att"], net["b_ask"])
        if keep:
            caches.append((rows, read, states, kept, cache))
    return out, caches


def projections(net: dict, pieces: Pieces) -> np.ndarray:
    """(3, 2, n, H): what each piece puts into the layer over pieces."""
    vectors, _ = piece_vectors(net, pieces)
    return np.concatenate([vectors, net["words"][pieces.word]], axis=1) @ net["w_in"] + net["w_bias"][:, :, None]


def spread(start: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """Places (steps, n) of windows; a shorter one is read again until it fills the steps."""
    return start + np.arange(steps)[:, None] % length


def logits(net: dict, projected: np.ndarray, tokens: np.ndarray, start: np.ndarray, length: np.ndarray, steps: int) -> np.ndarray:
    """The logit of each window ``tokens[start:start + length]`` of piece numbers."""
    out = np.empty(len(start), dtype=np.float32)
    for first in range(0, len(start), BATCH):
        rows = slice(first, first + BATCH)
        states, _ = recur(looked_up(projected, tokens[spread(start[rows], length[rows], steps)]), net["w_state"])
        out[rows] = pooled(both(states), net["w_att"], net["w_ask"])[0] @ net["out"] + net["offset"][0]
    return out


def gradients(net: dict, pieces: Pieces, window: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean logistic loss of windows (T, B) of piece numbers, and its gradient."""
    vectors, caches = piece_vectors(net, pieces, keep=True)
    x = np.concatenate([vectors, net["words"][pieces.word]], axis=1)
    projected = x @ net["w_in"] + net["w_bias"][:, :, None]
    states, kept = recur(looked_up(projected, window), net["w_state"], keep=True)
    states = both(states)
    top, cache = pooled(states, net["w_att"], net["w_ask"])
    z = top @ net["out"] + net["offset"][0]
    share = weight / weight.sum()
    loss = float((share * (np.logaddexp(0, z) - y * z)).sum())
    d_z = (share * (1 / (1 + np.exp(-z)) - y)).astype(np.float32)
    grad = {"out": top.T @ d_z, "offset": d_z.sum(keepdims=True)}
    d_states, grad["w_att"], grad["w_ask"] = pooled_back(d_z[:, None] * net["out"], states, cache, net["w_att"], net["w_ask"])
    d_inputs, grad["w_state"] = recur_back(apart(d_states), kept, net["w_state"])
    d_projected = looked_up_back(d_inputs, window, len(x))
    grad["w_bias"] = d_projected.sum(axis=2)
    grad["w_in"] = x.T @ d_projected
    d_x = (d_projected @ net["w_in"].transpose(0, 1, 3, 2)).sum(axis=(0, 1))
    grad["words"] = np.zeros_like(net["words"])
    np.add.at(grad["words"], pieces.word, d_x[:, 2 * BYTE_HIDDEN :])
    grad["words"][0] = 0
    d_vectors = d_x[:, : 2 * BYTE_HIDDEN]
    d_table = np.zeros((3, 2, 256, BYTE_HIDDEN), dtype=np.float32)
    for name in ("b_att", "b_ask", "b_state"):
        grad[name] = np.zeros_like(net[name])
    for rows, read, states, kept, cache in caches:
        d_states, att, ask = pooled_back(d_vectors[rows], states, cache, net["b_att"], net["b_ask"])
        d_inputs, state = recur_back(apart(d_states), kept, net["b_state"])
        d_table += looked_up_back(d_inputs, read, 256)
        grad["b_att"] += att
        grad["b_ask"] += ask
        grad["b_state"] += state
    grad["b_bias"] = d_table.sum(axis=2)
    grad["b_in"] = net["bytes"].T @ d_table
    grad["bytes"] = (d_table @ net["b_in"].transpose(0, 1, 3, 2)).sum(axis=(0, 1))
    return loss, grad


class Adam:
    def __init__(self, net: dict, rate: float):
        self.rate, self.t = rate, 0
        self.first = {k: np.zeros_like(v) for k, v in net.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.items()}

    def step(self, net: dict, grad: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, g in grad.items():
            g = g * clip
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            ahead = self.first[k] / (1 - 0.9**self.t)
            net[k] -= (self.rate * ahead / (np.sqrt(self.second[k] / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)
