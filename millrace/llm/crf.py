"""A skip-chain conditional random field over sequences of tokens or mentions.

Neighbouring nodes share transition potentials; linked nodes share a skip
potential, however far apart. The weights are trained
by pseudo-likelihood, which is convex and needs no inference. Decoding is loopy
belief propagation: exact forward-backward passes along the chains alternate
with messages over the skip edges, for many sequences at once, until a
sequence's messages settle, so that evidence reaches every occurrence.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

#: Messages that change by no more than this have settled.
SETTLED = 1e-3
#: Rounds beyond those that a message needs from end to end of the skip edges.
#: Loops may keep messages from settling.
MORE_ROUNDS = 4
#: Cells (sequences x length) decoded at once.
CELLS = 24_000


@dataclass
class Sequence:
    """Features of each node, pairs of positions that share a skip edge, and the
    labels that a node may have (all of them where none are given)."""

    features: list[list[str]]
    skips: list[tuple[int, int]]
    may: list[list[int]] | None = None

    def barred(self, labels: int) -> np.ndarray:
        """Nodes x labels: -60 for what a node can't be."""
        out = np.zeros((len(self.features), labels), np.float32)
        if self.may is not None:
            out[:] = -60
            for i, ys in enumerate(self.may):
                out[i, ys] = 0
        return out


@dataclass
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x labels; the last row is for unknown ones
    transitions: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels

    def encode(self, features: list[list[str]], width: int) -> np.ndarray:
        get, unknown = self.index.get, len(self.index)
        return np.array([[get(f, unknown) for f in fs] + [unknown] * (width - len(fs)) for fs in features], np.int32).reshape(len(features), width)


def kind_of(label: str) -> str:
    return label[2:] if label[:2] in ("B-", "I-") else label


def allowed(labels: list[str]) -> np.ndarray:
    """Which label may follow which: I only inside its own kind."""
    return np.array([[not b.startswith("I-") or kind_of(a) == kind_of(b) for b in labels] for a in labels])


def train(sequences: list[Sequence], answers: list[list[int]], labels: list[str], most_features: int = 60_000, epochs: int = 10, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> Model:
    """Weights by pseudo-likelihood. An answer of -1 leaves a token out, both as
    an example and as a neighbour. Features seen once are dropped."""
    counts = Counter(f for s in sequences for fs in s.features for f in set(fs))
    index = {f: i for i, (f, _) in enumerate((f, n) for f, n in counts.most_common(most_features) if n > 1)}
    n = len(labels)
    model = Model(labels, index, np.zeros((len(index) + 1, n), np.float32), np.zeros((n, n), np.float32), np.zeros((n, n), np.float32))
    ok = allowed(labels)
    # One more label stands for "no neighbour" or "not known"; its potentials stay 0.
    width = max((len(fs) for s in sequences for fs in s.features), default=1)
    rows, y, before, after, skips, barred, at = [], [], [], [], [], [], 0
    for s, a in zip(sequences, answers):
        k = len(a)
        rows.append(model.encode(s.features, width))
        barred.append(s.barred(n))
        known = [n if v < 0 else v for v in a]
        y += a
        before += [n, *known[:-1]] if k else []
        after += [*known[1:], n] if k else []
        skips += [(at + i, at + j) for i, j in s.skips]
        at += k
    if not at:
        return model
    rows, barred, y, before, after = np.concatenate(rows), np.concatenate(barred), np.array(y), np.array(before), np.array(after)
    neighbours: list[list[int]] = [[] for _ in range(at)]
    for i, j in skips:
        if y[i] >= 0 and y[j] >= 0:
            neighbours[i].append(y[j])
            neighbours[j].append(y[i])
    most = max(1, *map(len, neighbours))
    linked = np.full((at, most), n)
    for i, v in enumerate(neighbours):
        linked[i, : len(v)] = v
    examples = np.flatnonzero(y >= 0)
    same = np.array([[a == b or kind_of(a) == kind_of(b) for b in labels] for a in labels])
    groups = np.where(same, np.where(np.array([kind_of(a) == "O" for a in labels])[:, None], 0, 1), 2)
    theta = np.zeros(3, np.float32)  # both outside, same kind, different kinds
    t_full, w = np.zeros((n + 1, n), np.float32), model.weights
    a_full = np.zeros((n + 1, n), np.float32)
    t, gw, gt, gs = model.transitions, np.full_like(w, 1e-6), np.full((n, n), 1e-6, np.float32), np.full(3, 1e-6, np.float32)
    forbidden = np.where(ok, 0, -30).astype(np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(examples)
        for start in range(0, len(examples), 4096):
            e = examples[start : start + 4096]
            # Half of the neighbours are hidden, at random: else a neighbour's label
            # gives the answer away and the observations learn nothing.
            left, right, *others = (np.where(rng.random(len(e)) < 0.5, n, x[e]) for x in (before, after, *linked.T))
            t_full[:n], a_full[:n] = t + forbidden, (t + forbidden).T
            s_full = np.vstack([theta[groups], np.zeros((1, n), np.float32)])
            score = barred[e] + w[rows[e]].sum(1) + t_full[left] + a_full[right] + sum(s_full[o] for o in others)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(e)), y[e]] -= 1
            p /= len(e)
            g = np.zeros_like(w)
            np.add.at(g, rows[e].ravel(), np.repeat(p, width, axis=0))
            g += l2 * w
            g[-1] = 0
            d = np.zeros((n + 1, n), np.float32)
            np.add.at(d, left, p)
            u = np.zeros((n + 1, n), np.float32)
            np.add.at(u, right, p)
            step_t = d[:n] + u[:n].T + l2 * t
            step_s = np.zeros(3, np.float32)
            for other in others:
                has = other < n
                np.add.at(step_s, groups[other[has]], p[has])
            gw += g * g
            gt += step_t * step_t
            gs += step_s * step_s
            w -= rate * g / np.sqrt(gw)
            t -= rate * step_t / np.sqrt(gt)
            theta -= rate * step_s / np.sqrt(gs)
            theta[:2], theta[2] = np.maximum(theta[:2], 0), min(theta[2], 0)  # a skip edge only draws together
    model.transitions, model.skip = t + forbidden, theta[groups]
    return model


def decode(model: Model, sequences: list[Sequence]) -> list[np.ndarray]:
    """The label of highest belief for every token of every sequence."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if s.features), key=lambda i: len(sequences[i].features))
    at = 0
    while at < len(order):
        end, longest = at + 1, len(sequences[order[at]].features)
        while end < len(order) and (end + 1 - at) * len(sequences[order[end]].features) <= CELLS:
            longest = len(sequences[order[end]].features)
            end += 1
        part = order[at:end]
        for i, labels in zip(part, _decode_batch(model, [sequences[i] for i in part], longest)):
            out[i] = labels
        at = end
    return out


def _decode_batch(model: Model, sequences: list[Sequence], longest: int) -> list[np.ndarray]:
    n, batch = len(model.labels), len(sequences)
    unary = np.zeros((longest, batch, n), np.float32)
    lengths = np.array([len(s.features) for s in sequences])
    for b, s in enumerate(sequences):
        width = max(len(fs) for fs in s.features)
        unary[: len(s.features), b] = model.weights[model.encode(s.features, width)].sum(1) + s.barred(n)
    unary -= unary.max(2, keepdims=True)
    potential = np.exp(np.maximum(unary, -60))
    padding = np.arange(longest)[:, None] >= lengths
    potential[padding] = 1
    first = potential[0]
    first[:, [label.startswith("I-") for label in model.labels]] *= 1e-12
    edges = [(i, j, b) for b, s in enumerate(sequences) for i, j in s.skips]
    chain = np.exp(np.clip(model.transitions, -30, 30)).astype(np.float32)
    if not edges:
        return _labels(_beliefs(potential, chain), lengths)
    i, j, b = (np.array(x) for x in zip(*edges))
    shared = np.exp(np.clip(model.skip, -30, 30)).astype(np.float32)
    to_i, to_j = (np.full((len(edges), n), 1 / n, np.float32) for _ in range(2))
    live, most = np.bincount(b, minlength=batch) > 0, np.array([_longest_path(s.skips) + MORE_ROUNDS for s in sequences])
    done = 0
    while live.any():
        # Only the sequences whose messages still change.
        columns, e = np.flatnonzero(live), np.flatnonzero(live[b])
        x, y, z = i[e], j[e], (np.cumsum(live) - 1)[b[e]]
        now = potential[:, columns]
        np.multiply.at(now, (x, z), to_i[e] * n)
        np.multiply.at(now, (y, z), to_j[e] * n)
        belief = _beliefs(now, chain)
        to_j_next = (belief[x, z] / np.maximum(to_i[e], 1e-12)) @ shared
        to_i_next = (belief[y, z] / np.maximum(to_j[e], 1e-12)) @ shared.T
        to_j_next /= to_j_next.sum(1, keepdims=True)
        to_i_next /= to_i_next.sum(1, keepdims=True)
        change = np.maximum(np.abs(to_j_next - to_j[e]), np.abs(to_i_next - to_i[e])).max(1)
        to_i[e], to_j[e] = to_i_next, to_j_next
        done += 1
        live = np.zeros(batch, bool)
        live[b[e[change > SETTLED]]] = True
        live &= done < most
    now = potential.copy()
    np.multiply.at(now, (i, b), to_i * n)
    np.multiply.at(now, (j, b), to_j * n)
    return _labels(_beliefs(now, chain), lengths)


def _longest_path(skips: list[tuple[int, int]]) -> int:
    """Edges of the longest chain of occurrences; edges are in order of their later end."""
    upto: dict[int, int] = {}
    for i, j in skips:
        upto[j] = max(upto.get(j, 0), upto.get(i, 0) + 1)
    return max(upto.values(), default=0)


def _beliefs(potential: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Exact marginals along the chains, scaled at every step."""
    forward = np.empty_like(potential)
    backward = np.ones_like(potential)
    forward[0] = potential[0] / potential[0].sum(1, keepdims=True)
    for t in range(1, len(potential)):
        step = (forward[t - 1] @ chain) * potential[t]
        forward[t] = step / np.maximum(step.sum(1, keepdims=True), 1e-30)
    back = chain.T.copy()
    for t in range(len(potential) - 2, -1, -1):
        step = (backward[t + 1] * potential[t + 1]) @ back
        backward[t] = step / np.maximum(step.sum(1, keepdims=True), 1e-30)
    belief = forward * backward
    return belief / np.maximum(belief.sum(2, keepdims=True), 1e-30)


def _labels(belief: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    best = belief.argmax(2)
    return [best[:k, b] for b, k in enumerate(lengths)]
