"""A linear-chain conditional random field over sequences of feature sets: fitting and Viterbi decoding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

RATE, DECAY = 0.1, 1e-4


@dataclass(frozen=True)
class Field:
    weights: dict[str, tuple[float, ...]]      # score of each tag, by feature
    moves: tuple[tuple[float, ...], ...]       # score of tag b after tag a
    start: tuple[float, ...]

    def scores(self, features: Iterable[str]) -> list[float]:
        total = [0.0] * len(self.start)
        for f in features:
            if w := self.weights.get(f):
                for k, x in enumerate(w):
                    total[k] += x
        return total

    def tags(self, scores: Sequence[Sequence[float]]) -> list[int]:
        """The best tags of a sequence; ties go to the smaller tag."""
        if not scores:
            return []
        tags = range(len(self.start))
        best, came = [s + x for s, x in zip(self.start, scores[0])], []
        for row in scores[1:]:
            from_ = [max(tags, key=lambda a, b=b: best[a] + self.moves[a][b]) for b in tags]
            best = [best[from_[b]] + self.moves[from_[b]][b] + row[b] for b in tags]
            came.append(from_)
        out = [max(tags, key=best.__getitem__)]
        for from_ in reversed(came):
            out.append(from_[out[-1]])
        return out[::-1]


def fit(sequences: Sequence[tuple[Sequence[Iterable[str]], Sequence[int]]], tags: int, epochs: int) -> Field:
    """Weights by maximum likelihood (forward-backward, Adam) from (feature sets, tags) sequences."""
    sequences = [s for s in sequences if s[1]]
    names = sorted({f for features, _ in sequences for own in features for f in own})
    number = {f: k for k, f in enumerate(names)}
    length = max(len(gold) for _, gold in sequences)
    x = np.zeros((len(sequences), length, len(names)), np.float32)
    gold, mask = np.zeros((len(sequences), length, tags), np.float32), np.zeros((len(sequences), length), bool)
    for s, (features, own) in enumerate(sequences):
        mask[s, : len(own)] = True
        for t, (here, tag) in enumerate(zip(features, own, strict=True)):
            x[s, t, [number[f] for f in here]] = 1
            gold[s, t, tag] = 1
    steps = (mask[:, :-1] & mask[:, 1:]).astype(np.float32)
    gold_moves = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], steps)
    flat = x.reshape(-1, len(names))
    values = [np.zeros((len(names), tags), np.float32), np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for epoch in range(1, epochs + 1):
        weights, moves, start = values
        score = (flat @ weights).reshape(*mask.shape, tags).astype(np.float64)
        score[:, 0] += start
        ahead, back = score.copy(), np.zeros_like(score)
        for t in range(1, length):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves[None], axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None]
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0)
        chance = np.exp(np.minimum(ahead + back - total[:, None], 0)) * mask[..., None]
        pair = ahead[:, :-1, :, None] + moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[..., None, None]
        pair = np.exp(np.minimum(pair, 0)) * steps[..., None, None]
        n = len(sequences)
        grads = [flat.T @ (chance - gold).reshape(-1, tags).astype(np.float32) / n, (pair.sum((0, 1)) - gold_moves) / n, (chance[:, 0] - gold[:, 0]).sum(0) / n]
        for k, grad in enumerate(grads):
            grad = grad.astype(np.float32) + DECAY * values[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            values[k] = values[k] - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    weights, moves, start = (v.astype(float).tolist() for v in values)
    return Field({f: tuple(w) for f, w in zip(names, weights)}, tuple(map(tuple, moves)), tuple(start))
