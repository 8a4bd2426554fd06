"""A linear-chain conditional random field in numpy: trained on padded batches by forward-backward, decoded by Viterbi."""

from __future__ import annotations

import numpy as np


class Crf:
    """Emissions are sums of the weights of a token's features (one id per feature slot); transitions and starts have weights too."""

    def __init__(self, features: int, labels: int):
        self.w, self.t, self.s = np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.w[x].sum(axis=-2)

    def fit(self, x: np.ndarray, y: np.ndarray, length: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Crf:
        """x: (sequences, tokens, slots) feature ids; y: labels; length: tokens of each sequence. Full-batch Adam, so training is the same on every run."""
        n, top, _ = x.shape
        labels = len(self.s)
        live = np.arange(top)[None] < length[:, None]
        gold = np.eye(labels)[y] * live[..., None]
        pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        flat = x.ravel()
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.w, self.t, self.s)]
        for step in range(1, rounds + 1):
            e = self.emissions(x)
            e = np.exp(e - e.max(-1, keepdims=True))
            m = np.exp(self.t)
            # forward and backward sums, scaled to one at each token, which cancels in the marginals
            a, b, c = np.zeros((n, top, labels)), np.ones((n, top, labels)), np.ones((n, top, 1))
            first = np.exp(self.s - self.s.max()) * e[:, 0]
            a[:, 0] = first / first.sum(-1, keepdims=True)
            for k in range(1, top):
                here = (a[:, k - 1] @ m) * e[:, k]
                c[:, k] = np.where(live[:, k, None], here.sum(-1, keepdims=True), 1)
                a[:, k] = np.where(live[:, k, None], here / c[:, k], a[:, k - 1])
            both = np.zeros_like(self.t)
            for k in range(top - 1, 0, -1):
                after = e[:, k] * b[:, k] / c[:, k] * live[:, k, None]
                both += a[:, k - 1].T @ after * m
                b[:, k - 1] = np.where(live[:, k, None], after @ m.T, 1)
            p = a * b * live[..., None]
            miss = np.repeat((gold - p).reshape(-1, labels), x.shape[2], axis=0)
            gw = np.stack([np.bincount(flat, miss[:, k], len(self.w)) for k in range(labels)], axis=1)
            for k, (v, g) in enumerate(((self.w, gw), (self.t, pair - both), (self.s, (gold[:, 0] - p[:, 0]).sum(0)))):
                g = g / n - decay * v
                m, u = state[k]
                m += 0.1 * (g - m)
                u += 0.01 * (g * g - u)
                v += rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The most likely labels of each padded sequence; what lies beyond a sequence's end is of no meaning."""
        e = self.emissions(x)
        n, top, labels = e.shape
        back = np.zeros((n, top, labels), np.int16)
        score = self.s + e[:, 0]
        for k in range(1, top):
            v = score[:, :, None] + self.t
            back[:, k] = v.argmax(1)
            score = np.where((k < length)[:, None], v.max(1) + e[:, k], score)
        out = np.zeros((n, top), np.int64)
        last = score.argmax(1)
        for k in range(top - 1, -1, -1):
            out[:, k] = last
            last = np.where(k < length, back[np.arange(n), k, last], last)
        return out
