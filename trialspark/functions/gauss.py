"""Sums of a Gaussian cut off at a reach, of many spikes at many points, without all their pairs.

Spikes lie in buckets half a sigma wide. Within one the Gaussian is a polynomial through NODES Chebyshev nodes, to 1e-15 of its
peak, so a run of spikes of one bucket is told by NODES sums over it. Running sums give those of the whole buckets within a
point's reach as well as of the parts of the buckets at its ends: each spike within reach counts and none beyond.
"""

from __future__ import annotations

import numpy as np

NODES = 12
#: Points, and pairs of them with spikes, of one numpy step.
_POINTS, _PAIRS = 1 << 11, 1 << 20


class Spikes:
    """Spikes of one group, sorted; `sums` are those of exp(-(t - at)^2 / (2 sigma^2)) over the spikes within reach of points."""

    def __init__(self, times: np.ndarray, sigma: float, reach: float):
        self.t, self.sigma, self.reach = np.sort(times), sigma, reach
        self.width = sigma / 2
        #: Places of kernels that a point needs by nodes.
        self.places = (2 * reach / self.width + 3) * NODES
        self.running = None

    def _prepare(self) -> None:
        place = (self.t - self.t[0]) / self.width
        self.bucket = np.floor(place).astype(np.int64)
        u = 2 * (place - self.bucket) - 1
        terms = [np.ones_like(u), u]
        while len(terms) < NODES:
            terms.append(2 * u * terms[-1] - terms[-2])
        self.running = np.zeros((len(u) + 1, NODES))
        np.cumsum(np.stack(terms, 1), axis=0, out=self.running[1:])
        angle = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
        #: From sums of Chebyshev polynomials to weights of nodes.
        self.weights = np.cos(np.arange(NODES)[:, None] * angle) * np.where(np.arange(NODES) > 0, 2, 1)[:, None] / NODES
        #: From the first spike, so that large times lose no digits.
        self.nodes = (1 + np.cos(angle)) * self.width / 2
        self.ends = np.searchsorted(self.bucket, np.arange(self.bucket[-1] + 2))
        self.whole = (self.running[self.ends[1:]] - self.running[self.ends[:-1]]) @ self.weights

    def sums(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for k in range(0, len(at), _POINTS):
            p = at[k : k + _POINTS]
            low, high = np.searchsorted(self.t, p - self.reach, "left"), np.searchsorted(self.t, p + self.reach, "right")
            many = high - low
            out[k : k + _POINTS] = self._direct(p, low, many) if many.sum() <= min(len(p) * self.places, _PAIRS) else self._by_nodes(p, low, high)
        return out

    def _direct(self, p: np.ndarray, low: np.ndarray, many: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(p)), many)
        spike = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many - low, many)
        return np.bincount(owner, np.exp(-((self.t[spike] - p[owner]) ** 2) / (2 * self.sigma**2)), len(p))

    def _by_nodes(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if self.running is None:
            self._prepare()
        out, hit = np.zeros(len(p)), np.flatnonzero(high > low)
        if not len(hit):
            return out
        p, low, high = p[hit], low[hit], high[hit]
        first, last = self.bucket[low], self.bucket[high - 1]

        def told(bucket, weights, p):
            x = self.nodes + (bucket * self.width - (p - self.t[0]))[:, None]
            return (weights * np.exp(x * x / (-2 * self.sigma**2))).sum(1)

        part = lambda a, b: (self.running[b] - self.running[a]) @ self.weights
        sums = told(first, part(low, np.minimum(high, self.ends[first + 1])), p)
        more = np.flatnonzero(last > first)
        sums[more] += told(last[more], part(self.ends[last[more]], high[more]), p[more])
        for step in range(1, int((last - first).max())):
            inside = np.flatnonzero(first + step < last)
            sums[inside] += told(first[inside] + step, self.whole[first[inside] + step], p[inside])
        out[hit] = sums
        return out
