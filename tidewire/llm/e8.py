"""The E8 lattice: nearest points and their neighbours, vectorised."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors: pairs of +-1, and all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points of even sum: round, then if the sum is odd move the worst coordinate the other way."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(1).astype(np.int64) & 1)
    gap = x[odd] - y[odd]
    worst = np.abs(gap).argmax(1)
    y[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return y


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 shifted by 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y added up in one fixed order, so that a row's result is the same to the last bit in any batch."""
    out = np.zeros((len(x), y.shape[1]))
    for d in range(y.shape[0]):
        out += x[:, d : d + 1] * y[d]
    return out


def neighbourhood(x: np.ndarray, probes: int) -> np.ndarray:
    """n x (1 + probes) x 8: the nearest point, then the points next to it by distance from x."""
    home = nearest(x)
    order = np.argsort(-products(x - home, SHORTEST.T), axis=1, kind="stable")[:, :probes]
    return np.concatenate((home[:, None, :], home[:, None, :] + SHORTEST[order]), axis=1)
