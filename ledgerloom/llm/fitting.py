"""L-BFGS on the driver over a loss and gradient that Spark sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int) -> np.ndarray:
    """The x that at most `rounds` steps from the given one reach; value returns loss and gradient. It stops when a step gains less than 1e-4 of the loss."""
    v, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, coef = -g, []
        for s, y in reversed(past):
            coef.append(a := (s @ d) / (s @ y))
            d = d - a * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])) if past else d / max(1.0, np.linalg.norm(d))
        for (s, y), a in zip(past, reversed(coef), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            nv, ng = value(x + step * d)
            if nv <= v + 1e-4 * step * (g @ d) or step < 1e-3:
                break
            step /= 2
        if nv > v:
            break
        s, y = step * d, ng - g
        done = v - nv < 1e-4 * abs(v)
        x, v, g = x + s, nv, ng
        if s @ y > 1e-10:
            past = [*past[-7:], (s, y)]
        if done:
            break
    return x
