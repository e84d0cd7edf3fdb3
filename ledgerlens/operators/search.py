"""Budgeted hyper-parameter search with a Gaussian-process surrogate.

Trials are points of a box.  The first ones are given points (``explore``) and
a Halton sequence; each further batch maximises the expected improvement under
a Matern 5/2 process fitted to all trials so far.  Points of one batch are
chosen one after another, each as if the ones before it had returned the best
value so far (constant liar), so a batch can be evaluated at the same time: in
one Spark aggregate (``frame_objective``), or as concurrent jobs of one session
(``concurrent``).

The surrogate holds one row per trial (a few hundred at most, a parameter);
everything that grows with the data happens inside the objective.  All draws
are Halton points, so equal inputs give equal trials.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame

Space = dict[str, tuple[float, float]]
Objective = Callable[[list[dict]], list[float]]

PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
LENGTHS = (0.08, 0.12, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)     # candidate length scales, in box widths


def halton(start: int, n: int, dims: int) -> np.ndarray:
    """Points ``start`` to ``start + n - 1`` of the Halton sequence in the unit cube."""
    if dims > len(PRIMES):
        raise ValueError(f"at most {len(PRIMES)} parameters")
    out = np.zeros((n, dims))
    for d, p in enumerate(PRIMES[:dims]):
        i, f = np.arange(start, start + n), 1.0
        while i.any():
            f /= p
            out[:, d] += f * (i % p)
            i = i // p
    return out


def _matern(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    r = np.sqrt(5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)) / length
    return (1 + r + r * r / 3) * np.exp(-r)


@dataclass
class GaussianProcess:
    """Zero-mean process over standardised values; the length scale of highest marginal likelihood."""

    alpha: float = 1e-5

    def fit(self, x: np.ndarray, y: np.ndarray) -> "GaussianProcess":
        self.x, self.mean, self.scale = x, y.mean(), y.std() or 1.0
        z = (y - self.mean) / self.scale
        best = -math.inf
        for length in LENGTHS:
            k = _matern(x, x, length) + self.alpha * np.eye(len(x))
            low = np.linalg.cholesky(k)
            w = np.linalg.solve(low.T, np.linalg.solve(low, z))
            fit = -0.5 * z @ w - np.log(np.diag(low)).sum()
            if fit > best:
                best, self.length, self.low, self.w = fit, length, low, w
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = _matern(x, self.x, self.length)
        v = np.linalg.solve(self.low, k.T)
        var = np.maximum(1 + self.alpha - (v * v).sum(0), 1e-12)
        return self.mean + self.scale * (k @ self.w), self.scale * np.sqrt(var)


def expected_improvement(gp: GaussianProcess, x: np.ndarray, best: float, xi: float = 0.0) -> np.ndarray:
    mu, sd = gp.predict(x)
    gain = mu - best - xi
    z = gain / sd
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    return gain * cdf + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _propose(gp: GaussianProcess, best: float, at: np.ndarray, start: int, xi: float, n: int = 1024) -> np.ndarray:
    """The point of largest expected improvement: Halton candidates, then ever narrower boxes around the best two
    (and around the best trial ``at``)."""
    dims = gp.x.shape[1]
    cand = halton(start, n, dims)
    score = expected_improvement(gp, cand, best, xi)
    for width in (0.2, 0.06, 0.02, 0.005):
        top = [*cand[np.argsort(-score, kind="stable")[:2]], at]
        near = np.concatenate([np.clip(c + width * (halton(start, n // 4, dims) - 0.5), 0, 1) for c in top])
        cand = np.concatenate([cand, near])
        score = np.concatenate([score, expected_improvement(gp, near, best, xi)])
    return cand[int(np.argmax(score))]


@dataclass
class SurrogateSearch:
    """Maximises ``objective`` over ``space``; ``run`` may be called again and goes on from the trials so far."""

    space: Space
    objective: Objective
    seed: int = 918
    alpha: float = 1e-5
    xi: float = 0.0
    trials: list[dict] = field(default_factory=list)     # {"kind", "params", "value"}

    def _params(self, u: np.ndarray) -> dict:
        return {p: lo + float(x) * (hi - lo) for (p, (lo, hi)), x in zip(self.space.items(), u)}

    def _unit(self, params: dict) -> list[float]:
        return [(params[p] - lo) / (hi - lo) if hi > lo else 0.0 for p, (lo, hi) in self.space.items()]

    def _evaluate(self, kind: str, points: list[dict]) -> None:
        if points:
            for p, v in zip(points, self.objective(points), strict=True):
                if v is None or not math.isfinite(v):
                    raise ValueError(f"the objective gave {v} at {p}")
                self.trials.append({"kind": kind, "params": p, "value": float(v)})

    def explore(self, points: Sequence[dict]) -> "SurrogateSearch":
        """Trials at given points; each must name every parameter and lie in the box."""
        for p in points:
            if set(p) != set(self.space) or not all(lo <= p[k] <= hi for k, (lo, hi) in self.space.items()):
                raise ValueError(f"{p} isn't a point of the box")
        self._evaluate("explore", [dict(p) for p in points])
        return self

    def run(self, n_init: int = 5, n_iter: int = 20, batch: int = 1) -> "SurrogateSearch":
        self._evaluate("halton", [self._params(u) for u in halton(self.seed, n_init, len(self.space))])
        if n_iter and not self.trials:
            raise ValueError("the surrogate needs a trial")
        left = n_iter
        while left > 0:
            x = np.array([self._unit(t["params"]) for t in self.trials])
            y = np.array([t["value"] for t in self.trials])
            best, at, points = y.max(), x[int(y.argmax())], []
            for _ in range(min(batch, left)):
                gp = GaussianProcess(self.alpha).fit(x, y)
                u = _propose(gp, best, at, self.seed + 7919 * (len(x) + 1), self.xi)
                points.append(self._params(u))
                x, y = np.vstack([x, u]), np.append(y, best)     # the constant liar
            self._evaluate("surrogate", points)
            left -= len(points)
        return self

    @property
    def best(self) -> dict:
        return max(self.trials, key=lambda t: t["value"])

    def frame(self, spark) -> DataFrame:
        names = list(self.space)
        rows = [(i, t["kind"], *[float(t["params"][n]) for n in names], t["value"]) for i, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, kind string, " + ", ".join(f"`{n}` double" for n in names) + ", value double")


def frame_objective(df: DataFrame, value: Callable[[dict], Column]) -> Objective:
    """An objective that is one aggregate Column of ``df``: all points of a batch in one pass over the rows."""
    def run(points: list[dict]) -> list[float]:
        return list(df.agg(*[value(p).alias(f"v{i}") for i, p in enumerate(points)]).first())
    return run


def concurrent(objective: Callable[[dict], float], threads: int = 4) -> Objective:
    """An objective of one point (a fit and its score, say) run for all points of a batch at the same time."""
    def run(points: list[dict]) -> list[float]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            return list(pool.map(objective, points))
    return run
