"""The kernel-observer baseline: centres, bandwidth, sensors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.operators.moments import moments
from fieldcast.operators.state import cross_moments, log_marginal, rbf_features


def kernel_centres(grid: DataFrame, n: int, seed: int = 0) -> list[tuple[float, float]]:
    """n centres by k-means over the grid's coordinates x, y, in order."""
    points = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(grid.select("x", "y"))
    centres = KMeans(k=n, seed=seed, maxIter=20).fit(points).clusterCenters()
    return sorted((round(float(a), 9), round(float(b), 9)) for a, b in centres)


def grid_centres(grid: DataFrame, n: int) -> list[tuple[float, float]]:
    """Centres on a regular lattice of about n cells over the grid's extent."""
    r = grid.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    k = max(1, round(n**0.5))
    at = lambda lo, hi: [lo + (hi - lo) * (i + 0.5) / k for i in range(k)]
    return [(a, b) for a in at(r[0], r[1]) for b in at(r[2], r[3])][:n]


def choose_bandwidth(pixels: DataFrame, grid: DataFrame, centres: list[tuple[float, float]], lengths: list[float], noises: list[float], worst_condition: float = 1e10) -> tuple[float, float]:
    """(length, noise) of the largest median log marginal likelihood over the frames given, among well-conditioned Grams.

    Frames are about their own mean. Only moments (one matrix and one vector a frame and length) reach the driver.
    """
    mean = pixels.groupBy("field", "date").agg(F.avg("value").alias("m"))
    y = pixels.where("value is not null").join(mean, ["field", "date"]).withColumn("y", F.col("value") - F.col("m"))
    best = (-np.inf, lengths[0], noises[0])
    for length in lengths:
        phi = grid.select("field", "pixel", rbf_features(F.col("x"), F.col("y"), centres, length).alias("phi"))
        rows = y.select("field", "date", "pixel", "y").join(phi, ["field", "pixel"])
        gram = {(r.field, r.date): np.asarray(r.xx).reshape(len(centres), -1) for r in moments(rows, ["field", "date"], "phi").collect()}
        rhs = {(r.field, r.date): r for r in cross_moments(rows, ["field", "date"], "phi", "y").collect()}
        if max(np.linalg.cond(g + noises[0] * np.eye(len(g))) for g in gram.values()) > worst_condition:
            continue
        for noise in noises:
            score = float(np.median([log_marginal(r.n, gram[k], np.asarray(r.xy), r.yy, noise) for k, r in rhs.items()]))
            best = max(best, (score, length, noise), key=lambda b: b[0])
    return best[1], best[2]


def cyclic_index(a: np.ndarray, tolerance: float = 1e-6) -> int:
    """The largest number of equal eigenvalues: how many sensors a field needs at least."""
    values = np.linalg.eigvals(a)
    return int(max((np.abs(values - v) <= tolerance).sum() for v in values))


def observable_sensors(a: np.ndarray, phi: np.ndarray, most: int | None = None) -> list[int]:
    """Rows of phi, added one by one by the largest part outside those chosen, until the pair (a, rows) is observable."""
    k, chosen, left = len(a), [], phi.astype(float).copy()
    powers = [np.linalg.matrix_power(a, i) for i in range(k)]
    while len(chosen) < (most or len(phi)):
        i = int(np.argmax((left**2).sum(1)))
        chosen.append(i)
        q = left[i] / max(np.linalg.norm(left[i]), 1e-300)
        left -= np.outer(left @ q, q)
        if np.linalg.matrix_rank(np.vstack([phi[chosen] @ p for p in powers])) == k or np.abs(left).max() < 1e-12:
            break
    return chosen
