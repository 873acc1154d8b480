"""A quantiser of log probabilities: Lloyd's clusters on a histogram of bounded size, then an index by midpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS, ROUNDS = 255, 300
LOWEST, GRID = -40.0, 1000


def fit(values: DataFrame, col: str, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[float]:
    """Centres, rising. Values are counted on a grid of 1/GRID above LOWEST, at most 40,000 cells, whatever their number."""
    cell = F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(0.0), F.ln(col))) * GRID).cast("long")
    rows = values.filter(F.col(col) > 0).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()
    x, n = np.array([r["cell"] for r in rows]) / GRID, np.array([r["n"] for r in rows], dtype=float)
    if len(x) <= clusters:
        return x.tolist()
    centres = x[np.linspace(0, len(x) - 1, clusters).astype(int)]
    for _ in range(rounds):
        at = np.searchsorted((centres[1:] + centres[:-1]) / 2, x, side="right")
        weight = np.bincount(at, weights=n, minlength=clusters)
        new = np.where(weight > 0, np.bincount(at, weights=n * x, minlength=clusters) / np.maximum(weight, 1), centres)
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return centres.tolist()


def index_of(p: Column, centres: list[float]) -> Column:
    """1 + the number of midpoints at or below the log; 0 for what has no log."""
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
    below = F.size(F.filter(F.lit(mids), lambda m: m <= F.round(F.ln(p), 6)))
    return F.when(p > 0, below + 1).otherwise(0)
