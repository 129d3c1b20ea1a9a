"""Which of several covariates add to the ones before them.

Covariates are taken in their given order. One that is constant, or a linear
combination of the covariates kept so far, adds nothing to a model: it is left
out and listed once, with the combination that gives it. The choice works on
the weighted cross-products of the covariates, so it needs no pass over the
table of its own; the fit, the inflation factors and the permutation tests
share it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Share of a covariate's own variance that must be left beside the earlier ones.
LEFT = 1e-9


@dataclass(frozen=True)
class Choice:
    """Places of the covariates kept, and why and from what the others follow."""

    names: tuple[str, ...]
    kept: tuple[int, ...]
    dropped: dict[str, dict[str, float]]  # constant: empty, else coefficients by kept name

    @property
    def kept_names(self) -> list[str]:
        return [self.names[k] for k in self.kept]


def choose(names: Sequence[str], gram: np.ndarray, constant: Sequence[str] = (), left: float = LEFT) -> Choice:
    """Go through the covariates in order, by a Cholesky factor that grows by one row for each one kept."""
    kept, dropped = [], {}
    factor = np.zeros((0, 0))
    for k, name in enumerate(names):
        if name in constant or not gram[k, k] > 0:
            dropped[name] = {}
            continue
        row = np.linalg.solve(factor, gram[kept, k]) if kept else np.zeros(0)
        beyond = gram[k, k] - row @ row
        if beyond <= left * gram[k, k]:
            shares = np.linalg.solve(factor.T, row)
            dropped[name] = {names[j]: float(c) for j, c in zip(kept, shares) if abs(c) * np.sqrt(gram[j, j] / gram[k, k]) > np.sqrt(left)}
            continue
        grown = np.zeros((len(kept) + 1, len(kept) + 1))
        grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = factor, row, np.sqrt(beyond)
        factor = grown
        kept.append(k)
    return Choice(tuple(names), tuple(kept), dropped)


def aliased(choice: Choice, spark: SparkSession) -> DataFrame:
    """(covariate, reason, source, coefficient): a row for each term of a dropped covariate, one for a constant."""
    rows = []
    for name, terms in choice.dropped.items():
        rows += [(name, "aliased", source, c) for source, c in terms.items()] or [(name, "constant", None, None)]
    return spark.createDataFrame(rows, "covariate string, reason string, source string, coefficient double")
