"""Canonical correspondence analysis of a site x entity table on site covariates.

With P the table divided by its sum, r and c the site and entity weights and x
the covariates centred by r, everything comes from sums over non-zero cells:

    G = sum_i r_i x_i x_i'          h_j = sum_i P_ij x_i / sqrt(c_j)
    constrained axes: eigenpairs of  L^-1 (sum_j h_j h_j') L^-T,  G = L L'
    total inertia:    sum_ij P_ij^2 / (r_i c_j) - 1

Only matrices of the size of the covariate list reach the driver. Covariates that
are constant or follow from earlier ones take no part; see ``constraints``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.functions.numeric import rescaled
from abundia.functions.text import class_label, joined
from abundia.operators.constraints import Choice, choose
from abundia.sources.scratch import saved

MAX_COVARIATES = 64


@dataclass
class Ordination:
    """A fitted model: small matrices, and the weighted tables they came from."""

    names: list[str]  # the covariates that take part
    choice: Choice  # of all covariates that were named
    cells: DataFrame  # site, entity, p
    sites: DataFrame  # site, r, x0..xq (centred)
    entities: DataFrame  # entity, c, h0..hq
    gram: np.ndarray
    moment: np.ndarray
    inertia: float
    values: np.ndarray  # constrained eigenvalues, largest first
    loadings: np.ndarray  # entity score of an axis = h @ loadings / sqrt(c)
    weights: np.ndarray  # site constraint of an axis = x @ weights

    @property
    def constrained(self) -> float:
        return float(np.trace(np.linalg.solve(self.gram, self.moment))) if self.names else 0.0


def _cross_sums(columns: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums of all products of two columns, upper triangle in row order."""
    sums = []
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            product = a * columns[j]
            sums.append(F.sum(product if weight is None else weight * product).alias(f"_{i}_{j}"))
    return sums


def _symmetric(row, q: int) -> np.ndarray:
    matrix = np.zeros((q, q))
    for i in range(q):
        for j in range(i, q):
            matrix[i, j] = matrix[j, i] = row[f"_{i}_{j}"]
    return matrix


def site_weights(cells: DataFrame, covariates: DataFrame, names: Sequence[str]) -> tuple[DataFrame, float, list[str]]:
    """(site, r, x...) with covariates centred by site weight, the table total, and the constant covariates.

    Sites without abundance or without covariates must have been dropped
    before; see ``align_sites``. A covariate without any value, such as the
    z-score of a constant one, counts as constant.
    """
    sums = saved(cells.groupBy("site").agg(F.sum("abundance").alias("_sum")).join(covariates.select("site", *names), "site"))
    row = sums.agg(
        F.sum("_sum").alias("total"),
        *[F.sum(F.col("_sum") * F.col(n)).alias(f"m{i}") for i, n in enumerate(names)],
        *[(F.min(n) == F.max(n)).alias(f"flat{i}") for i, n in enumerate(names)],
    ).first()
    total = float(row["total"])
    empty = [row[f"m{i}"] is None for i in range(len(names))]
    centred = [(F.lit(0.0) if empty[i] else F.col(n) - row[f"m{i}"] / total).alias(f"x{i}") for i, n in enumerate(names)]
    constant = [n for i, n in enumerate(names) if empty[i] or row[f"flat{i}"]]
    return sums.select("site", (F.col("_sum") / total).alias("r"), *centred), total, constant


def chosen_sites(cells: DataFrame, covariates: DataFrame, names: Sequence[str]) -> tuple[DataFrame, float, Choice, np.ndarray]:
    """The weighted sites with all named covariates, the total, the choice among the covariates and their cross-products."""
    names = list(names)
    if len(names) > MAX_COVARIATES:
        raise ValueError(f"{len(names)} covariates are more than {MAX_COVARIATES}")
    sites, total, constant = site_weights(cells, covariates, names)
    gram = _symmetric(sites.agg(F.lit(0), *_cross_sums([F.col(f"x{k}") for k in range(len(names))], F.col("r"))).first(), len(names))
    return sites, total, choose(names, gram, constant), gram


def fit(cells: DataFrame, covariates: DataFrame, names: Sequence[str]) -> Ordination:
    """Fit the model of (site, entity, abundance) on the named covariates.

    With no covariate left after the choice the model has no axes.
    """
    sites, total, choice, gram = chosen_sites(cells, covariates, names)
    names, q = choice.kept_names, len(choice.kept)
    sites = sites.select("site", "r", *[F.col(f"x{k}").alias(f"x{i}") for i, k in enumerate(choice.kept)])
    gram = gram[np.ix_(choice.kept, choice.kept)]
    xs = [F.col(f"x{k}") for k in range(q)]
    shares = cells.where("abundance <> 0").select("site", "entity", (F.col("abundance") / total).alias("p"))
    p = F.col("p")
    sums = shares.join(sites, "site").groupBy("entity").agg(
        F.sum("p").alias("c"), F.sum(p * p / F.col("r")).alias("_own"), *[F.sum(p * x).alias(f"_h{k}") for k, x in enumerate(xs)]
    )
    entities = saved(
        sums.select("entity", "c", "_own", *[(F.col(f"_h{k}") / F.sqrt("c")).alias(f"h{k}") for k in range(q)])
    )
    row = entities.agg(F.sum(F.col("_own") / F.col("c")).alias("own"), *_cross_sums([F.col(f"h{k}") for k in range(q)])).first()
    moment = _symmetric(row, q)
    half = np.linalg.inv(np.linalg.cholesky(gram))
    values, vectors = np.linalg.eigh(half @ moment @ half.T)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    axes = half.T @ vectors
    if q:
        # an axis has no sign of its own: the largest covariate weight is made positive
        scaled = np.sqrt(np.diag(gram))[:, None] * axes
        signs = np.sign(scaled[np.abs(scaled).argmax(axis=0), np.arange(q)])
        axes = axes * np.where(signs == 0, 1, signs)
    with np.errstate(divide="ignore", invalid="ignore"):
        loadings = np.where(values > 1e-12, axes / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return Ordination(names, choice, shares, sites, entities.drop("_own"), gram, moment, float(row["own"]) - 1, values, loadings, axes)


def eigenvalues(model: Ordination, spark) -> DataFrame:
    """(axis, eigenvalue, share of the constrained and of the total inertia, running share)."""
    total = model.values.sum()
    rows = [
        (f"CCA{k + 1}", float(v), float(v / total), float(v / model.inertia), float(model.values[: k + 1].sum() / total))
        for k, v in enumerate(model.values)
    ]
    return spark.createDataFrame(rows, "axis string, eigenvalue double, share double, share_of_total double, cumulative double")


def inertia_summary(model: Ordination, spark) -> DataFrame:
    """Total and constrained inertia and the share explained."""
    row = (model.inertia, model.constrained, model.constrained / model.inertia)
    return spark.createDataFrame([row], "total double, constrained double, explained double")


def _weighted(names: Sequence[str], prefix: str, weights: np.ndarray, axis: int) -> Column:
    terms = [F.col(f"{prefix}{k}") * float(weights[k, axis]) for k in range(len(names))]
    return functools.reduce(lambda a, b: a + b, terms)


def _axis_scores(model: Ordination, scaling: str, axes: int) -> tuple[DataFrame, DataFrame, list[float], list[float]]:
    """Unscaled entity scores and weighted-average site scores, and the scale of each axis.

    The site score of an axis is the average of the entity scores at the site,
    divided by the root of the eigenvalue: one join on non-zero cells.
    """
    scores = [(_weighted(model.names, "h", model.loadings, k) / F.sqrt("c")).alias(f"CCA{k + 1}") for k in range(axes)]
    entities = model.entities.select("entity", *scores)
    roots = [float(np.sqrt(max(v, 0.0))) for v in model.values[:axes]]
    if scaling == "species":
        return entities, model.cells, roots, [1 / r if r else 0.0 for r in roots]
    return entities, model.cells, [1.0] * axes, [1.0] * axes


def entity_scores(model: Ordination, scaling: str = "species", axes: int = 2) -> DataFrame:
    """(entity, CCA1, ...): unscaled with ``scaling="sites"``, times root eigenvalue with ``"species"``."""
    axes = min(axes, len(model.names))
    entities, _, scale, _ = _axis_scores(model, scaling, axes)
    return entities.select("entity", *[(F.col(f"CCA{k + 1}") * scale[k]).alias(f"CCA{k + 1}") for k in range(axes)])


def site_scores(model: Ordination, scaling: str = "species", axes: int = 2) -> DataFrame:
    """(site, CCA1, ...): averages of the entity scores, weighted by abundance."""
    axes = min(axes, len(model.names))
    entities, cells, _, scale = _axis_scores(model, scaling, axes)
    sums = cells.join(entities, "entity").groupBy("site").agg(
        F.sum("p").alias("r"), *[F.sum(F.col("p") * F.col(f"CCA{k + 1}")).alias(f"_{k}") for k in range(axes)]
    )
    return sums.select("site", *[(F.col(f"_{k}") / F.col("r") * scale[k]).alias(f"CCA{k + 1}") for k in range(axes)])


def biplot_scores(model: Ordination, spark, axes: int = 2) -> DataFrame:
    """(covariate, CCA1, ...): weighted correlation of each covariate with the site constraints."""
    axes = min(axes, len(model.names))
    rows = []
    for i, name in enumerate(model.names):
        parts = model.gram[i] @ model.weights[:, :axes] / np.sqrt(model.gram[i, i])
        rows.append((name, *[float(v) for v in parts]))
    return spark.createDataFrame(rows, "covariate string, " + ", ".join(f"CCA{k + 1} double" for k in range(axes)))


def vif(cells: DataFrame, covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each covariate, sites weighted by their abundance.

    Covariates that take no part in the model have none (NULL) and do not
    change those of the others.
    """
    _, _, choice, gram = chosen_sites(cells, covariates, names)
    inner = gram[np.ix_(choice.kept, choice.kept)]
    spread = np.sqrt(np.diag(inner))
    factors = dict(zip(choice.kept_names, np.diag(np.linalg.inv(inner / np.outer(spread, spread)))))
    rows = [(name, float(factors[name]) if name in factors else None) for name in choice.names]
    return cells.sparkSession.createDataFrame(rows, "covariate string, vif double")


def decorate_entities(scores: DataFrame, entity_dim: DataFrame, abundance: DataFrame, n_sites: int) -> DataFrame:
    """Entity scores with taxonomy label and a plotting size from 1 to 20 by mean abundance."""
    means = abundance.groupBy("entity").agg((F.sum("abundance") / n_sites).alias("mean"))
    low, high = means.agg(F.min("mean")).scalar(), means.agg(F.max("mean")).scalar()
    sized = means.withColumn("size", rescaled(F.col("mean"), low, high, (1.0, 20.0))).drop("mean")
    named = entity_dim.select("entity", "phylum", class_label().alias("class"))
    return scores.join(named, "entity").join(sized, "entity")


def decorate_sites(scores: DataFrame, site_dim: DataFrame) -> DataFrame:
    """Site scores with region and the code-and-type label."""
    label = joined(["code", "type"], "").alias("abbrev")
    return scores.join(site_dim.select("site", label, "region"), "site")
