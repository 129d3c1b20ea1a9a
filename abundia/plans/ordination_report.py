"""The ordination report: impute, scale, transform, fit, test and decorate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.functions.numeric import finite_or_zero, ratio
from abundia.operators import correlate, impute, ordination, permute, relational, transform
from abundia.operators.reshape import column_range
from abundia.plans import fixed_values as V


def complete_covariates(covariates: DataFrame, key: str = "site", **forest) -> DataFrame:
    """Drop the columns that are not imputed and fill the rest by forests."""
    kept = covariates.drop(*V.UNIMPUTED)
    return impute.impute_forest(kept, key, [c for c in kept.columns if c != key], **{**V.IMPUTATION, **forest})


def scaled_covariates(complete: DataFrame) -> DataFrame:
    """Z-scores of the measured range of columns."""
    return transform.zscore_wide(complete, column_range(complete, V.FIRST_SCALED, V.LAST_SCALED))


def ratio_covariates(complete: DataFrame) -> DataFrame:
    """The covariates with the ratio columns; dots in their names read as underscores."""

    def total(names: Sequence[str]):
        whole = F.col(names[0])
        for name in names[1:]:
            whole = whole + F.col(name)
        return whole

    ratios = {k.replace(".", "_per_"): finite_or_zero(ratio(total(a), total(b))) for k, (a, b) in V.RATIOS.items()}
    return complete.withColumns(ratios)


@dataclass
class Report:
    vif: DataFrame
    eigenvalues: DataFrame
    summary: DataFrame
    model_test: DataFrame
    margin_test: DataFrame
    axis_test: DataFrame
    selection: DataFrame
    correlations: DataFrame
    entity_scores: dict[str, DataFrame]
    site_scores: dict[str, DataFrame]
    biplot: DataFrame


def report(
    cells: DataFrame,
    covariates: DataFrame,
    names: Sequence[str],
    entity_dim: DataFrame,
    site_dim: DataFrame,
    n_sites: int,
    permutations: int = V.PERMUTATIONS,
    seed: int = 1,
) -> Report:
    """Fit one community on the named covariates, with all tests and decorated scores."""
    spark = cells.sparkSession
    kept, known = relational.align_sites(cells, covariates)
    shares = transform.hellinger(kept)
    model = ordination.fit(shares, known, names)
    tested = permute.moments(shares, known, names, permutations, seed)
    entities = {s: ordination.entity_scores(model, s) for s in ("species", "sites")}
    sites = {s: ordination.site_scores(model, s) for s in ("species", "sites")}
    return Report(
        vif=ordination.vif(shares, known, names),
        eigenvalues=ordination.eigenvalues(model, spark),
        summary=ordination.inertia_summary(model, spark),
        model_test=permute.model_test(tested),
        margin_test=permute.margin_test(tested),
        axis_test=permute.axis_test(tested),
        selection=permute.stepwise(tested),
        correlations=correlate.covariate_corr(known, names),
        entity_scores={s: ordination.decorate_entities(t, entity_dim, kept, n_sites) for s, t in entities.items()},
        site_scores={s: ordination.decorate_sites(t, site_dim) for s, t in sites.items()},
        biplot=ordination.biplot_scores(model, spark),
    )


def scores_by_pathway(scores: dict[str, DataFrame], fixers: DataFrame) -> DataFrame:
    """Score rows per community, tagged by fixation pathway; entities without one read NONE.

    An entity in two pathways appears twice.
    """
    parts = []
    for community, table in scores.items():
        held = table.join(fixers.select("entity", "pathway"), "entity", "left")
        parts.append((community, held.withColumn("pathway", F.coalesce("pathway", F.lit("NONE")))))
    return relational.tagged_union(dict(parts), "community")
