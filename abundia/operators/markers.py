"""Traits from gene markers and pathway scores.

A marker rule is a list of groups: every group needs at least one of its
markers. ``[["a", "b"]]`` is any-of, ``[["a"], ["b"]]`` is all-of and
``[["a", "b"], ["c", "d"]]`` is a chain. All rules are decided in one pass.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.sources.scratch import sized


class MarkerRule(NamedTuple):
    trait: str
    groups: list[list[str]]


class ScoreRule(NamedTuple):
    trait: str
    pathway: str
    op: str
    threshold: float


def _any(parts: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, parts)


def _all(parts: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, parts)


def marker_sets(annotation: DataFrame, rules: Sequence[MarkerRule]) -> DataFrame:
    """(entity, found): the traits whose rule an entity meets; several rules of a trait are alternatives.

    One grouping decides all rules, and only one row per entity and task is shuffled.
    """
    wanted = sorted({m for rule in rules for group in rule.groups for m in group})
    seen = [
        F.coalesce(F.bool_or(F.col("marker").isin(group)), F.lit(False)).alias(f"_{i}_{j}")
        for i, rule in enumerate(rules)
        for j, group in enumerate(rule.groups)
    ]
    flags = annotation.where(F.col("marker").isin(wanted)).groupBy("entity").agg(*seen)
    met: dict[str, list[Column]] = {}
    for i, rule in enumerate(rules):
        met.setdefault(rule.trait, []).append(_all([F.col(f"_{i}_{j}") for j in range(len(rule.groups))]))
    traits = F.array(*[F.when(_any(ways), F.lit(trait)) for trait, ways in met.items()])
    return flags.select("entity", F.array_compact(traits).alias("found"))


def marker_evidence(annotation: DataFrame, rules: Sequence[MarkerRule]) -> DataFrame:
    """(entity, trait) for every rule an entity meets."""
    return marker_sets(annotation, rules).select("entity", F.explode("found").alias("trait"))


def entities_with_any(annotation: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Entities that carry at least one of the markers."""
    return annotation.where(F.col("marker").isin(list(markers))).select("entity").distinct()


def entities_with_all(annotation: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Entities that carry every marker, on whichever genes."""
    return marker_evidence(annotation, [MarkerRule("all", [[m] for m in markers])]).select("entity")


def marker_flags(annotation: DataFrame, markers: Sequence[str]) -> DataFrame:
    """One 0/1 column per marker for entities that carry any of them."""
    wanted = annotation.where(F.col("marker").isin(list(markers)))
    return wanted.groupBy("entity").pivot("marker", list(markers)).agg(F.max(F.lit(1))).fillna(0, list(markers))


def marker_catalogue(annotation: DataFrame, marker_dim: DataFrame, entities: DataFrame) -> DataFrame:
    """Genes of the given entities that carry a catalogued marker.

    One marker may be on a third of all genes, so the catalogue is sized first:
    as a small table it is broadcast and the annotation stays where it is.
    """
    named = annotation.join(sized(marker_dim), "marker").join(entities.select("entity"), "entity", "left_semi")
    return named.select("entity", "metabolism", "gene_id", "gene", "marker")


def _compare(score: Column, op: str, threshold: float) -> Column:
    return {">": score > threshold, ">=": score >= threshold, "=": score == threshold}[op]


def flag_columns(rules: Sequence[ScoreRule]) -> list[Column]:
    """One 0/1 aggregate per trait over the pathway rows of an entity; rules of a trait are alternatives."""
    ways: dict[str, list[Column]] = {}
    for rule in rules:
        hit = (F.col("pathway") == rule.pathway) & _compare(F.col("score"), rule.op, rule.threshold)
        ways.setdefault(rule.trait, []).append(hit)
    return [F.max(F.when(_any(hits), 1).otherwise(0)).alias(trait) for trait, hits in ways.items()]


def score_columns(names: dict[str, str]) -> list[Column]:
    """One aggregate per pathway score, ``{pathway: column}``; a missing score is NULL."""
    return [F.max(F.when(F.col("pathway") == p, F.col("score"))).alias(c) for p, c in names.items()]


def scores_wide(pathway: DataFrame, names: dict[str, str]) -> DataFrame:
    """Pathway scores as columns."""
    return pathway.groupBy("entity").agg(*score_columns(names))
