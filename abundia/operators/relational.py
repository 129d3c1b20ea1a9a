"""Joins, keyed edits and unions that abundance work needs by name."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundia.sources.scratch import sized


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, how)


def rename_keys(df: DataFrame, column: str, names: DataFrame, old: str, new: str) -> DataFrame:
    """Replace key values by their new names; a key without one is kept."""
    lookup = names.select(F.col(old).alias(column), F.col(new).alias("_new"))
    return df.join(lookup, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def drop_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(column), column, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(column), column, "left_semi")


def flag_by_keys(df: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """Set ``flag`` to 1 where the key is listed; an existing flag is kept elsewhere."""
    listed = keys.select(column).distinct().withColumn("_listed", F.lit(1))
    before = F.col(flag) if flag in df.columns else F.lit(0)
    return df.join(listed, column, "left").withColumn(flag, F.coalesce("_listed", before)).drop("_listed")


def apply_overrides(traits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace trait values by the curated ones. Applying it twice changes nothing.

    A few edits are broadcast, so that the trait table is not shuffled for them.
    """
    edits = sized(overrides.groupBy("entity", "trait").agg(F.min("value").alias("_edit")))
    return (
        traits.join(edits, ["entity", "trait"], "left")
        .withColumn("value", F.coalesce("_edit", "value"))
        .drop("_edit")
    )


def taxon_overrides(entity_dim: DataFrame, rules: DataFrame) -> DataFrame:
    """Turn (rank, taxon, trait, value) rules into per-entity overrides."""
    ranks = [r for r in ("kingdom", "phylum", "class", "order", "family", "genus", "species") if r in entity_dim.columns]
    placed = entity_dim.unpivot(["entity"], ranks, "rank", "taxon")
    return placed.join(sized(rules), ["rank", "taxon"]).select("entity", "trait", "value")


def taxon_mask(traits: DataFrame, entity_dim: DataFrame, rules: DataFrame) -> DataFrame:
    """Set traits of whole taxa, such as 0 for a phylum known not to have them."""
    return apply_overrides(traits, taxon_overrides(entity_dim, rules))


def conditional_mask(traits: DataFrame, masked: str, condition: str) -> DataFrame:
    """Set trait ``masked`` to 0 for entities that show trait ``condition``.

    (entity, trait) is unique, so the window is as long as the list of traits.
    """
    shows = F.max(F.when(F.col("trait") == condition, F.col("value"))).over(Window.partitionBy("entity"))
    off = (F.col("trait") == masked) & (F.col("_shows") > 0)
    return traits.withColumn("_shows", shows).withColumn("value", F.when(off, 0).otherwise(F.col("value"))).drop("_shows")


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack tables under a tag column, aligning columns by name."""
    stacked = [part.withColumn(tag, F.lit(name)) for name, part in parts.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)


def fixed_order(df: DataFrame, column: str, levels: Sequence[str], out: str = "ord") -> DataFrame:
    """Add the place of a label in an explicit order; unlisted labels get NULL."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return df.withColumn(out, F.nullif(place, F.lit(0)).cast("int"))


def align_sites(cells: DataFrame, covariates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the sites that have both a non-zero total and a covariate row."""
    alive = cells.groupBy("site").agg(F.sum("abundance").alias("_total")).where("_total <> 0").select("site")
    kept = sized(alive.join(covariates.select("site"), "site", "left_semi"))
    return keep_keys(cells, kept, "site"), keep_keys(covariates, kept, "site")
