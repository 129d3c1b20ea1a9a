"""Carbon fixation, trophic class and redox traits of entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.operators.markers import MarkerRule, ScoreRule, flag_columns, marker_sets, score_columns

FIXATION = ["CBB.present", "rTCA.present", "Wood.Ljungdahl.present"]


def _side() -> Column:
    fixer = "cbb >= 0.6 OR (rtca >= 1 AND tca >= 0.5) OR wl >= 0.6"
    other = "cbb < 0.6 AND (rtca < 1 OR tca < 0.5) AND wl < 0.6"
    return F.when(F.expr(fixer), F.lit("autotroph")).when(F.expr(other), F.lit("heterotroph"))


def trophic_candidates(scores: DataFrame) -> DataFrame:
    """Split entities by pathway scores ``cbb``, ``rtca``, ``tca`` and ``wl``.

    ``candidate`` is autotroph when any fixation pathway is complete enough
    and heterotroph when all are known to be too low. A missing score that
    leaves both open puts the entity on neither side.
    """
    return scores.withColumn("candidate", _side()).where("candidate IS NOT NULL")


def strict_wl(scores: DataFrame, above: float = 0.6) -> DataFrame:
    """Entities whose Wood-Ljungdahl score is above (not at) the threshold."""
    return scores.where(F.col("wl") > above)


def _has(trait: str) -> Column:
    return F.coalesce(F.array_contains("found", trait), F.lit(False))


def _fixation() -> list[Column]:
    """Fixation and trophic flags; NULL for entities on neither side.

    CBB and Wood-Ljungdahl need marker evidence within the autotroph
    candidates; rTCA needs a score of exactly 1 there.
    """
    fixer = F.col("candidate") == "autotroph"
    sided = F.col("candidate").isNotNull()
    shown = [fixer & _has("CBB.present"), fixer & F.coalesce(F.col("rtca") == 1, F.lit(False)), fixer & _has("Wood.Ljungdahl.present")]
    flags = [F.when(sided, flag.cast("int")) for flag in shown]
    fixes = F.greatest(*flags)
    return [*[f.alias(name) for name, f in zip(FIXATION, flags)], fixes.alias("Autotrophy"), (1 - fixes).alias("Heterotrophy")]


def trophic_class(scores: DataFrame, annotation: DataFrame, cbb: MarkerRule, wl: MarkerRule) -> DataFrame:
    """Fixation flags and trophic class of every candidate entity."""
    rules = [MarkerRule("CBB.present", cbb.groups), MarkerRule("Wood.Ljungdahl.present", wl.groups)]
    found = marker_sets(annotation, rules)
    return trophic_candidates(scores).join(found, "entity", "left").select("entity", "candidate", *_fixation())


def entity_traits(
    pathway: DataFrame,
    annotation: DataFrame,
    score_names: dict[str, str],
    score_rules: Sequence[ScoreRule],
    marker_rules: Sequence[MarkerRule],
) -> DataFrame:
    """Candidate side and every trait flag of each scored entity, one row per entity.

    The pathway and the annotation table are each grouped once for all rules,
    and the two results meet on the partitioning they already have.
    """
    scored = list(dict.fromkeys(r.trait for r in score_rules))
    redox = [t for t in dict.fromkeys([*scored, *(r.trait for r in marker_rules)]) if t not in FIXATION]
    wide = pathway.groupBy("entity").agg(*score_columns(score_names), *flag_columns(score_rules))
    sided = wide.withColumn("candidate", _side()).join(marker_sets(annotation, marker_rules), "entity", "left")
    flags = [
        F.greatest(F.col(f"`{t}`") if t in scored else F.lit(0), _has(t).cast("int")).alias(t) for t in redox
    ]
    return sided.select("entity", "candidate", *flags, *_fixation())


def trait_rows(wide: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
    """(entity, trait, kind, value) of the trait columns; an undecided flag has no row."""
    names = [n for names in kinds.values() for n in names]
    long = wide.unpivot(["entity"], [F.col(f"`{n}`") for n in names], "trait", "value")
    kind_of = F.coalesce(*[F.when(F.col("trait").isin(list(part)), F.lit(kind)) for kind, part in kinds.items()])
    return long.where("value IS NOT NULL").select("entity", "trait", kind_of.alias("kind"), "value")


def trait_flags(traits: DataFrame, names: Sequence[str]) -> DataFrame:
    """One 0/1 column per trait."""
    shown = [F.coalesce(F.max(F.when(F.col("trait") == t, F.col("value"))), F.lit(0)).alias(t) for t in names]
    return traits.groupBy("entity").agg(*shown)


def donor_acceptor_pairs(traits: DataFrame, donors: Sequence[str], acceptors: Sequence[str]) -> DataFrame:
    """Every donor beside every acceptor for each entity, with both values."""
    wide = trait_flags(traits.where(F.col("trait").isin([*donors, *acceptors])), [*donors, *acceptors])
    half = wide.unpivot(["entity", *acceptors], list(donors), "donor", "donor_value")
    return half.unpivot(["entity", "donor", "donor_value"], list(acceptors), "acceptor", "acceptor_value")


def trait_members(traits: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, trait, entity) for every trait an entity shows."""
    shown = traits.where("value > 0").select("entity", "trait")
    return shown.join(communities.select("entity", "community"), "entity").select("community", "trait", "entity")


def fixation_trait_totals(traits: DataFrame, pathways: Sequence[str], others: Sequence[str]) -> DataFrame:
    """How many entities of each fixation pathway show each other trait.

    All totals come from one pass over one row per entity.
    """
    wide = trait_flags(traits.where(F.col("trait").isin([*pathways, *others])), [*pathways, *others])
    cells = [(p, t) for p in pathways for t in others]
    totals = [
        F.sum(F.when(F.col(f"`{p}`") > 0, F.col(f"`{t}`")).otherwise(0)).alias(f"_{i}") for i, (p, t) in enumerate(cells)
    ]
    named = F.array(
        *[
            F.struct(F.lit(t).alias("metabolism"), F.lit(p).alias("pathway"), F.coalesce(f"_{i}", F.lit(0)).alias("number"))
            for i, (p, t) in enumerate(cells)
        ]
    )
    return wide.agg(*totals).select(F.inline(named))
