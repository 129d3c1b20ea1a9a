"""The abundance report: from the raw sheets to every table behind its figures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.functions.numeric import cut_off
from abundia.functions.text import class_label, strip_first_item, taxon_name
from abundia.operators import correlate, linkage, markers, relational, reshape, rollup, traits
from abundia.plans import fixed_values as V
from abundia.sources.csv import abundance_from_wide, write_table
from abundia.sources.schema import RANKS
from abundia.sources.scratch import saved, small_table


@dataclass
class Sheets:
    """The input tables, keyed by ``entity`` unless said otherwise."""

    annotation: DataFrame  # entity, gene_id, marker
    abundance: DataFrame  # entity, one column per site under its raw name
    pathway: DataFrame  # entity, 7 ranks, one score column per pathway
    quality: DataFrame  # entity, completeness, contamination, gc, n50, size
    iron: DataFrame  # category, one column per entity
    marker_dim: DataFrame  # metabolism, gene, marker
    gene_counts: DataFrame  # entity, tRNA columns, 16s, 23s, 5s
    gene_abundance: DataFrame  # gene_id, site, abundance


def site_table(spark) -> DataFrame:
    rows = [(site, region) for region, sites in V.REGION_SITES.items() for site in sites]
    return small_table(spark, rows, "site string, region string")


def entity_table(sheets: Sheets) -> DataFrame:
    """Ranks, label and quality of every entity that has both scores and quality."""
    ranks = [F.coalesce(F.col(r), F.lit("")).alias(r) for r in RANKS]
    named = sheets.pathway.select("entity", *ranks).withColumn("name", taxon_name(["entity", *RANKS]))
    return named.join(sheets.quality, "entity")


def abundance_table(sheets: Sheets, entities: DataFrame) -> DataFrame:
    """Long abundance under the final site names; cells below the cut-off are gone."""
    kept = sheets.abundance.drop(*V.UNUSED_SITES).withColumnsRenamed(V.SITE_NAMES)
    long = abundance_from_wide(kept, "entity", [c for c in kept.columns if c != "entity"])
    cells = long.withColumn("abundance", cut_off(F.col("abundance"), V.ABUNDANCE_CUT_OFF))
    return relational.keep_keys(cells, entities, "entity").where("abundance <> 0")


def score_table(sheets: Sheets) -> DataFrame:
    columns = [c for c in sheets.pathway.columns if c not in ("entity", *RANKS)]
    return sheets.pathway.unpivot(["entity"], [F.col(f"`{c}`") for c in columns], "pathway", "score")


def iron_flags(sheets: Sheets) -> DataFrame:
    """Iron trait columns from the transposed iron sheet; entities absent there have no row."""
    columns = [c for c in sheets.iron.columns if c != "category"]
    flipped = reshape.transposed(sheets.iron, "category", columns, list(V.IRON_TRAITS), "entity")
    flags = [F.when(F.col(c) > 0, 1).otherwise(0).alias(t) for c, t in V.IRON_TRAITS.items()]
    return flipped.select("entity", *flags)


def curated(spark) -> DataFrame:
    """Per-entity edits as data."""
    rows = [(e, "Sulfur Oxidation*", 1) for e in V.OXIDATIVE_DSR]
    rows += [(e, "Sulfur Reduction", 0) for e in V.OXIDATIVE_DSR]
    rows += [(e, "Aerobic", 0) for e in V.INCOMPLETE_AA3]
    return small_table(spark, rows, "entity string, trait string, value int")


def trait_table(sheets: Sheets, entities: DataFrame) -> DataFrame:
    """All traits of the candidate entities, after curated edits and taxon masks."""
    spark = entities.sparkSession
    rules = [V.CBB_RULE, V.WL_RULE, *V.MARKER_RULES]
    wide = traits.entity_traits(score_table(sheets), sheets.annotation, V.SCORE_NAMES, V.SCORE_RULES, rules)
    forms = [F.col("entity").isin(members).cast("int").alias(form) for form, members in V.RUBISCO_FORMS.items()]
    decided = wide.where("candidate IS NOT NULL").join(iron_flags(sheets), "entity", "left").select("*", *forms)
    kinds = {
        "donor": V.DONORS, "acceptor": V.ACCEPTORS, "fixation": V.FIXATION,
        "form": list(V.RUBISCO_FORMS), "trophic": ["Autotrophy", "Heterotrophy"],
    }
    iron = {t: F.coalesce(F.col(f"`{t}`"), F.lit(0)) for t in V.IRON_TRAITS.values()}
    stacked = traits.trait_rows(decided.withColumns(iron), kinds)
    edited = relational.apply_overrides(stacked, curated(spark))
    taxa = small_table(spark, V.TAXON_RULES, "rank string, taxon string, trait string, value int")
    masked = relational.taxon_mask(edited, entities, taxa)
    return relational.conditional_mask(masked, "Microaerobic", "Wood.Ljungdahl.present")


def communities(cells: DataFrame, sites: Sequence[str], height: float = V.CUT_HEIGHT) -> DataFrame:
    """(entity, cluster, cluster_name, community) from the correlation profiles of the entities."""
    points = saved(correlate.entity_points(correlate.entity_profiles(cells, sites), len(sites)))
    clusters = linkage.cut_tree(linkage.linkage_merges(points, height), points, height)
    names = small_table(cells.sparkSession, V.CLUSTER_COMMUNITY, "cluster int, cluster_name string, community string")
    return clusters.withColumnRenamed("id", "entity").join(names, "cluster", "left")


def heatmap(cells: DataFrame, n_entities: int, sites: Sequence[str]) -> DataFrame:
    """Every cell with its axis positions from the two merge trees.

    ``n_entities`` counts the rows of the abundance sheet, empty ones included.
    """
    site_points = correlate.site_points(cells, sites, n_entities)
    across = linkage.leaf_order(linkage.linkage_merges(site_points), site_points)
    points = saved(correlate.entity_points(correlate.entity_profiles(cells, sites), len(sites)))
    down = linkage.leaf_order(linkage.linkage_merges(points), points)
    named = rollup.heatmap_cells(cells, sites)
    return named.join(across.select(F.col("id").alias("site"), F.col("position").alias("site_position")), "site").join(
        down.select(F.col("id").alias("entity"), F.col("position").alias("entity_position")), "entity"
    )


def tables(sheets: Sheets) -> dict[str, DataFrame]:
    """Every table of the report by name."""
    spark = sheets.annotation.sparkSession
    sites = [s for region in V.REGION_SITES.values() for s in region]
    site_dim = site_table(spark)
    entities = saved(entity_table(sheets))
    cells = saved(abundance_table(sheets, entities))
    held = saved(trait_table(sheets, entities))
    split = saved(communities(cells, sites))
    prevalent = split.where("community = 'prevalent'")
    regional = split.where("community = 'regional'")
    fixation = held.where("kind = 'fixation' AND value > 0").select("entity", F.col("trait").alias("pathway"))
    redox = held.where(F.col("kind").isin("donor", "acceptor")).select("entity", "trait", "value")
    metabolisms = held.where((F.col("value") > 0) & F.col("trait").isin(V.METABOLISMS))
    depth = F.when(F.col("_in") == 1, "shallow").otherwise("deep").alias("depth")
    members = metabolisms.join(prevalent.select("entity", F.lit(1).alias("_in")), "entity", "left").select(
        "entity", depth, F.col("trait").alias("metabolism")
    )
    candidates = traits.trophic_candidates(markers.scores_wide(score_table(sheets), V.SCORE_NAMES)).where("candidate = 'autotroph'")
    key_genes = sheets.annotation.where(F.col("marker").isin(list(V.KEY_GENES))).select("entity", "gene_id")
    compared = [s for s in sites if s not in V.UNUSED_GENE_SITES]
    found = sheets.gene_abundance.where(F.col("site").isin(compared))
    genomes = cells.where(F.col("site").isin(compared))
    rrna = set(V.RRNA)
    trna = [c for c in sheets.gene_counts.columns if c != "entity" and c not in rrna]
    site_totals = rollup.metabolism_site_abundance(members, cells, sites)
    class_totals = rollup.metabolism_class_abundance(members, cells, entities, site_dim, "all")
    regional_totals = class_totals.where("region <> 'all'")
    redox_groups = rollup.fixation_redox_groups(redox, fixation, split, cells, entities, site_dim, "all")
    # the regional community is read region by region, the prevalent one over all sites
    asked = ((F.col("community") == "regional") & (F.col("region") != "all")) | ((F.col("community") == "prevalent") & (F.col("region") == "all"))
    clusters = split.where("cluster_name IS NOT NULL").select("entity", F.col("cluster_name").alias("community"))
    grouped = rollup.group_class_totals(fixation.join(split.select("entity", "community"), "entity"), cells, entities, site_dim, "all")
    return {
        "entities": entities,
        "abundance": cells,
        "traits": held,
        "communities": split,
        "donor_acceptor": traits.donor_acceptor_pairs(held, V.DONORS, V.ACCEPTORS),
        "trait_members": traits.trait_members(held, split),
        "trait_prevalence": rollup.trait_prevalence(held, split, cells, "cluster_name"),
        "phylum_percent": rollup.group_share(cells, entities, clusters, "phylum"),
        "site_abundance": site_totals.join(site_dim, "site"),
        "class_abundance": class_totals,
        "class_order": rollup.category_order(regional_totals, "class", "average_abundance"),
        "class_labels": rollup.label_order([class_totals], "class", V.EXTRA_CLASSES),
        "fixation_redox": redox_groups.where(asked),
        "class_stack_order": rollup.group_stack_order(grouped),
        "top_classes": rollup.group_top_k(grouped),
        "community_redox": rollup.community_redox_se(redox, fixation, prevalent, cells, entities, len(sites)),
        "fixation_totals": traits.fixation_trait_totals(
            held,
            [*V.RUBISCO_FORMS, "rTCA.present", "Wood.Ljungdahl.present"],
            ["Hydrogen Oxidation", "Sulfur Oxidation*", "Sulfur Reduction", "Nitrogen Reduction*", "Iron Reduction", "Microaerobic"],
        ),
        "pathway_sites": rollup.pathway_site_matrix(fixation, split, cells, V.CHORD_ORDER),
        "marker_catalogue": markers.marker_catalogue(sheets.annotation, sheets.marker_dim, candidates),
        "presence_agreement": rollup.presence_agreement(key_genes, found, genomes, fixation, len(compared)),
        "quality": rollup.quality_tier(
            sheets.gene_counts.fillna(0), trna, V.RRNA, entities.withColumn("name", strip_first_item("name")), V.MIN_TRNA
        ),
        "class_of_entity": entities.select("entity", class_label().alias("class")),
    }


def quality_sheet(quality: DataFrame) -> DataFrame:
    """The genome quality table under its published headings."""
    return quality.select(*[F.col(f"`{c}`").alias(heading) for c, heading in V.QUALITY_HEADINGS.items()])


def write_all(report: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Write every table of a report below one folder."""
    for name, table in report.items():
        write_table(table, f"{folder}/{name}", kind)
