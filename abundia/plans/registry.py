"""Named queries: every operator run over the bound test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundia.functions import numeric as N
from abundia.functions import text as X
from abundia.operators import correlate as C
from abundia.operators import impute as I
from abundia.operators import linkage as L
from abundia.operators import markers as M
from abundia.operators import ordering as O
from abundia.operators import ordination as Z
from abundia.operators import permute as P
from abundia.operators import relational as R
from abundia.operators import reshape as S
from abundia.operators import rollup as U
from abundia.operators import traits as T
from abundia.operators import transform as D
from abundia.operators import trees as G
from abundia.operators.constraints import aliased
from abundia.plans import bindings as B
from abundia.sources import csv as V
from abundia.sources.scratch import saved, scratch_root, small_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(name: str, value: Column | None = None) -> Column:
    """Round to 6 places under the column's own name."""
    return F.round(F.col(f"`{name}`") if value is None else value, 6).alias(name)


# ---- sources, projection, filter, keyed edits -------------------------------------------


@query
def annotation_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two annotation tables of different width stacked by column name."""
    a = B.order_annotation(spark, sf)
    b = B.annotation(spark, sf).select("entity", "marker")
    return a.unionByName(b, allowMissingColumns=True)


@query
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customer = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_acctbal").alias("customer"))
    supplier = B.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("supplier"), F.col("s_nationkey").alias("site"))
    return customer.unionByName(supplier, allowMissingColumns=True)


@query
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    """Entities per fixation pathway plus the rest, stacked; an entity in two pathways appears twice."""
    held = B.fixers(spark, sf)
    parts = {p: R.keep_keys(B.entity_dim(spark, sf), held.where(F.col("pathway") == p), "entity") for p in T.FIXATION}
    parts["NONE"] = R.drop_keys(B.entity_dim(spark, sf), held, "entity")
    return R.tagged_union(parts, "pathway").select("pathway", "entity", "phylum", "class")


@query
def site_report(spark: SparkSession, sf: str) -> DataFrame:
    return B.site_dim(spark, sf).select("code", "region", "type", "site")


@query
def drop_sites(spark: SparkSession, sf: str) -> DataFrame:
    unused = B.site_dim(spark, sf).where("region = 'AFRICA'")
    return R.drop_keys(B.abundance(spark, sf), unused, "site").select("entity", "site", "abundance")


@query
def rename_sites(spark: SparkSession, sf: str) -> DataFrame:
    names = B.site_dim(spark, sf).where("type = 'F'").select(F.col("site").cast("string").alias("old"), "code")
    cells = B.abundance(spark, sf).withColumn("site", F.col("site").cast("string"))
    return R.rename_keys(cells, "site", names, "old", "code").select("entity", "site", "abundance")


@query
def site_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.table(spark, sf, "customer").join(
        B.site_dim(spark, sf), F.col("c_nationkey") == F.col("site")
    ).select("c_custkey", F.concat_ws("", F.lit("SURVEY_"), "region", F.lit(".."), F.regexp_replace("code", "_", "-"), F.lit("_"), "c_custkey").alias("label"))
    return rows.select("c_custkey", "label", X.site_key("label").alias("site"))


@query
def split_key(spark: SparkSession, sf: str) -> DataFrame:
    label = X.joined(["c_mktsegment", "c_name"])
    rows = B.table(spark, sf, "customer").select("c_custkey", label.alias("label"))
    return rows.select(
        "c_custkey", X.split_part("label", ", ", 0).alias("segment"), X.split_part("label", ", ", 1).alias("name")
    )


def _gappy_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose balance is missing where the md5 of the key starts with 0."""
    digit = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1)
    return B.table(spark, sf, "customer").select("c_custkey", "c_name", F.when(digit != "0", F.col("c_acctbal")).alias("balance"))


@query
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table with gaps written as CSV and read back by its schema, one column renamed."""
    rows = _gappy_balance(spark, sf)
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    V.write_table(rows, path, "csv")
    return V.read_csv(spark, path, rows.schema, {"c_name": "name"})


@query
def numeric_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Balances that arrive as text; ``unknown`` becomes NULL."""
    text = F.coalesce(F.col("balance").cast("string"), F.lit("unknown"))
    return V.numeric(_gappy_balance(spark, sf).select("c_custkey", text.alias("balance")), ["balance"])


@query
def column_range(spark: SparkSession, sf: str) -> DataFrame:
    part = B.table(spark, sf, "part")
    return part.select("p_partkey", *S.column_range(part, "p_brand", "p_size"))


@query
def percent_text(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the customers of each nation in one segment, as text."""
    share = F.avg((F.col("c_mktsegment") == "BUILDING").cast("int"))
    return B.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("site")).agg(X.percent_text(share).alias("share"))


@query
def strict_wl(spark: SparkSession, sf: str) -> DataFrame:
    """Entities above, not at, the threshold of one pathway."""
    return T.strict_wl(B.scores(spark, sf)).select("entity")


@query
def taxon_name(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["name", "kingdom", "phylum", "class", "order", "family", "genus", "species"]
    return B.entity_dim(spark, sf).select("entity", X.taxon_name(columns).alias("taxon_name"))


@query
def strip_first_rank(spark: SparkSession, sf: str) -> DataFrame:
    named = taxon_name(spark, sf)
    return named.select("entity", X.strip_first_item("taxon_name").alias("taxon_name"))


@query
def class_label(spark: SparkSession, sf: str) -> DataFrame:
    return B.entity_dim(spark, sf).select("entity", X.class_label().alias("class"))


@query
def case_label(spark: SparkSession, sf: str) -> DataFrame:
    """Pathway named by marker, any other marker under a rest label."""
    names = {"1RF": "CBB", "2AF": "Wood-Ljungdahl", "3NO": "Wood-Ljungdahl", "6RF": "rTCA"}
    label = F.coalesce(*[F.when(F.col("marker") == m, F.lit(p)) for m, p in names.items()], F.lit("other"))
    return B.annotation(spark, sf).groupBy(label.alias("pathway")).agg(F.count("*").alias("n"))


@query
def trophic_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return T.trophic_candidates(B.scores(spark, sf)).select("entity", "candidate")


@query
def trophic_class(spark: SparkSession, sf: str) -> DataFrame:
    held = T.trophic_class(B.scores(spark, sf), B.annotation(spark, sf), B.CBB_RULE, B.WL_RULE)
    return held.select(
        "entity", "candidate", F.col("`CBB.present`").alias("cbb"), F.col("`rTCA.present`").alias("rtca"),
        F.col("`Wood.Ljungdahl.present`").alias("wl"), "Autotrophy", "Heterotrophy",
    )


@query
def marker_filter(spark: SparkSession, sf: str) -> DataFrame:
    return B.order_annotation(spark, sf).where("marker = 'Brand#1'")


@query
def marker_any(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with either marker, among the dear orders only."""
    dear = B.table(spark, sf, "orders").where("o_totalprice >= 100000").select(F.col("o_orderkey").alias("entity"))
    return R.keep_keys(M.entities_with_any(B.order_annotation(spark, sf), ["Brand#1", "Brand#2"]), dear, "entity")


@query
def marker_all(spark: SparkSession, sf: str) -> DataFrame:
    return M.entities_with_all(B.order_annotation(spark, sf), ["Brand#1", "Brand#2"])


@query
def marker_chain(spark: SparkSession, sf: str) -> DataFrame:
    chain = M.MarkerRule("chain", [["Brand#1", "Brand#2"], ["Brand#3", "Brand#4"]])
    return M.marker_evidence(B.order_annotation(spark, sf), [chain]).select("entity")


@query
def marker_pivot(spark: SparkSession, sf: str) -> DataFrame:
    flags = M.marker_flags(B.order_annotation(spark, sf), ["Brand#1", "Brand#2", "Brand#3"])
    return flags.select(
        "entity", *[F.col(f"`Brand#{i}`").cast("int").alias(f"brand_{i}") for i in (1, 2, 3)]
    )


@query
def marker_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Genes of autotroph candidates beside the catalogue entry of their marker."""
    catalogue = (
        B.table(spark, sf, "lineitem")
        .select(
            F.col("l_returnflag").alias("metabolism"),
            F.concat(F.lit("gene"), "l_linestatus").alias("gene"),
            F.concat(F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus").alias("marker"),
        )
        .distinct()
    )
    candidates = T.trophic_candidates(B.scores(spark, sf)).where("candidate = 'autotroph'")
    return M.marker_catalogue(B.annotation(spark, sf), catalogue, candidates)


@query
def redox_traits(spark: SparkSession, sf: str) -> DataFrame:
    return B.redox(spark, sf)


def _curated(spark: SparkSession, sf: str) -> DataFrame:
    """Curated edits: parts of the top price class lose the trait, tiny ones gain it."""
    parts = B.table(spark, sf, "part")
    off = parts.where("p_retailprice >= 1000").select(
        F.col("p_partkey").alias("entity"), F.lit("Aerobic").alias("trait"), F.lit(0).alias("value")
    )
    on = parts.where("p_size <= 2").select(
        F.col("p_partkey").alias("entity"), F.lit("Sulfur Oxidation*").alias("trait"), F.lit(1).alias("value")
    )
    return off.unionByName(on)


@query
def apply_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return R.apply_overrides(B.redox(spark, sf), _curated(spark, sf))


TAXON_RULES = [
    ("phylum", "Brand#3", "Aerobic", 0),
    ("class", "PROMO", "Microaerobic", 0),
    ("order", "red", "Aerobic", 0),
]


@query
def taxon_mask(spark: SparkSession, sf: str) -> DataFrame:
    rules = small_table(spark, TAXON_RULES, "rank string, taxon string, trait string, value int")
    return R.taxon_mask(B.redox(spark, sf), B.entity_dim(spark, sf), rules)


@query
def conditional_mask(spark: SparkSession, sf: str) -> DataFrame:
    masked = R.conditional_mask(B.traits(spark, sf), "Microaerobic", "Wood.Ljungdahl.present")
    return masked.select("entity", "trait", "kind", "value")


@query
def flag_by_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = M.entities_with_any(B.annotation(spark, sf), ["1RF"])
    return R.flag_by_keys(B.entity_dim(spark, sf).select("entity", "phylum"), keys, "entity", "flag")


@query
def abundance_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return B.abundance(spark, sf).select("entity", "site", N.cut_off(F.col("abundance"), B.CUT_OFF).alias("abundance"))


@query
def binarize(spark: SparkSession, sf: str) -> DataFrame:
    cut = N.cut_off(F.col("abundance"), B.CUT_OFF)
    return B.abundance(spark, sf).select("entity", "site", N.binary(cut).alias("present"))


@query
def fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    levels = ["SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO"]
    parts = B.table(spark, sf, "part").select("p_partkey", "p_type")
    return R.fixed_order(parts, "p_type", levels)


# ---- joins ------------------------------------------------------------------------------


@query
def enrich_abundance(spark: SparkSession, sf: str) -> DataFrame:
    cells = B.abundance(spark, sf).join(B.entity_dim(spark, sf), "entity").join(B.site_dim(spark, sf), "site")
    return cells.select("entity", "phylum", "class", "code", "region", "abundance")


@query
def natural_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = B.table(spark, sf, "labels")
    return R.natural_join(B.table(spark, sf, "documents").select("doc_id", "lang", "source"), labels)


@query
def left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    documents = B.table(spark, sf, "documents").select("doc_id", "lang")
    return documents.join(B.table(spark, sf, "labels"), "doc_id", "left")


@query
def semi_members(spark: SparkSession, sf: str) -> DataFrame:
    prevalent = B.communities(spark, sf).where("community = 'prevalent'")
    return R.keep_keys(B.entity_dim(spark, sf), prevalent, "entity").select("entity", "phylum")


@query
def anti_members(spark: SparkSession, sf: str) -> DataFrame:
    prevalent = B.communities(spark, sf).where("community = 'prevalent'")
    return R.drop_keys(B.entity_dim(spark, sf), prevalent, "entity").select("entity", "phylum")


@query
def donor_acceptor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return T.donor_acceptor_pairs(B.redox(spark, sf), B.DONORS, B.ACCEPTORS)


@query
def align_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Abundance per site where supplier balances are known, beside the covariate kept with it."""
    known = B.covariates(spark, sf).where("s_bal IS NOT NULL")
    cells, covariates = R.align_sites(B.cut_abundance(spark, sf), known)
    sums = cells.groupBy("site").agg(F.sum("abundance").alias("abundance"))
    return sums.join(covariates, "site").select("site", "abundance", r6("s_bal"))


# ---- aggregation, order -----------------------------------------------------------------


@query
def phylum_site_sum(spark: SparkSession, sf: str) -> DataFrame:
    return U.group_site_sum(B.abundance(spark, sf), B.entity_dim(spark, sf), "phylum")


@query
def entity_total(spark: SparkSession, sf: str) -> DataFrame:
    return U.entity_stats(B.abundance(spark, sf), len(B.sites(spark, sf))).select("entity", "total")


@query
def entity_mean(spark: SparkSession, sf: str) -> DataFrame:
    n = len(B.sites(spark, sf))
    return U.entity_stats(B.cut_abundance(spark, sf), n).select("entity", r6("mean"))


@query
def standard_error(spark: SparkSession, sf: str) -> DataFrame:
    n = len(B.sites(spark, sf))
    return U.entity_stats(B.cut_abundance(spark, sf), n).select("entity", r6("standard_error"))


@query
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return U.value_counts(B.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query
def distinct_taxa(spark: SparkSession, sf: str) -> DataFrame:
    return B.entity_dim(spark, sf).groupBy("phylum").agg(
        F.count_distinct("class").alias("classes"), F.count_distinct("order").alias("orders")
    )


@query
def phylum_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Phylum shares of the abundance of one community."""
    prevalent = B.communities(spark, sf).where("community = 'prevalent'")
    cells = R.keep_keys(B.abundance(spark, sf), prevalent, "entity")
    return U.share_of_total(cells, B.entity_dim(spark, sf), "phylum").select("phylum", "total", r6("percent"))


@query
def rescale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """Prices onto [1, 20] within each brand and onto [0, 1] overall."""
    parts = B.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    grouped = U.rescale_minmax(parts, "p_retailprice", ["p_brand"], (1.0, 20.0), "within")
    return U.rescale_minmax(grouped, "p_retailprice", out="overall").select("p_partkey", r6("within"), r6("overall"))


@query
def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    cells = B.abundance(spark, sf)
    return O.average_rank(cells, ["site"], "abundance").select("entity", "site", "abundance", "avg_rank")


@query
def category_order(spark: SparkSession, sf: str) -> DataFrame:
    cells = B.abundance(spark, sf).join(B.entity_dim(spark, sf).select("entity", X.class_label().alias("class")), "entity")
    return U.category_order(cells, "class", "abundance")


@query
def label_order(spark: SparkSession, sf: str) -> DataFrame:
    """All class labels of entities with any trait, plus fixed extra ones, numbered in text order."""
    labels = B.entity_dim(spark, sf).select(X.class_label().alias("class"))
    return U.label_order([labels], "class", ["unknown phylum, unknown class"]).select(
        "class", F.col("ord").cast("long").alias("ord")
    )


@query
def make_unique(spark: SparkSession, sf: str) -> DataFrame:
    parts = B.table(spark, sf, "part").select("p_partkey", "p_name")
    return O.make_unique(parts, "p_name", "p_partkey").select("p_partkey", "unique_label")


@query
def top_k_other(spark: SparkSession, sf: str) -> DataFrame:
    prevalent = B.communities(spark, sf).where("community = 'prevalent'")
    return U.top_k_other(prevalent, B.abundance(spark, sf), B.entity_dim(spark, sf)).select("class", "total", "ord", "label")


@query
def class_stack_order(spark: SparkSession, sf: str) -> DataFrame:
    n = len(B.sites(spark, sf))
    held = B.fixers(spark, sf).select("entity").distinct()
    order = U.class_stack_order(held, B.cut_abundance(spark, sf), B.entity_dim(spark, sf), n)
    return order.select("class", r6("mean"), "ord")


def _community_totals(spark: SparkSession, sf: str) -> DataFrame:
    members = B.fixers(spark, sf).join(B.communities(spark, sf), "entity")
    return U.group_class_totals(members, B.cut_abundance(spark, sf), B.entity_dim(spark, sf), B.site_dim(spark, sf), "all")


@query
def top_k_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest classes of every pathway, community and region, and the rest of each."""
    top = U.group_top_k(_community_totals(spark, sf))
    return top.select("pathway", "community", "region", "label", "total", r6("mean"), "ord")


@query
def stack_order_groups(spark: SparkSession, sf: str) -> DataFrame:
    placed = U.group_stack_order(_community_totals(spark, sf))
    return placed.select("pathway", "community", "region", "class", r6("mean"), "ord")


@query
def phylum_percent_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Phylum shares within every community."""
    shares = U.group_share(B.abundance(spark, sf), B.entity_dim(spark, sf), B.communities(spark, sf), "phylum")
    return shares.select("community", "phylum", "total", r6("percent"))


@query
def fixation_redox_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Redox traits of the fixers of every community in every region and over all sites."""
    held = U.fixation_redox_groups(
        B.redox(spark, sf), B.fixers(spark, sf), B.communities(spark, sf), B.cut_abundance(spark, sf),
        B.entity_dim(spark, sf), B.site_dim(spark, sf), "all",
    )
    return held.select("region", "community", "entity", "pathway", "class", "trait", r6("mean_abundance"), "occurrence")


@query
def class_abundance_all(spark: SparkSession, sf: str) -> DataFrame:
    """Class abundance per metabolism in every region and over all sites."""
    result = U.metabolism_class_abundance(
        B.members(spark, sf), B.cut_abundance(spark, sf), B.entity_dim(spark, sf), B.site_dim(spark, sf), "all"
    )
    return result.select("metabolism", "region", "class", r6("average_abundance"), "number")


# ---- reshape ----------------------------------------------------------------------------


@query
def unpivot_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Abundance spread to one column per site and gathered again: absent cells read 0."""
    sites = B.sites(spark, sf)
    wide = S.to_wide(B.abundance(spark, sf), ["entity"], "site", sites, "abundance")
    return S.to_long(wide, ["entity"], [str(s) for s in sites], "site", "abundance")


@query
def transpose_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A category x site matrix flipped to site x category."""
    sites = B.sites(spark, sf)
    flags = ["A", "N", "R"]
    lines = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    wide = S.to_wide(lines, ["l_returnflag"], "s_nationkey", sites, "l_quantity")
    flipped = S.transposed(wide, "l_returnflag", [str(s) for s in sites], flags, "site")
    return flipped.select("site", *[F.col(f).alias(f"flag_{f.lower()}") for f in flags])


@query
def heatmap_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = U.heatmap_cells(B.cut_abundance(spark, sf), B.sites(spark, sf))
    return cells.select("entity", "site", r6("log_abundance"))


# ---- composites -------------------------------------------------------------------------


@query
def clean_abundance(spark: SparkSession, sf: str) -> DataFrame:
    unused = B.site_dim(spark, sf).where("region = 'AFRICA'")
    cleaned = U.clean_abundance(B.abundance(spark, sf), unused, B.entity_dim(spark, sf), B.CUT_OFF)
    return cleaned.select("entity", "site", "abundance", "phylum", "class", "completeness", "contamination")


@query
def abundance_floor(spark: SparkSession, sf: str) -> DataFrame:
    return U.lowest_peak(B.abundance(spark, sf))


@query
def region_abundance(spark: SparkSession, sf: str) -> DataFrame:
    return U.region_slice(B.cut_abundance(spark, sf), B.site_dim(spark, sf), ["ASIA", "EUROPE"])


@query
def metabolism_site_abundance(spark: SparkSession, sf: str) -> DataFrame:
    """How much abundance, and how many entities, carry each trait at each site."""
    sites = B.sites(spark, sf)
    totals = U.metabolism_site_abundance(B.members(spark, sf), B.cut_abundance(spark, sf), sites)
    return totals.join(B.site_dim(spark, sf).select("site", "region"), "site").select(
        "metabolism", "region", "site", "abundance", "number"
    )


@query
def metabolism_class_abundance(spark: SparkSession, sf: str) -> DataFrame:
    result = U.metabolism_class_abundance(
        B.members(spark, sf), B.cut_abundance(spark, sf), B.entity_dim(spark, sf), B.site_dim(spark, sf)
    )
    return result.select("metabolism", "region", "class", r6("average_abundance"), "number")


@query
def fixation_redox(spark: SparkSession, sf: str) -> DataFrame:
    """Redox traits of the fixers of one community at the sites of one region."""
    region = B.site_dim(spark, sf).where("region = 'ASIA'")
    cells = R.keep_keys(B.cut_abundance(spark, sf), region, "site")
    held = U.fixation_redox(
        B.redox(spark, sf), B.fixers(spark, sf), B.communities(spark, sf).where("community = 'prevalent'"),
        cells, B.entity_dim(spark, sf), region.count(),
    )
    return held.select("entity", "pathway", "class", "trait", r6("mean_abundance"), "occurrence")


@query
def community_redox_se(spark: SparkSession, sf: str) -> DataFrame:
    n = len(B.sites(spark, sf))
    held = U.community_redox_se(
        B.redox(spark, sf), B.fixers(spark, sf), B.communities(spark, sf).where("community = 'prevalent'"),
        B.cut_abundance(spark, sf), B.entity_dim(spark, sf), n,
    )
    return held.select("depth", "entity", "class", "trait", r6("mean_abundance"), r6("standard_error"), "occurrence")


@query
def fixation_trait_totals(spark: SparkSession, sf: str) -> DataFrame:
    return T.fixation_trait_totals(B.traits(spark, sf), T.FIXATION, [*B.DONORS, *B.ACCEPTORS])


@query
def trait_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    result = U.trait_prevalence(B.traits(spark, sf), B.communities(spark, sf), B.cut_abundance(spark, sf))
    return result.select("community", "trait", "n_with_trait", r6("percent_entities"), r6("percent_abundance"))


@query
def trait_members(spark: SparkSession, sf: str) -> DataFrame:
    return T.trait_members(B.traits(spark, sf), B.communities(spark, sf))


@query
def pathway_site_matrix(spark: SparkSession, sf: str) -> DataFrame:
    sites = B.sites(spark, sf)
    matrix = U.pathway_site_matrix(B.fixers(spark, sf), B.communities(spark, sf), B.cut_abundance(spark, sf), sites)
    return matrix.select("community", "pathway", *[F.col(f"`{s}`").alias(f"site_{s}") for s in sites])


@query
def presence_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Key genes found at a site against their genomes found there."""
    genes = B.annotation(spark, sf).where(F.col("marker").isin("1RF", "2AF", "3NO")).select("entity", "gene_id")
    lines = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = lines.groupBy(F.col("l_orderkey").alias("gene_id"), F.col("s_nationkey").alias("site")).agg(
        F.sum("l_quantity").alias("abundance")
    )
    result = U.presence_agreement(genes, found, B.cut_abundance(spark, sf), B.fixers(spark, sf), len(B.sites(spark, sf)))
    return result.select("difference", "n", r6("percent"))


@query
def presence_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the listed genes: those of dear orders."""
    genes = B.annotation(spark, sf).where(F.col("marker").isin("1RF", "2AF", "3NO")).select("entity", "gene_id")
    dear = B.table(spark, sf, "orders").where("o_totalprice >= 100000").select(F.col("o_orderkey").alias("gene_id"))
    lines = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = lines.groupBy(F.col("l_orderkey").alias("gene_id"), F.col("s_nationkey").alias("site")).agg(
        F.sum("l_quantity").alias("abundance")
    )
    excluded = genes.join(dear, "gene_id", "left_semi").select("entity", "gene_id")
    result = U.presence_agreement(
        genes, found, B.cut_abundance(spark, sf), B.fixers(spark, sf), len(B.sites(spark, sf)), excluded
    )
    return result.select("difference", "n", r6("percent"))


@query
def quality_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys modulo 20 stand for the 20 tRNA kinds, return flags for rRNA genes."""
    kinds = list(range(20))
    lines = B.table(spark, sf, "lineitem")
    counts = lines.groupBy(F.col("l_partkey").alias("entity")).agg(
        *[F.count(F.when(F.col("l_orderkey") % 20 == k, 1)).alias(f"t{k}") for k in kinds],
        *[F.count(F.when(F.col("l_returnflag") == f, 1)).alias(f"r{f.lower()}") for f in "ANR"],
    )
    named = B.entity_dim(spark, sf).drop("name").join(taxon_name(spark, sf), "entity").withColumnRenamed("taxon_name", "name")
    tier = U.quality_tier(counts, [f"t{k}" for k in kinds], ["ra", "rn", "rr"], named, min_trna=16)
    return tier.withColumn("name", X.strip_first_item("name"))


@query
def cumulative_cultured(spark: SparkSession, sf: str) -> DataFrame:
    levels = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]
    counts = (
        B.table(spark, sf, "customer")
        .join(B.site_dim(spark, sf), F.col("c_nationkey") == F.col("site"))
        .groupBy(F.col("c_mktsegment").alias("level"), F.col("region").alias("membership"))
        .agg(F.count("*").alias("n"))
    )
    shares = U.level_shares(counts, levels)
    return shares.select("level", "membership", "n", "ord", r6("share"), r6("cumulative_share"))


RATIOS = {
    "price_cust": (["o_price"], ["n_cust"]),
    "rich_cust": (["n_rich"], ["n_cust"]),
    "bal_rich": (["c_bal"], ["n_rich"]),
    "rich_rich": (["n_rich"], ["n_rich"]),
    "bals_price": (["c_bal", "s_bal"], ["o_price"]),
    "cust_units": (["n_cust"], ["n_supp", "n_rich"]),
}


@query
def ratio_features(spark: SparkSession, sf: str) -> DataFrame:
    def total(names: list[str]) -> Column:
        whole = F.col(names[0])
        for name in names[1:]:
            whole = whole + F.col(name)
        return whole

    ratios = {k: N.finite_or_zero(N.ratio(total(a), total(b))) for k, (a, b) in RATIOS.items()}
    return B.covariates(spark, sf).select("site", *[r6(k, v) for k, v in ratios.items()])


# ---- ranks, profiles, clustering --------------------------------------------------------


def _n_entities(spark: SparkSession, sf: str) -> int:
    return B.table(spark, sf, "part").count()


@query
def spearman_sites(spark: SparkSession, sf: str) -> DataFrame:
    pairs = C.spearman_sites(B.cut_abundance(spark, sf), B.sites(spark, sf), _n_entities(spark, sf))
    return pairs.select("site_a", "site_b", r6("rho"))


@query
def profile_distance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = C.profile_distance(B.cut_abundance(spark, sf), B.sites(spark, sf), _n_entities(spark, sf))
    return pairs.select("site_a", "site_b", r6("distance"))


@query
def spearman_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Strongly correlated entity pairs over all entities."""
    profiles = C.entity_profiles(B.cut_abundance(spark, sf), B.sites(spark, sf))
    return C.spearman_entities(profiles, 0.7).select("entity_a", "entity_b", r6("rho"))


def _entity_points(spark: SparkSession, sf: str) -> DataFrame:
    sites = B.sites(spark, sf)
    return saved(C.entity_points(C.entity_profiles(B.cut_abundance(spark, sf), sites), len(sites)))


def _site_points(spark: SparkSession, sf: str) -> DataFrame:
    return C.site_points(B.cut_abundance(spark, sf), B.sites(spark, sf), _n_entities(spark, sf))


@query
def linkage_merges(spark: SparkSession, sf: str) -> DataFrame:
    """The full merge tree of the entities by their correlation profiles."""
    return L.linkage_merges(_entity_points(spark, sf)).select("left", "right", r6("height"), "size")


@query
def leaf_order(spark: SparkSession, sf: str) -> DataFrame:
    """Left-to-right order of the sites in their merge tree."""
    points = _site_points(spark, sf)
    return L.leaf_order(L.linkage_merges(points), points)


@query
def linkage_sites(spark: SparkSession, sf: str) -> DataFrame:
    """The merge tree of the sites."""
    return L.linkage_merges(_site_points(spark, sf)).select("left", "right", r6("height"), "size")


@query
def cut_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Site clusters at a height."""
    points = _site_points(spark, sf)
    return L.cut_tree(L.linkage_merges(points, 1.5), points, 1.5)


CUT_HEIGHT = 10.0


@query
def cut_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Entity clusters at a height; only the merges up to it are made."""
    points = _entity_points(spark, sf)
    return L.cut_tree(L.linkage_merges(points, CUT_HEIGHT), points, CUT_HEIGHT)


@query
def community_split(spark: SparkSession, sf: str) -> DataFrame:
    """Entity clusters named as communities by a lookup table; one entity row each."""
    points = _entity_points(spark, sf)
    clusters = L.cut_tree(L.linkage_merges(points, CUT_HEIGHT), points, CUT_HEIGHT)
    names = small_table(spark, [(1, "regional"), (5, "regional")], "cluster int, community string")
    named = clusters.join(names, "cluster", "left").withColumn("community", F.coalesce("community", F.lit("prevalent")))
    dim = B.entity_dim(spark, sf).select("entity", X.class_label().alias("class"))
    return named.withColumnRenamed("id", "entity").join(dim, "entity").select("entity", "class", "cluster", "community")


# ---- transforms, covariates, imputation -------------------------------------------------


@query
def hellinger(spark: SparkSession, sf: str) -> DataFrame:
    return D.hellinger(B.cut_abundance(spark, sf)).select("entity", "site", r6("abundance"))


@query
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    long = D.zscore(B.covariates(spark, sf), "site", B.COVARIATES)
    return long.select("site", "covariate", r6("z"))


@query
def covariate_corr(spark: SparkSession, sf: str) -> DataFrame:
    return C.covariate_corr(B.covariates(spark, sf), B.COVARIATES).select("x", "y", "n", r6("r"))


def _holes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with cells emptied by the first digit of an md5, text and numbers alike."""
    digit = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1)
    volume = (
        B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("n"))
    )
    rows = B.table(spark, sf, "customer").join(volume, "c_custkey", "left")
    return rows.select(
        "c_custkey",
        F.when(digit != "0", F.col("c_acctbal")).alias("c_acctbal"),
        F.when(digit != "1", F.col("c_mktsegment")).alias("c_mktsegment"),
        "price",
        "n",
    )


_HOLED = ["c_acctbal", "c_mktsegment", "price", "n"]


@query
def impute_baseline(spark: SparkSession, sf: str) -> DataFrame:
    filled = I.impute_baseline(_holes(spark, sf), _HOLED)
    return filled.select("c_custkey", "c_mktsegment", r6("c_acctbal"), r6("price"), r6("n"))


@query
def impute_forest(spark: SparkSession, sf: str) -> DataFrame:
    return I.impute_forest(_holes(spark, sf), "c_custkey", _HOLED)


# ---- ordination -------------------------------------------------------------------------


def _ordination_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Non-zero cells after the cut-off, and the covariates of their sites without gaps."""
    known = I.impute_baseline(B.covariates(spark, sf), B.COVARIATES)
    return R.align_sites(B.cut_abundance(spark, sf), known)


@query
def cca_one(spark: SparkSession, sf: str) -> DataFrame:
    """Inertia explained by one covariate."""
    cells, covariates = _ordination_input(spark, sf)
    summary = Z.inertia_summary(Z.fit(cells, covariates, ["s_bal"]), spark)
    return summary.select(r6("total"), r6("constrained"), r6("explained"))


@query
def cca_eigen(spark: SparkSession, sf: str) -> DataFrame:
    cells, covariates = _ordination_input(spark, sf)
    axes = Z.eigenvalues(Z.fit(cells, covariates, ["s_bal", "o_price"]), spark)
    return axes.select("axis", r6("eigenvalue"), r6("share"), r6("share_of_total"), r6("cumulative"))


@query
def cca_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Entity and site scores in both scalings, stacked."""
    cells, covariates = _ordination_input(spark, sf)
    model = Z.fit(cells, covariates, ["s_bal", "o_price"])
    parts = {}
    for scaling in ("sites", "species"):
        for kind, scores in (("entity", Z.entity_scores(model, scaling)), ("site", Z.site_scores(model, scaling))):
            named = scores.withColumnRenamed(kind, "key").withColumn("key", F.col("key").cast("long"))
            parts[f"{scaling}/{kind}"] = named
    return R.tagged_union(parts, "part").select("part", "key", r6("CCA1"), r6("CCA2"))


@query
def decorate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Entity scores with label and plotting size, site scores with label and region, stacked."""
    cells, covariates = _ordination_input(spark, sf)
    model = Z.fit(cells, covariates, ["s_bal", "o_price"])
    entities = Z.decorate_entities(Z.entity_scores(model), B.entity_dim(spark, sf), cells, len(B.sites(spark, sf)))
    sites = Z.decorate_sites(Z.site_scores(model), B.site_dim(spark, sf))
    sites = sites.withColumn("entity", F.col("site").cast("long")).drop("site")
    both = R.tagged_union({"entity": entities, "site": sites}, "part")
    return both.select("part", F.col("entity").alias("key"), r6("CCA1"), r6("CCA2"), "class", r6("size"), "abbrev", "region")


@query
def vif_two(spark: SparkSession, sf: str) -> DataFrame:
    cells, covariates = _ordination_input(spark, sf)
    return Z.vif(cells, covariates, ["s_bal", "o_price"]).select("covariate", r6("vif"))


@query
def vif(spark: SparkSession, sf: str) -> DataFrame:
    cells, covariates = _ordination_input(spark, sf)
    return Z.vif(cells, covariates, ["s_bal", "o_price", "n_cust"]).select("covariate", r6("vif"))


def _moments(spark: SparkSession, sf: str, names: list[str], n: int) -> P.Moments:
    cells, covariates = _ordination_input(spark, sf)
    return P.moments(cells, covariates, names, n, seed=7)


@query
def permutation_f(spark: SparkSession, sf: str) -> DataFrame:
    return P.model_test(_moments(spark, sf, ["s_bal"], 9999)).select("term", r6("f"), "reached", r6("p"))


@query
def permutation_margin(spark: SparkSession, sf: str) -> DataFrame:
    tested = P.margin_test(_moments(spark, sf, ["s_bal", "o_price"], 9999))
    return tested.select("term", r6("f"), "reached", r6("p"))


@query
def permutation_axis(spark: SparkSession, sf: str) -> DataFrame:
    tested = P.axis_test(_moments(spark, sf, ["s_bal", "o_price"], 9999))
    return tested.select("term", r6("f"), "reached", r6("p"))


@query
def stepwise_constraints(spark: SparkSession, sf: str) -> DataFrame:
    return P.stepwise(_moments(spark, sf, ["s_bal", "o_price", "n_cust", "c_bal"], 199))


def _model_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole preparation of a model: gaps filled, sites aligned, Hellinger cells and z-scored covariates."""
    cells, covariates = _ordination_input(spark, sf)
    return D.hellinger(cells), D.zscore_wide(covariates, B.COVARIATES)


@query
def cca_model(spark: SparkSession, sf: str) -> DataFrame:
    """Inertia explained by all covariates together."""
    summary = Z.inertia_summary(Z.fit(*_model_input(spark, sf), B.COVARIATES), spark)
    return summary.select(r6("total"), r6("constrained"), r6("explained"))


def _doubled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """All covariates as measured, and three that follow from them."""
    cells, covariates = _ordination_input(spark, sf)
    more = {"twice": 2 * F.col("s_bal"), "flat": F.lit(7.0), "mixed": F.col("o_price") - 100 * F.col("n_cust") + 3}
    return D.hellinger(cells), covariates.withColumns(more), [*B.COVARIATES, *more]


@query
def vif_model(spark: SparkSession, sf: str) -> DataFrame:
    """Inflation of all covariates; those that follow from others have none and change no other."""
    return Z.vif(*_doubled(spark, sf)).select("covariate", r6("vif"))


@query
def constraint_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Covariates that take no part in the model, with what they follow from."""
    cells, covariates, names = _doubled(spark, sf)
    listed = aliased(Z.chosen_sites(cells, covariates, names)[2], spark)
    return listed.select("covariate", "reason", "source", r6("coefficient"))


@query
def permutation_model(spark: SparkSession, sf: str) -> DataFrame:
    """The whole model of all covariates, and what each adds to the others."""
    cells, covariates = _model_input(spark, sf)
    tested = P.moments(cells, covariates, B.COVARIATES, 999, seed=7)
    return P.model_test(tested).unionByName(P.margin_test(tested)).select("term", r6("f"), "reached", r6("p"))


# ---- trees ------------------------------------------------------------------------------


@query
def clade_label(spark: SparkSession, sf: str) -> DataFrame:
    return G.clade_label(B.tree_edges(spark, sf))


@query
def tip_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as tips under their brands; the price remainder stands for the branch length."""
    part = B.table(spark, sf, "part")
    tips = part.select(
        F.col("p_partkey").alias("node"),
        (-1 - F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")).alias("parent"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.lit("protein"), "p_size").alias("label"),
        F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_size") / 10.0).alias("length"),
    )
    brands = tips.select(F.col("parent").alias("node")).distinct().select(
        "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("length")
    )
    return G.tip_labels(tips.unionByName(brands))
