"""Abundance totals by site, region, taxon, trait and community.

Abundance is sparse: a missing cell is 0. Means over sites therefore divide a
sum by the number of sites and never average the rows that happen to exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundia.functions.numeric import cut_off, positive, rescaled, standard_error
from abundia.functions.text import class_label
from abundia.operators.ordering import dense_positions, running_total
from abundia.operators.reshape import to_wide, zero_filled
from abundia.sources.scratch import bounded_values, saved, sized

MAX_REGIONS = 1000


def clean_abundance(abundance: DataFrame, dropped: DataFrame, entity_dim: DataFrame, threshold: float) -> DataFrame:
    """Drop unused sites, attach the entity columns and zero values below the cut-off."""
    kept = abundance.join(dropped.select("site"), "site", "left_anti")
    return kept.withColumn("abundance", cut_off(F.col("abundance"), threshold)).join(entity_dim, "entity")


def lowest_peak(abundance: DataFrame) -> DataFrame:
    """Highest abundance of the least abundant entity, a cut-off to consider."""
    return abundance.groupBy("entity").agg(F.max("abundance").alias("peak")).agg(F.min("peak").alias("cut_off"))


def region_slice(abundance: DataFrame, site_dim: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Cells of the sites that lie in the given regions, with their region."""
    sites = site_dim.where(F.col("region").isin(list(regions))).select("site", "region")
    return abundance.join(sites, "site")


def entity_stats(abundance: DataFrame, n_sites: int) -> DataFrame:
    """Total, mean over all sites and standard error per entity."""
    sums = abundance.groupBy("entity").agg(
        F.sum("abundance").alias("total"), F.count("abundance").alias("_present"), F.var_pop("abundance").alias("_variance")
    )
    return sums.select(
        "entity",
        "total",
        (F.col("total") / n_sites).alias("mean"),
        standard_error(F.col("total"), F.col("_variance") * F.col("_present"), F.col("_present"), n_sites).alias("standard_error"),
    )


def group_site_sum(abundance: DataFrame, entity_dim: DataFrame, group: str) -> DataFrame:
    """Abundance per taxon and site."""
    return abundance.join(entity_dim.select("entity", group), "entity").groupBy(group, "site").agg(
        F.sum("abundance").alias("abundance")
    )


def share_of_total(abundance: DataFrame, entity_dim: DataFrame, group: str) -> DataFrame:
    """Abundance of each taxon and its percentage of the whole."""
    totals = abundance.join(entity_dim.select("entity", group), "entity").groupBy(group).agg(
        F.sum("abundance").alias("total")
    )
    whole = totals.agg(F.sum("total")).scalar()
    return totals.withColumn("percent", F.col("total") / whole * 100)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs in any of the columns."""
    one = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    return df.select(one.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def rescale_minmax(
    df: DataFrame, value: str, keys: Sequence[str] = (), to: tuple[float, float] = (0.0, 1.0), out: str = "rescaled"
) -> DataFrame:
    """Map the values of the table, or of each group, onto a range."""
    ends = [F.min(value).alias("_low"), F.max(value).alias("_high")]
    if not keys:
        low = df.agg(F.min(value)).scalar()
        high = df.agg(F.max(value)).scalar()
        return df.withColumn(out, rescaled(F.col(value), low, high, to))
    bounds = sized(df.groupBy(*keys).agg(*ends))
    scaled = rescaled(F.col(value), F.col("_low"), F.col("_high"), to)
    return df.join(bounds, list(keys), "left").withColumn(out, scaled).drop("_low", "_high")


def metabolism_site_abundance(members: DataFrame, abundance: DataFrame, sites: Sequence[Any]) -> DataFrame:
    """Abundance and number of present entities per member group and site.

    ``members`` is (entity, group columns...). Every listed site appears for
    every group, with zeros where nothing was found.
    """
    groups = [c for c in members.columns if c != "entity"]
    cells = abundance.where(F.col("site").isin(list(sites)))
    sums = (
        members.join(cells, "entity", "left")
        .groupBy(*groups, "site")
        .agg(
            F.coalesce(F.sum("abundance"), F.lit(0.0)).alias("abundance"),
            F.count(F.when(F.col("abundance") != 0, 1)).alias("number"),
        )
    )
    return zero_filled(sums, groups, "site", sites, ["abundance", "number"])


def with_whole(site_dim: DataFrame, whole: str | None) -> DataFrame:
    """(site, region) of a site table; with ``whole`` every site lies in a region of that name too."""
    if whole is None:
        return site_dim.select("site", "region")
    return site_dim.select("site", F.explode(F.array(F.col("region"), F.lit(whole))).alias("region"))


def metabolism_class_abundance(
    members: DataFrame, abundance: DataFrame, entity_dim: DataFrame, site_dim: DataFrame, whole: str | None = None
) -> DataFrame:
    """Mean site abundance and entity count per member group, region and ``phylum, class``.

    Entities without any abundance in a region are not counted there. With
    ``whole`` the same for all sites together is a region of that name.
    """
    groups = [c for c in members.columns if c != "entity"]
    placed = with_whole(site_dim, whole)
    sizes = placed.groupBy("region").agg(F.count("*").alias("_sites"))
    present = (
        abundance.join(placed, "site")
        .groupBy("entity", "region")
        .agg(F.sum("abundance").alias("_total"), F.max(positive(F.abs("abundance"))).alias("_seen"))
        .where("_seen > 0")
    )
    named = entity_dim.select("entity", class_label().alias("class"))
    return (
        members.join(present, "entity")
        .join(named, "entity")
        .groupBy(*groups, "region", "class")
        .agg(F.sum("_total").alias("_sum"), F.count("*").alias("number"))
        .join(sizes, "region")
        .select(*groups, "region", "class", (F.col("_sum") / F.col("_sites")).alias("average_abundance"), "number")
    )


def entity_trait_means(traits: DataFrame, stats: DataFrame, entity_dim: DataFrame) -> DataFrame:
    """Mean abundance of an entity under each trait it shows, 0 under the others.

    ``occurrence`` goes by the mean, so an entity that is absent from the
    sites counts as not occurring even if it has the trait.
    """
    named = entity_dim.select("entity", class_label().alias("class"))
    mean = F.when(F.col("value") > 0, F.coalesce("mean", F.lit(0.0))).otherwise(F.lit(0.0))
    joined = traits.join(named, "entity").join(stats, "entity", "left").withColumn("mean_abundance", mean)
    return joined.withColumn("occurrence", positive(F.col("mean_abundance")))


def fixation_redox(
    traits: DataFrame,
    fixers: DataFrame,
    group: DataFrame,
    abundance: DataFrame,
    entity_dim: DataFrame,
    n_sites: int,
) -> DataFrame:
    """Redox traits of the carbon fixers of one community, weighted by mean abundance.

    ``fixers`` is (entity, pathway); ``traits`` holds the redox traits only.
    """
    chosen = fixers.join(group.select("entity"), "entity", "left_semi")
    stats = entity_stats(abundance, n_sites)
    held = entity_trait_means(traits, stats, entity_dim).join(chosen, "entity")
    return held.select("entity", "pathway", "class", "trait", "mean_abundance", "occurrence")


def fixation_redox_groups(
    traits: DataFrame,
    fixers: DataFrame,
    communities: DataFrame,
    abundance: DataFrame,
    entity_dim: DataFrame,
    site_dim: DataFrame,
    whole: str | None = None,
) -> DataFrame:
    """``fixation_redox`` of every community in every region, as one grouping of the cells.

    A fixer has a row in each region, with mean 0 where it is absent.
    """
    sizes = with_whole(site_dim, whole).groupBy("region").agg(F.count("*").alias("_sites"))
    regions = bounded_values(sizes, "region", MAX_REGIONS)
    sums = abundance.join(with_whole(site_dim, whole), "site").groupBy("entity", "region").agg(F.sum("abundance").alias("_total"))
    chosen = fixers.join(communities.select("entity", "community"), "entity")
    placed = chosen.withColumn("region", F.explode(F.array(*[F.lit(r) for r in regions])))
    means = placed.join(sums, ["entity", "region"], "left").join(sizes, "region")
    means = means.select("entity", "pathway", "community", "region", (F.coalesce("_total", F.lit(0.0)) / F.col("_sites")).alias("mean"))
    named = entity_dim.select("entity", class_label().alias("class"))
    shown = F.when(F.col("value") > 0, F.col("mean")).otherwise(F.lit(0.0)).alias("mean_abundance")
    held = traits.join(named, "entity").join(means, "entity").select("region", "community", "entity", "pathway", "class", "trait", shown)
    return held.withColumn("occurrence", positive(F.col("mean_abundance")))


def community_redox_se(
    traits: DataFrame,
    fixers: DataFrame,
    prevalent: DataFrame,
    abundance: DataFrame,
    entity_dim: DataFrame,
    n_sites: int,
) -> DataFrame:
    """The same for fixers inside (``shallow``) and outside (``deep``) a community, with standard errors."""
    listed = prevalent.select("entity").distinct().withColumn("_in", F.lit(1))
    side = F.when(F.col("_in") == 1, F.lit("shallow")).otherwise(F.lit("deep"))
    chosen = fixers.select("entity").distinct().join(listed, "entity", "left").select("entity", side.alias("depth"))
    held = entity_trait_means(traits, entity_stats(abundance, n_sites), entity_dim).join(chosen, "entity")
    error = F.coalesce("standard_error", F.lit(0.0)).alias("standard_error")
    return held.select("depth", "entity", "class", "trait", "mean_abundance", error, "occurrence")


def class_totals(members: DataFrame, abundance: DataFrame, entity_dim: DataFrame) -> DataFrame:
    """Total abundance of the member entities per ``phylum, class``."""
    chosen = entity_dim.join(members.select("entity"), "entity", "left_semi")
    named = chosen.select("entity", class_label().alias("class"))
    sums = abundance.groupBy("entity").agg(F.sum("abundance").alias("_total"))
    return named.join(sums, "entity", "left").groupBy("class").agg(
        F.coalesce(F.sum("_total"), F.lit(0.0)).alias("total")
    )


def class_stack_order(members: DataFrame, abundance: DataFrame, entity_dim: DataFrame, n_sites: int) -> DataFrame:
    """Classes by summed mean abundance, largest first; ties in class order."""
    means = class_totals(members, abundance, entity_dim).withColumn("mean", F.col("total") / n_sites)
    return dense_positions(means, [F.col("total").desc(), F.col("class")])


def top_k_other(members: DataFrame, abundance: DataFrame, entity_dim: DataFrame, k: int = 10) -> DataFrame:
    """Class totals in order; the first k keep their label, the rest read ``Other``."""
    placed = dense_positions(class_totals(members, abundance, entity_dim), [F.col("total").desc(), F.col("class")])
    return placed.withColumn("label", F.when(F.col("ord") <= k, F.col("class")).otherwise(F.lit("Other")))


def group_class_totals(
    members: DataFrame, abundance: DataFrame, entity_dim: DataFrame, site_dim: DataFrame, whole: str | None = None
) -> DataFrame:
    """Total and mean abundance per member group, region and class; classes without any abundance in a region have no row."""
    groups = [c for c in members.columns if c != "entity"]
    placed = with_whole(site_dim, whole)
    sizes = placed.groupBy("region").agg(F.count("*").alias("_sites"))
    cells = abundance.where("abundance <> 0").join(placed, "site").groupBy("entity", "region").agg(F.sum("abundance").alias("_total"))
    named = entity_dim.select("entity", class_label().alias("class"))
    sums = members.join(named, "entity").join(cells, "entity").groupBy(*groups, "region", "class").agg(F.sum("_total").alias("total"))
    return sums.join(sizes, "region").select(*groups, "region", "class", "total", (F.col("total") / F.col("_sites")).alias("mean"))


def group_stack_order(totals: DataFrame) -> DataFrame:
    """Places of the classes within each group of ``group_class_totals``, largest first; ties in class order."""
    groups = [c for c in totals.columns if c not in ("class", "total", "mean")]
    placed = running_total(totals, groups, [F.col("total").desc(), F.col("class")], out="ord")
    return placed.withColumn("ord", F.col("ord") + 1)


def group_top_k(totals: DataFrame, k: int = 10) -> DataFrame:
    """The k largest classes of each group in order, and one row ``Other`` for the sum of all others.

    Only k rows of a group leave a task for the sort that ranks them: the
    limit on the rank is known to the window. The rest is summed by group.
    """
    groups = [c for c in totals.columns if c not in ("class", "total", "mean")]
    totals = saved(totals)
    order = Window.partitionBy(*groups).orderBy(F.col("total").desc(), F.col("class"))
    top = saved(totals.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k))
    keys = [*groups, "class"]
    rest = totals.join(top.select(*keys), keys, "left_anti").groupBy(*groups).agg(
        F.sum("total").alias("total"), F.sum("mean").alias("mean")
    )
    other = rest.select(*groups, F.lit("Other").alias("class"), "total", "mean", F.lit(k + 1).alias("ord"))
    return top.unionByName(other).withColumnRenamed("class", "label")


def group_share(abundance: DataFrame, entity_dim: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Abundance of each taxon within every member group and its percentage of that group."""
    groups = [c for c in members.columns if c != "entity"]
    sums = abundance.groupBy("entity").agg(F.sum("abundance").alias("_total"))
    totals = members.join(entity_dim.select("entity", group), "entity").join(sums, "entity").groupBy(*groups, group).agg(
        F.sum("_total").alias("total")
    )
    whole = totals.groupBy(*groups).agg(F.sum("total").alias("_whole"))
    return totals.join(whole, groups).select(*groups, group, "total", (F.col("total") / F.col("_whole") * 100).alias("percent"))


def category_order(df: DataFrame, category: str, value: str) -> DataFrame:
    """Order of the categories by their summed value, smallest first; equal sums share a place."""
    sums = df.groupBy(category).agg(F.sum(value).alias("total"))
    places = dense_positions(sums.select("total").distinct(), [F.col("total")])
    return sums.join(places, "total").select(category, "total", "ord")


def label_order(parts: Sequence[DataFrame], column: str, extra: Sequence[str] = ()) -> DataFrame:
    """Number all distinct labels of several tables, plus extra ones, in text order."""
    labels = parts[0].select(column)
    for part in parts[1:]:
        labels = labels.unionByName(part.select(column))
    if extra:
        labels = labels.unionByName(labels.sparkSession.createDataFrame([(e,) for e in extra], f"`{column}` string"))
    return dense_positions(labels.distinct(), [F.col(column)])


def trait_prevalence(traits: DataFrame, communities: DataFrame, abundance: DataFrame, by: str = "community") -> DataFrame:
    """Share of the entities, and of the abundance, that shows each trait, per community or other column."""
    sums = abundance.groupBy("entity").agg(F.sum("abundance").alias("_total"))
    weighted = communities.select("entity", by).join(sums, "entity", "left")
    total = F.coalesce("_total", F.lit(0.0))
    shown = F.col("value") > 0
    grouped = traits.join(weighted, "entity").groupBy(by, "trait").agg(
        F.count("*").alias("_entities"),
        F.count(F.when(shown, 1)).alias("n_with_trait"),
        F.sum(total).alias("_all"),
        F.sum(F.when(shown, total).otherwise(0.0)).alias("_with"),
    )
    return grouped.select(
        by,
        "trait",
        "n_with_trait",
        (F.col("n_with_trait") / F.col("_entities") * 100).alias("percent_entities"),
        (F.try_divide(F.col("_with"), F.col("_all")) * 100).alias("percent_abundance"),
    )


def pathway_site_matrix(
    fixers: DataFrame, communities: DataFrame, abundance: DataFrame, sites: Sequence[Any]
) -> DataFrame:
    """Abundance per community and pathway with one column per site, in the given site order."""
    members = fixers.join(communities.select("entity", "community"), "entity")
    cells = members.join(abundance, "entity")
    return to_wide(cells, ["community", "pathway"], "site", sites, "abundance")


def presence_agreement(
    genes: DataFrame,
    gene_abundance: DataFrame,
    genomes: DataFrame,
    fixers: DataFrame,
    n_sites: int,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """Compare where key genes and where their genomes are found.

    ``genes`` is (entity, gene_id) of the key genes. Per fixer and site the
    gene presence minus the genome presence is -1, 0 or 1; cells absent from
    both tables are counted as 0 without being built. ``excluded`` lists
    (entity, gene_id) to leave out, such as genes checked by hand.
    """
    if excluded is not None:
        genes = genes.join(excluded.select("entity", "gene_id"), ["entity", "gene_id"], "left_anti")
    by_gene = (
        genes.distinct()
        .join(gene_abundance.where("abundance <> 0"), "gene_id")
        .select("entity", "site", F.lit(1).alias("gene"), F.lit(0).alias("genome"))
    )
    by_genome = genomes.where("abundance <> 0").select(
        "entity", "site", F.lit(0).alias("gene"), F.lit(1).alias("genome")
    )
    ids = fixers.select("entity").distinct()
    cells = (
        by_gene.unionByName(by_genome)
        .join(ids, "entity", "left_semi")
        .groupBy("entity", "site")
        .agg((F.max("gene") - F.max("genome")).alias("difference"))
    )
    moved = cells.agg(
        F.count(F.when(F.col("difference") == -1, 1)).alias("_minus"),
        F.count(F.when(F.col("difference") == 1, 1)).alias("_plus"),
    )
    all_cells = ids.agg(F.count("*") * n_sites).scalar()
    counted = moved.withColumn("_all", all_cells).select(
        "_all",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(step).alias("difference"), cells.alias("n"))
                    for step, cells in (
                        (-1, F.col("_minus")),
                        (0, F.col("_all") - F.col("_minus") - F.col("_plus")),
                        (1, F.col("_plus")),
                    )
                ]
            )
        ),
    )
    return counted.select("difference", "n", (F.try_divide(F.col("n"), F.col("_all")) * 100).alias("percent"))


def quality_tier(
    counts: DataFrame, trna: Sequence[str], rrna: Sequence[str], entity_dim: DataFrame, min_trna: int = 18
) -> DataFrame:
    """Genome quality table: tRNA kinds found, rRNA genes found and the high-quality flag."""
    seen = {c: positive(F.col(f"`{c}`")) for c in rrna}
    kinds: Column = F.lit(0)
    for c in trna:
        kinds = kinds + positive(F.col(f"`{c}`"))
    table = counts.select("entity", kinds.alias("trna_total"), *[flag.alias(c) for c, flag in seen.items()])
    good = F.col("trna_total") >= min_trna
    for c in rrna:
        good = good & (F.col(f"`{c}`") == 1)
    return table.withColumn("high_quality", good.cast("int")).join(
        entity_dim.select("entity", "name", "size", "completeness", "contamination"), "entity"
    )


def level_shares(counts: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Share of each level in its group and overall, with the running share in level order.

    ``counts`` is (level, membership, n). The levels are a fixed short list.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("level"))
    overall = counts.groupBy("level").agg(F.sum("n").alias("n")).select("level", F.lit("All").alias("membership"), "n")
    stacked = counts.select("level", "membership", "n").unionByName(overall)
    group = Window.partitionBy("membership")
    ordered = group.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(group)
    return stacked.withColumn("ord", place.cast("int")).select(
        "level", "membership", "n", "ord",
        (F.col("n") / total).alias("share"),
        (F.sum("n").over(ordered) / total).alias("cumulative_share"),
    )


def heatmap_cells(abundance: DataFrame, sites: Sequence[Any]) -> DataFrame:
    """Every entity x site cell with ``log(abundance + 0.5)``."""
    cells = zero_filled(abundance, ["entity"], "site", sites, ["abundance"])
    return cells.withColumn("log_abundance", F.log(F.col("abundance") + 0.5))


def ordered_labels(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """Positions from 0 within a group, for axis orders computed elsewhere."""
    return running_total(df, keys, order, out=out)
