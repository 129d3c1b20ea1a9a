"""Canonical abundance tables built from the order-and-supply test tables.

Every binding has the same text in SQL (``SQL``), so that a report can be
checked against another engine on the same parquet files. Numbers that meet a
threshold are built from whole counts, so both engines agree on them exactly.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abundia.operators.markers import MarkerRule, ScoreRule, scores_wide
from abundia.operators.traits import FIXATION, entity_traits, trait_rows
from abundia.sources.scratch import bounded_values

CUT_OFF = 20.0
MAX_SITES = 4096

SCORE_NAMES = {"CBB.Cycle": "cbb", "rTCA.Cycle": "rtca", "TCA.Cycle": "tca", "Wood.Ljungdahl": "wl"}
CBB_RULE = MarkerRule("CBB.present", [["1RF"]])
WL_RULE = MarkerRule("Wood.Ljungdahl.present", [["2AF", "3NO"], ["4RO", "5AF"]])
SCORE_RULES = [
    ScoreRule("Nitrogen Reduction*", "nitrate", ">", 0.4),
    ScoreRule("Sulfur Oxidation*", "thiosulfate", ">=", 0.4),
    ScoreRule("Sulfur Oxidation*", "sulfide", ">", 0.45),
    ScoreRule("Sulfur Reduction", "sulfide", ">", 0.4),
]
MARKER_RULES = [
    MarkerRule("Hydrogen Oxidation", [["1AF"], ["2AF"]]),
    MarkerRule("Hydrogen Oxidation", [["7NO"]]),
    MarkerRule("Aerobic", [["6RF"]]),
    MarkerRule("Microaerobic", [["3RF"], ["4RF"]]),
]
DONORS = ["Hydrogen Oxidation", "Sulfur Oxidation*"]
ACCEPTORS = ["Sulfur Reduction", "Nitrogen Reduction*", "Microaerobic", "Aerobic"]
KINDS = {"donor": DONORS, "acceptor": ACCEPTORS, "fixation": FIXATION, "trophic": ["Autotrophy", "Heterotrophy"]}
TRAITS = [*DONORS, *ACCEPTORS, *FIXATION, "Autotrophy", "Heterotrophy"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; its schema is read from the footers once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, site, abundance): quantity of a part supplied from a nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_partkey").alias("entity"), F.col("s_nationkey").alias("site"))
        .agg(F.sum("l_quantity").alias("abundance"))
    )


def cut_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero cells that remain after the abundance cut-off."""
    return abundance(spark, sf_dir).where(F.col("abundance") >= CUT_OFF)


def entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity"),
        F.col("p_name").alias("name"),
        F.when(size <= 25, "Bacteria").otherwise("Archaea").alias("kingdom"),
        F.col("p_brand").alias("phylum"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")).alias("class"),
        words[0].alias("order"),
        words[1].alias("family"),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("g"), size)).alias("genus"),
        F.when(size % 3 == 0, "").otherwise(F.concat(F.lit("s"), size)).alias("species"),
        (size * 2.0).alias("completeness"),
        (size / 10.0).alias("contamination"),
        (F.col("p_partkey") + 1000).alias("size"),
    )


def site_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("site"),
        F.col("n_name").alias("code"),
        F.when(F.col("n_nationkey") % 2 == 0, "F").otherwise("S").alias("type"),
        F.col("r_name").alias("region"),
    )


def sites(spark: SparkSession, sf_dir: str) -> list[int]:
    """All site keys; the site list is a dimension of checked size."""
    return bounded_values(table(spark, sf_dir, "nation"), "n_nationkey", MAX_SITES)


def order_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation whose entities are orders and whose markers are brands."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("gene_id"), F.col("p_brand").alias("marker")
    )


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation of the abundance entities: line number and flags make the marker."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        F.col("l_orderkey").alias("gene_id"),
        F.concat(F.col("l_linenumber").cast("string"), "l_returnflag", "l_linestatus").alias("marker"),
    )


def pathway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pathway, score) with scores near [0, 1]."""
    def percent(name: str) -> F.Column:
        return F.sum(F.round(F.col(name) * 100).cast("long")).cast("double")

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    sums = lines.groupBy("l_partkey").agg(
        F.count("*").cast("double").alias("lines"),
        percent("l_discount").alias("discount"),
        percent("l_tax").alias("tax"),
        *[F.count(F.when(F.col("l_returnflag") == f, 1)).cast("double").alias(f"flag_{f}") for f in "ANR"],
        F.count(F.when(F.col("l_linestatus") == "F", 1)).cast("double").alias("status_F"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    scores = sums.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("entity"),
        (F.col("discount") / (F.col("lines") * 10)).alias("CBB.Cycle"),
        (F.col("p_size") / F.lit(50.0)).alias("rTCA.Cycle"),
        (F.col("status_F") / F.col("lines")).alias("TCA.Cycle"),
        (F.col("tax") / (F.col("lines") * 7)).alias("Wood.Ljungdahl"),
        (F.col("flag_R") / F.col("lines")).alias("sulfide"),
        (F.col("flag_A") / F.col("lines")).alias("thiosulfate"),
        (F.col("flag_N") / F.col("lines")).alias("nitrate"),
    )
    names = ["CBB.Cycle", "rTCA.Cycle", "TCA.Cycle", "Wood.Ljungdahl", "sulfide", "thiosulfate", "nitrate"]
    return scores.unpivot(["entity"], [F.col(f"`{n}`") for n in names], "pathway", "score")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_wide(pathway(spark, sf_dir), SCORE_NAMES)


def trait_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate side and all trait flags, one row per scored entity."""
    rules = [CBB_RULE, WL_RULE, *MARKER_RULES]
    return entity_traits(pathway(spark, sf_dir), annotation(spark, sf_dir), SCORE_NAMES, SCORE_RULES, rules)


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, trait, kind, value) of every decided flag."""
    return trait_rows(trait_wide(spark, sf_dir), KINDS)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, metabolism) for every donor, acceptor and fixation trait shown."""
    kinds = {k: v for k, v in KINDS.items() if k != "trophic"}
    held = trait_rows(trait_wide(spark, sf_dir), kinds).where("value > 0")
    return held.select("entity", F.col("trait").alias("metabolism"))


def fixers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, pathway) for every carbon fixation pathway shown."""
    held = trait_rows(trait_wide(spark, sf_dir), {"fixation": FIXATION}).where("value > 0")
    return held.select("entity", F.col("trait").alias("pathway"))


def redox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, trait, value) of donors and acceptors."""
    kinds = {"donor": DONORS, "acceptor": ACCEPTORS}
    return trait_rows(trait_wide(spark, sf_dir), kinds).select("entity", "trait", "value")


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of the entities into two communities by size class."""
    small = F.when(F.col("p_size") <= 20, "prevalent").otherwise("regional")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), small.alias("community"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site with customer, supplier and order figures; some sites lack some."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    by_customer = customer.groupBy(F.col("c_nationkey").alias("site")).agg(
        F.avg("c_acctbal").alias("c_bal"),
        F.count("*").cast("double").alias("n_cust"),
        F.count(F.when(F.col("c_acctbal") > 9900, 1)).cast("double").alias("n_rich"),
    )
    by_supplier = supplier.groupBy(F.col("s_nationkey").alias("site")).agg(
        F.avg("s_acctbal").alias("s_bal"), F.count("*").cast("double").alias("n_supp")
    )
    by_order = (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("site"))
        .agg(F.avg("o_totalprice").alias("o_price"))
    )
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"))
    return functools.reduce(lambda a, b: a.join(b, "site", "left"), [by_customer, by_supplier, by_order], names)


COVARIATES = ["c_bal", "n_cust", "n_rich", "s_bal", "n_supp", "o_price"]


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, label): region over nation over customer over order.

    Regions are labelled, and so are the customers of one market segment.
    """
    region = table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"),
        F.lower("r_name").alias("label"),
    )
    nation = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"),
        F.lit(None).cast("string").alias("label"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("node"), F.concat(F.lit("N"), "c_nationkey").alias("parent"),
        F.when(F.col("c_mktsegment") == "BUILDING", "building").alias("label"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), "o_orderkey").alias("node"), F.concat(F.lit("C"), "o_custkey").alias("parent"),
        F.lit(None).cast("string").alias("label"),
    )
    return region.unionByName(nation).unionByName(customer).unionByName(orders)
