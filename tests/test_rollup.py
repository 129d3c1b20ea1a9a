from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from abundia.operators import ordering as O
from abundia.operators import reshape as S
from abundia.operators import rollup as U


def cells(spark):
    rows = [("a", "s1", 4.0), ("a", "s2", 2.0), ("b", "s1", 6.0), ("c", "s3", 0.0)]
    return spark.createDataFrame(rows, "entity string, site string, abundance double")


def dim(spark):
    rows = [("a", "P", "C"), ("b", "P", ""), ("c", "Q", "D"), ("d", "Q", "D")]
    return spark.createDataFrame(rows, "entity string, phylum string, class string")


def sites(spark):
    return spark.createDataFrame([("s1", "r1"), ("s2", "r1"), ("s3", "r2")], "site string, region string")


def test_site_totals_keep_zero_sites(spark):
    members = spark.createDataFrame([("a", "M"), ("b", "M"), ("d", "N")], "entity string, metabolism string")
    got = sorted(map(tuple, U.metabolism_site_abundance(members, cells(spark), ["s1", "s2", "s3"]).collect()))
    assert got == [
        ("M", "s1", 10.0, 2), ("M", "s2", 2.0, 1), ("M", "s3", 0.0, 0),
        ("N", "s1", 0.0, 0), ("N", "s2", 0.0, 0), ("N", "s3", 0.0, 0),
    ]


def test_class_means_divide_by_all_sites(spark):
    members = spark.createDataFrame([(e, "M") for e in "abcd"], "entity string, metabolism string")
    got = sorted(map(tuple, U.metabolism_class_abundance(members, cells(spark), dim(spark), sites(spark)).collect()))
    assert got == [("M", "r1", "P, C", 3.0, 1), ("M", "r1", "P, unknown class", 3.0, 1)]


def test_occurrence_goes_by_the_mean(spark):
    traits = spark.createDataFrame([("a", "T", 1), ("c", "T", 1), ("b", "T", 0)], "entity string, trait string, value int")
    fixers = spark.createDataFrame([("a", "F"), ("c", "F"), ("b", "F")], "entity string, pathway string")
    got = {r.entity: (r.mean_abundance, r.occurrence) for r in U.fixation_redox(traits, fixers, fixers, cells(spark), dim(spark), 3).collect()}
    assert got == {"a": (2.0, 1), "b": (0.0, 0), "c": (0.0, 0)}
    prevalent = spark.createDataFrame([("a",)], "entity string")
    depth = {r.entity: (r.depth, r.standard_error) for r in U.community_redox_se(traits, fixers, prevalent, cells(spark), dim(spark), 3).collect()}
    assert depth["a"][0] == "shallow" and depth["b"][0] == "deep"
    assert depth["a"][1] == pytest.approx(pd.Series([4.0, 2.0, 0.0]).sem())


def test_top_k_breaks_ties_by_name(spark):
    ab = spark.createDataFrame([(e, "s", 1.0) for e in "abc"], "entity string, site string, abundance double")
    names = spark.createDataFrame([("a", "P", "z"), ("b", "P", "y"), ("c", "P", "x"), ("d", "P", "w")], "entity string, phylum string, class string")
    got = {r["class"]: (r.ord, r.label) for r in U.top_k_other(names, ab, names, 2).collect()}
    assert got == {"P, x": (1, "P, x"), "P, y": (2, "P, y"), "P, z": (3, "Other"), "P, w": (4, "Other")}


def test_category_order_shares_places(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 0.5), ("z", 3.0)], "c string, v double")
    assert {r.c: r.ord for r in U.category_order(rows, "c", "v").collect()} == {"x": 1, "y": 1, "z": 2}


def test_label_order_with_extra(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "class string") for vs in ("bd", "da"))
    assert {r["class"]: r.ord for r in U.label_order([a, b], "class", ["c"]).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_presence_agreement_counts_unbuilt_cells(spark):
    genes = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g3")], "entity string, gene_id string")
    found = spark.createDataFrame([("g1", "s1", 1.0), ("g2", "s1", 1.0), ("g3", "s3", 2.0), ("g1", "s2", 0.0)], "gene_id string, site string, abundance double")
    fixers = spark.createDataFrame([("a", "F"), ("b", "F"), ("c", "F"), ("a", "G")], "entity string, pathway string")
    got = {r.difference: (r.n, r.percent) for r in U.presence_agreement(genes, found, cells(spark), fixers, 3).collect()}
    # a: s1 both, s2 genome only; b: s1 genome only, s3 gene only; c: nothing
    assert {k: v[0] for k, v in got.items()} == {-1: 2, 0: 6, 1: 1}
    assert sum(v[1] for v in got.values()) == pytest.approx(100)
    excluded = spark.createDataFrame([("b", "g3")], "entity string, gene_id string")
    fewer = U.presence_agreement(genes, found, cells(spark), fixers, 3, excluded)
    assert {r.difference: r.n for r in fewer.collect()} == {-1: 2, 0: 7, 1: 0}


def test_published_culture_counts(spark):
    """Column sums are the community sizes 94, 102 and 208, together 404."""
    levels = ["Domain", "Phylum", "Class", "Order", "Family", "Genus", "Species"]
    counts = {"outer": [6, 16, 17, 30, 20, 5, 0], "arc": [23, 21, 24, 22, 6, 5, 1], "prevalent": [24, 24, 22, 32, 58, 43, 5]}
    rows = [(lv, m, n) for m, ns in counts.items() for lv, n in zip(levels, ns)]
    shares = U.level_shares(spark.createDataFrame(rows, "level string, membership string, n bigint"), levels)
    sums = {r.membership: r.n for r in shares.groupBy("membership").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"outer": 94, "arc": 102, "prevalent": 208, "All": 404}
    last = shares.where("ord = 7").collect()
    assert all(r.cumulative_share == pytest.approx(1) for r in last)


def test_prevalence_and_shares(spark):
    traits = spark.createDataFrame([(e, "T", v) for e, v in zip("abcd", (1, 0, 1, 0))], "entity string, trait string, value int")
    split = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q")], "entity string, community string")
    got = {r.community: (r.n_with_trait, r.percent_entities, r.percent_abundance) for r in U.trait_prevalence(traits, split, cells(spark)).collect()}
    assert got == {"p": (1, 50.0, 50.0), "q": (1, 50.0, None)}
    shares = {r.phylum: r.percent for r in U.share_of_total(cells(spark), dim(spark), "phylum").collect()}
    assert shares == {"P": 100.0, "Q": 0.0}


def test_reshape_round_trip(spark):
    wide = S.to_wide(cells(spark), ["entity"], "site", ["s1", "s2", "s3"], "abundance")
    long = S.to_long(wide, ["entity"], ["s1", "s2", "s3"], "site", "abundance")
    filled = S.zero_filled(cells(spark), ["entity"], "site", ["s1", "s2", "s3"], ["abundance"])
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, filled.collect()))
    flipped = S.transposed(wide, "entity", ["s1", "s2"], ["a", "b"], "site")
    assert {r.site: (r.a, r.b) for r in flipped.collect()} == {"s1": (4.0, 6.0), "s2": (2.0, 0.0)}
    assert S.column_range(wide, "s1", "s3") == ["s1", "s2", "s3"]


def test_quality_tier(spark):
    counts = spark.createDataFrame([("a", 2, 0, 1), ("b", 1, 3, None)], "entity string, t1 int, t2 int, `16s` int")
    named = spark.createDataFrame([(e, "n", 1, 1.0, 0.0) for e in "ab"], "entity string, name string, size int, completeness double, contamination double")
    got = {r.entity: (r.trna_total, r["16s"], r.high_quality) for r in U.quality_tier(counts, ["t1", "t2"], ["16s"], named, 1).collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 0, 0)}


def test_average_rank_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [(i, "g1" if i % 3 else "g2", 0.0 if rng.random() < 0.4 else float(rng.randint(1, 30))) for i in range(600)]
    got = O.average_rank(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "v").toPandas()
    frame = pd.DataFrame(rows, columns=["id", "g", "v"])
    frame["r"] = frame.groupby("g").v.rank(method="average")
    both = got.merge(frame, on="id")
    assert len(both) == 600 and (both.avg_rank - both.r).abs().max() < 1e-12


def test_running_total_over_one_hot_group(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") < 4500, 0).otherwise(1).alias("k"), "id")
    got = O.running_total(rows.repartition(7), ["k"], [F.col("id").desc()], "id").toPandas().sort_values(["k", "id"], ascending=[True, False])
    want = got.groupby("k").id.cumsum() - got.id
    assert (got.before == want).all()


def test_null_labels_are_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a")], "i int, n string")
    assert {r.i: r.unique_label for r in O.make_unique(rows, "n", "i").collect()} == {1: None, 2: "a", 3: None, 4: "a.1"}


def reference_make_unique(names):
    seen, out, count = set(names), [], {}
    used = set()
    for name in names:
        if name not in used:
            used.add(name)
            out.append(name)
            continue
        k = count.get(name, 1)
        while f"{name}.{k}" in seen:
            k += 1
        seen.add(f"{name}.{k}")
        count[name] = k + 1
        out.append(f"{name}.{k}")
    return out


@pytest.mark.parametrize(
    "names",
    [
        ["a", "a", "a.1", "a", "a.1", "b"],
        ["a.2", "a", "a", "a", "a.3", "a", "x"],
        ["a", "a.01", "a", "a.0", "a.1", "a.2", "a", "a.4", "a", "a"],
    ],
)
def test_make_unique_skips_taken_suffixes(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r.unique_label for r in O.make_unique(rows, "n", "i").orderBy("i").collect()]
    assert got == reference_make_unique(names)
    assert len(set(got)) == len(got)


def test_every_group_at_once(spark):
    members = spark.createDataFrame([("a", "M"), ("b", "M"), ("c", "N"), ("d", "N"), ("a", "N")], "entity string, community string")
    ab = spark.createDataFrame(
        [("a", "s1", 4.0), ("a", "s3", 2.0), ("b", "s1", 6.0), ("c", "s3", 2.0), ("d", "s2", 0.0)], "entity string, site string, abundance double"
    )
    totals = U.group_class_totals(members, ab, dim(spark), sites(spark), "all")
    got = {(r.community, r.region, r["class"]): (r.total, r.mean) for r in totals.collect()}
    assert got == {
        ("M", "r1", "P, C"): (4.0, 2.0), ("M", "r2", "P, C"): (2.0, 2.0), ("M", "all", "P, C"): (6.0, 2.0),
        ("M", "r1", "P, unknown class"): (6.0, 3.0), ("M", "all", "P, unknown class"): (6.0, 2.0),
        ("N", "r1", "P, C"): (4.0, 2.0), ("N", "r2", "P, C"): (2.0, 2.0), ("N", "all", "P, C"): (6.0, 2.0),
        ("N", "r2", "Q, D"): (2.0, 2.0), ("N", "all", "Q, D"): (2.0, 2.0 / 3),
    }
    placed = {(r.community, r.region, r["class"]): r.ord for r in U.group_stack_order(totals).collect()}
    assert placed["M", "r1", "P, unknown class"] == 1 and placed["M", "r1", "P, C"] == 2
    assert placed["M", "all", "P, C"] == 1 and placed["N", "r2", "P, C"] == 1 and placed["N", "r2", "Q, D"] == 2
    top = {(r.community, r.region, r.ord): (r.label, r.total) for r in U.group_top_k(totals, 1).collect()}
    assert top["M", "all", 1] == ("P, C", 6.0) and top["M", "all", 2] == ("Other", 6.0)
    assert top["M", "r2", 1] == ("P, C", 2.0) and ("M", "r2", 2) not in top
    share = {(r.community, r.phylum): r.percent for r in U.group_share(ab, dim(spark), members, "phylum").collect()}
    assert share["M", "P"] == 100 and share["N", "P"] == pytest.approx(75) and share["N", "Q"] == pytest.approx(25)
    plan = totals.select("*", F.row_number().over(U.Window.partitionBy("community").orderBy("total")).alias("o")).where("o <= 1")
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_redox_of_every_community_and_region(spark):
    traits = spark.createDataFrame([("a", "T", 1), ("c", "T", 1), ("b", "T", 0)], "entity string, trait string, value int")
    fixers = spark.createDataFrame([("a", "F"), ("c", "F"), ("b", "F")], "entity string, pathway string")
    split = spark.createDataFrame([("a", "M"), ("b", "M"), ("c", "N")], "entity string, community string")
    rows = U.fixation_redox_groups(traits, fixers, split, cells(spark), dim(spark), sites(spark), "all").collect()
    got = {(r.region, r.community, r.entity): (r.mean_abundance, r.occurrence) for r in rows}
    assert got == {
        ("r1", "M", "a"): (3.0, 1), ("r2", "M", "a"): (0.0, 0), ("all", "M", "a"): (2.0, 1),
        **{(r, "M", "b"): (0.0, 0) for r in ("r1", "r2", "all")}, **{(r, "N", "c"): (0.0, 0) for r in ("r1", "r2", "all")},
    }
