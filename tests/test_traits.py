from __future__ import annotations

from pyspark.sql import functions as F

from abundia.operators import markers as M
from abundia.operators import relational as R
from abundia.operators import traits as T


def ids(df):
    return sorted(r[0] for r in df.select("entity").collect())


def scores(spark):
    rows = [
        ("cbb", 0.6, 0.0, 0.0, 0.0),
        ("rtca", 0.0, 1.0, 0.5, 0.0),
        ("half", 0.0, 1.0, 0.49, 0.0),
        ("wl", 0.0, 0.0, 0.0, 0.6),
        ("low", 0.59, 0.9, 0.9, 0.59),
        ("open", None, 0.0, 0.0, 0.1),
        ("known", None, 0.0, 0.0, 0.7),
        ("late", 0.6, 1.0, 0.2, 0.0),
    ]
    return spark.createDataFrame(rows, "entity string, cbb double, rtca double, tca double, wl double")


def test_candidates_at_the_thresholds(spark):
    sides = {r.entity: r.candidate for r in T.trophic_candidates(scores(spark)).collect()}
    assert sides == {
        "cbb": "autotroph", "rtca": "autotroph", "half": "heterotroph", "wl": "autotroph",
        "low": "heterotroph", "known": "autotroph", "late": "autotroph",
    }
    assert ids(T.strict_wl(scores(spark))) == ["known"]


def test_trophic_class_needs_evidence_within_candidates(spark):
    annotation = spark.createDataFrame(
        [("cbb", "g", "C"), ("half", "g", "C"), ("wl", "g1", "A1"), ("wl", "g2", "B2"), ("known", "g", "A1")],
        "entity string, gene_id string, marker string",
    )
    rules = M.MarkerRule("c", [["C"]]), M.MarkerRule("w", [["A1", "A2"], ["B1", "B2"]])
    got = {
        r["entity"]: (r["CBB.present"], r["rTCA.present"], r["Wood.Ljungdahl.present"], r["Autotrophy"], r["Heterotrophy"])
        for r in T.trophic_class(scores(spark), annotation, *rules).collect()
    }
    assert got["cbb"] == (1, 0, 0, 1, 0)
    assert got["half"] == (0, 0, 0, 0, 1)
    assert got["wl"] == (0, 0, 1, 1, 0)
    assert got["known"] == (0, 0, 0, 0, 1)
    # exactly 1 counts for rTCA even when another rule admitted the entity
    assert got["late"] == (0, 1, 0, 1, 0)


def test_marker_rules(spark):
    rows = [("a", "1", "K1"), ("a", "2", "K2"), ("a", "2", "K2"), ("b", "1", "K1"), ("b", "2", "K1"), ("c", "1", "K9"), ("d", "1", None)]
    annotation = spark.createDataFrame(rows, "entity string, gene_id string, marker string")
    assert ids(M.entities_with_any(annotation, ["K1", "K9"])) == ["a", "b", "c"]
    assert ids(M.entities_with_all(annotation, ["K1", "K2"])) == ["a"]
    found = M.marker_evidence(annotation, [M.MarkerRule("t", [["K1"], ["K2"]]), M.MarkerRule("t", [["K9"]]), M.MarkerRule("u", [["K1"]])])
    assert sorted(map(tuple, found.collect())) == [("a", "t"), ("a", "u"), ("b", "u"), ("c", "t")]
    flags = {r.entity: (r.K1, r.K2) for r in M.marker_flags(annotation, ["K1", "K2"]).collect()}
    assert flags == {"a": (1, 1), "b": (1, 0)}


def test_redox_rules_and_missing_scores(spark):
    pathway = spark.createDataFrame(
        [("a", "p", 0.32), ("a", "q", 0.33), ("b", "p", 0.1), ("c", "p", None)], "entity string, pathway string, score double"
    )
    annotation = spark.createDataFrame([("c", "g", "K"), ("zz", "g", "K")], "entity string, gene_id string, marker string")
    rules = [M.ScoreRule("S", "p", ">=", 0.32), M.ScoreRule("N", "q", ">", 0.33)]
    names = {"p": "cbb", "q": "rtca", "r": "tca", "s": "wl"}
    wide = T.entity_traits(pathway, annotation, names, rules, [M.MarkerRule("S", [["K"]]), M.MarkerRule("H", [["K"]])])
    got = {r.entity: (r.S, r.N, r.H) for r in wide.collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 0, 0), "c": (1, 0, 1)}
    # no Wood-Ljungdahl score is known, so no side and no fixation flag is decided
    rows = T.trait_rows(wide, {"redox": ["S", "N", "H"], "fixation": T.FIXATION})
    assert rows.count() == 9 and {r.kind for r in rows.collect()} == {"redox"}


def traits(spark):
    rows = [("a", "X", 1), ("a", "Y", 1), ("b", "X", 0), ("b", "Y", 1), ("c", "X", 1), ("c", "Y", 0)]
    return spark.createDataFrame(rows, "entity string, trait string, value int")


def test_overrides_are_idempotent(spark):
    edits = spark.createDataFrame([("a", "X", 0), ("b", "X", 1), ("nobody", "X", 1)], "entity string, trait string, value int")
    once = R.apply_overrides(traits(spark), edits)
    twice = R.apply_overrides(once, edits)
    assert sorted(map(tuple, once.select("entity", "trait", "value").collect())) == sorted(map(tuple, twice.select("entity", "trait", "value").collect()))
    assert {r.entity: r.value for r in once.where("trait = 'X'").collect()} == {"a": 0, "b": 1, "c": 1}


def test_taxon_and_conditional_masks(spark):
    dim = spark.createDataFrame([("a", "P1", "C1"), ("b", "P2", "C1"), ("c", "P1", "C2")], "entity string, phylum string, class string")
    rules = spark.createDataFrame([("phylum", "P1", "X", 0), ("class", "C1", "Y", 0)], "rank string, taxon string, trait string, value int")
    got = {(r.entity, r.trait): r.value for r in R.taxon_mask(traits(spark), dim, rules).collect()}
    assert got == {("a", "X"): 0, ("a", "Y"): 0, ("b", "X"): 0, ("b", "Y"): 0, ("c", "X"): 0, ("c", "Y"): 0}
    got = {(r.entity, r.trait): r.value for r in R.conditional_mask(traits(spark), "Y", "X").collect()}
    assert got[("a", "Y")] == 0 and got[("b", "Y")] == 1 and got[("a", "X")] == 1


def test_donor_acceptor_rows_and_totals(spark):
    names = ["d1", "d2", "d3", "d4", "a1", "a2", "a3", "a4", "a5"]
    rows = [("e", n, int(n in ("d1", "a5"))) for n in names] + [("f", n, 1) for n in names]
    held = spark.createDataFrame(rows, "entity string, trait string, value int")
    pairs = T.donor_acceptor_pairs(held, names[:4], names[4:])
    assert pairs.count() == 40
    totals = {(r.pathway, r.metabolism): r.number for r in T.fixation_trait_totals(held, ["d1", "d2"], ["a4", "a5"]).collect()}
    assert totals == {("d1", "a4"): 1, ("d1", "a5"): 2, ("d2", "a4"): 1, ("d2", "a5"): 1}


def test_flags_unions_and_fixed_order(spark):
    left = spark.createDataFrame([("a",), ("b",)], "entity string")
    keys = spark.createDataFrame([("a",), ("a",)], "entity string")
    assert sorted(map(tuple, R.flag_by_keys(left, keys, "entity", "f").select("entity", "f").collect())) == [("a", 1), ("b", 0)]
    tagged = R.tagged_union({"x": left, "y": left.withColumn("n", F.lit(1))}, "tag")
    assert tagged.count() == 4 and tagged.where("n IS NULL").count() == 2
    ordered = R.fixed_order(left, "entity", ["b", "c"]).collect()
    assert {r.entity: r.ord for r in ordered} == {"a": None, "b": 1}


def test_align_sites_drops_empty_and_unknown(spark):
    cells = spark.createDataFrame([("s1", "e", 1.0), ("s2", "e", 0.0), ("s3", "e", 2.0)], "site string, entity string, abundance double")
    known = spark.createDataFrame([("s1", 1.0), ("s2", 1.0), ("s4", 1.0)], "site string, x double")
    a, b = R.align_sites(cells, known)
    assert [r.site for r in a.collect()] == ["s1"] and [r.site for r in b.collect()] == ["s1"]
