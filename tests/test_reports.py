"""The two whole reports on small made-up sheets with the real column layout."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundia.plans import abundance_report as A
from abundia.plans import fixed_values as V
from abundia.plans import ordination_report as O
from abundia.sources.schema import RANKS

SITES = [s for region in V.REGION_SITES.values() for s in region]
RAW = {final: raw for raw, final in V.SITE_NAMES.items()}
ENTITIES = [f"bin_{i}" for i in (145, 144, 3, 240, 7, 8, 9, 10, 11, 13, 15, 17, 18, 19, 21, 22, 23, 24, 25, 26)]
PATHWAYS = [
    "CBB.Cycle", "rTCA.Cycle", "TCA.Cycle", "Wood.Ljungdahl", "NiFe.hydrogenase", "nitrite.reduction",
    "sulfide.oxidation", "dissimilatory.sulfite.....sulfide", "thiosulfate.oxidation",
]


@pytest.fixture(scope="module")
def sheets(spark):
    rng = np.random.default_rng(7)
    n = len(ENTITIES)
    groups = rng.integers(0, 3, n)
    base = np.array([[9.0 if s in sites else 0.02 for s in SITES] for sites in V.REGION_SITES.values()])
    ab = base[groups] * rng.uniform(0.3, 1.5, (n, len(SITES)))
    columns = [*[RAW[s] for s in SITES], *V.UNUSED_SITES]
    wide = spark.createDataFrame(
        [(e, *map(float, row), *[1.0] * len(V.UNUSED_SITES)) for e, row in zip(ENTITIES, ab)],
        "entity string, " + ", ".join(f"`{c}` double" for c in columns),
    )
    taxa = [("Bacteria", "Desulfobacterota" if i == 4 else f"P{i % 4}", "Anaerolineae" if i == 5 else "" if i % 5 == 0 else f"C{i % 3}", "", "", "", "") for i in range(n)]
    score = rng.random((n, len(PATHWAYS)))
    score[0, 0], score[2, 0] = 0.9, 0.7
    pathway = spark.createDataFrame(
        [(e, *t, *map(float, s)) for e, t, s in zip(ENTITIES, taxa, score)],
        "entity string, " + ", ".join(f"`{r}` string" for r in RANKS) + ", " + ", ".join(f"`{p}` double" for p in PATHWAYS),
    )
    quality = spark.createDataFrame([(e, 90.0, 1.0, 0.5, 1000, 2000 + i) for i, e in enumerate(ENTITIES)], "entity string, completeness double, contamination double, gc double, n50 long, size long")
    iron = spark.createDataFrame(
        [(c, *[float((i + k) % 3 == 0) for i in range(n - 2)]) for k, c in enumerate(("iron_oxidation", "iron_reduction", "iron_storage"))],
        "category string, " + ", ".join(f"`{e}` double" for e in ENTITIES[:-2]),
    )
    markers = ["K00855", "K00192", "K03520", "K02274", "K00404", "K06282", "K06281", "K15230"]
    annotation = spark.createDataFrame(
        [(e, f"{e}_{m}", m) for i, e in enumerate(ENTITIES) for j, m in enumerate(markers) if (i + j) % 2 == 0 or i < 6],
        "entity string, gene_id string, marker string",
    )
    gene_abundance = annotation.select("gene_id", F.explode(F.array(*[F.lit(s) for s in SITES[::2]])).alias("site"), F.lit(1.0).alias("abundance"))
    counts = spark.createDataFrame([(e, *[i % 4] * 20, 1, i % 2, 1) for i, e in enumerate(ENTITIES)], "entity string, " + ", ".join(f"t{k} int" for k in range(20)) + ", `16s` int, `23s` int, `5s` int")
    catalogue = spark.createDataFrame([("M", "g", "K00855"), ("N", "h", "K15230")], "metabolism string, gene string, marker string")
    return A.Sheets(annotation, wide, pathway, quality, iron, catalogue, counts, gene_abundance)


def test_region_sizes_and_site_names():
    assert [len(s) for s in V.REGION_SITES.values()] == [9, 6, 12]
    assert len(set(SITES)) == 27 and set(SITES) == set(V.SITE_NAMES.values())
    assert sorted(V.CHORD_ORDER) == sorted(SITES)


def test_every_report_table(spark, sheets, tmp_path):
    tables = A.tables(sheets)
    counts = {name: table.count() for name, table in tables.items()}
    n = len(ENTITIES)
    assert counts["entities"] == counts["quality"] == n
    held = {(r.entity, r.trait): r.value for r in tables["traits"].collect()}
    kinds = len(V.DONORS) + len(V.ACCEPTORS) + len(V.FIXATION) + len(V.RUBISCO_FORMS) + 2
    assert len(held) == n * kinds
    # curated edits: oxidative list, incomplete oxidase list, masked phylum and class
    assert held["bin_145", "Sulfur Oxidation*"] == 1 and held["bin_145", "Sulfur Reduction"] == 0
    assert all(held[e, "Aerobic"] == 0 for e in ("bin_144", "bin_3", "bin_240", "bin_7", "bin_8"))
    assert held["bin_7", "Microaerobic"] == 0 and held["bin_8", "Microaerobic"] == 0
    assert held["bin_3", "CBB_FormI"] == 1 and held["bin_145", "CBB.present"] == 1
    for e in ENTITIES:
        assert not (held[e, "Microaerobic"] and held[e, "Wood.Ljungdahl.present"])
        assert held[e, "Autotrophy"] + held[e, "Heterotrophy"] == 1
        assert held[e, "Autotrophy"] == max(held[e, t] for t in V.FIXATION)
    assert all(held[e, "Iron Oxidation"] == 0 for e in ENTITIES[-2:])
    assert counts["donor_acceptor"] == n * 20
    assert tables["abundance"].where(f"abundance < {V.ABUNDANCE_CUT_OFF}").count() == 0
    assert counts["communities"] == n
    assert set(tables["site_abundance"].select("region").distinct().toPandas().region) == set(V.REGION_SITES)
    assert tables["pathway_sites"].columns[2:] == V.CHORD_ORDER
    assert sum(r.n for r in tables["presence_agreement"].collect()) % (len(SITES) - 1) == 0
    assert counts["class_labels"] >= len(V.EXTRA_CLASSES)
    named = {r.entity: r.name for r in tables["quality"].collect()}
    assert not any(name.startswith("bin_") for name in named.values())
    sheet = A.quality_sheet(tables["quality"])
    assert sheet.columns[0] == "Bin #" and sheet.columns[-1] == "# of individual tRNA"
    A.write_all({"quality": sheet}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/quality").count() == n


def test_heatmap_positions(spark, sheets):
    cells = A.abundance_table(sheets, A.entity_table(sheets))
    got = A.heatmap(cells, len(ENTITIES), SITES).toPandas()
    assert len(got) == len(ENTITIES) * 27
    assert sorted(got.site_position.unique()) == list(range(27))
    assert got.groupby("entity").entity_position.nunique().eq(1).all()


def test_ordination_report(spark, sheets):
    rng = np.random.default_rng(3)
    columns = ["site", "region", "volcano", "co2_d13", "feo", "h2s", "alt", "temp", "dic", "so4", "cl", "ag_s"]
    rows = [
        (s, None, None, None, None, None, *[None if rng.random() < 0.1 and k else float(rng.normal(5, 1)) for k in range(6)])
        for s in [*SITES, "extra"]
    ]
    covariates = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('site', 'region', 'volcano') else 'double'}" for c in columns))
    complete = O.complete_covariates(covariates, max_iter=1, trees=5)
    assert not set(V.UNIMPUTED) & set(complete.columns)
    scaled = O.scaled_covariates(complete)
    entities = A.entity_table(sheets)
    cells = A.abundance_table(sheets, entities)
    site_dim = spark.createDataFrame([(s, s[:2], "F", r) for r, ss in V.REGION_SITES.items() for s in ss], "site string, code string, type string, region string")
    report = O.report(cells, scaled, ["temp", "dic"], entities, site_dim, 27, permutations=19)
    assert report.vif.count() == 2 and report.eigenvalues.count() == 2
    assert 0 < report.summary.first().explained < 1
    assert 0.05 <= report.model_test.first().p <= 1
    assert report.margin_test.count() == 2 and report.axis_test.count() == 2 and report.selection.count() == 2
    assert report.site_scores["species"].count() == 27
    assert report.entity_scores["sites"].count() == len(ENTITIES)
    fixers = spark.createDataFrame([("bin_3", "CBB"), ("bin_3", "WL")], "entity string, pathway string")
    stacked = O.scores_by_pathway({"regional": report.entity_scores["species"]}, fixers)
    assert stacked.count() == len(ENTITIES) + 1
    assert report.correlations.count() == 1 and report.biplot.count() == 2


def test_ratio_columns(spark):
    names = sorted({c for a, b in V.RATIOS.values() for c in (*a, *b)})
    row = spark.createDataFrame([tuple(0.0 if c == "cl" else 2.0 for c in names)], ", ".join(f"{c} double" for c in names))
    got = O.ratio_covariates(row).first()
    assert got["so4_per_cl"] == 0.0 and got["ca_per_k_na"] == 0.5 and got["k_na_per_mg"] == 2.0
    assert len([c for c in O.ratio_covariates(row).columns if "_per_" in c]) == 13
