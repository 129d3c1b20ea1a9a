"""Names, lists, thresholds and curated edits that results depend on."""

from __future__ import annotations

from abundia.operators.markers import MarkerRule, ScoreRule

# ---- Fixed values: sites -----------------------------------------------------------------

SITE_NAMES = {
    "MTF_": "MTF", "BRF1_": "BRF1", "RS_S9_": "RSF", "SIS_": "SIS", "QH2_S7_": "QHF2",
    "CY_S3_": "CYF", "SL_S11_": "SLF", "BRS2_": "BRS2", "CYS_S13_": "CYS", "RVF_": "RVF",
    "RSS_": "RSS", "TC_S12_": "TCF", "QN_S8_": "QNF", "EPS_S14_": "EPS", "EP_S4_": "EPF",
    "SLS_": "SLS", "QNS_": "QNS", "BRF2_": "BRF2", "TCS_": "TCS", "FAS_S15_": "FAS",
    "BQS_": "BQS", "ETS_": "ETS", "QHS2_": "QHS2", "SI_S10_": "SIF", "BQF_": "BQF",
    "BRS1_": "BRS1", "ESF9_": "ESF9",
}

UNUSED_SITES = [
    "BQ_S1_", "BR1_S2_", "PGS_", "PBS_", "ARS_", "ALL_READS",
    "PG_S6_", "PFS_", "PF_S5_", "PLS_", "QHS1_S13_",
]

UNUSED_GENE_SITES = ["BQ", "BR1", "PGS", "PBS", "ARS", "PG", "PFS", "PF", "PLS", "BRS1"]

REGION_SITES = {
    "outer_forearc": ["QHF2", "QHS2", "EPS", "EPF", "ESF9", "RSS", "RSF", "SIS", "SIF"],
    "forearc": ["CYF", "CYS", "FAS", "SLF", "MTF", "SLS"],
    "arc": ["BQS", "BQF", "BRF1", "BRS2", "BRF2", "BRS1", "ETS", "QNF", "QNS", "RVF", "TCF", "TCS"],
}

CHORD_ORDER = [*REGION_SITES["arc"], "CYF", "CYS", "FAS", "SLF", "MTF", "SLS", *REGION_SITES["outer_forearc"]]

# ---- Fixed values: cut-offs and cluster names --------------------------------------------

ABUNDANCE_CUT_OFF = 0.03
CUT_HEIGHT = 10.0
CLUSTER_COMMUNITY = [
    (1, "forearc_arc", "regional"),
    (2, "prevalent", "prevalent"),
    (3, "prevalent", "prevalent"),
    (4, "prevalent", "prevalent"),
    (5, "outer_forearc", "regional"),
]

# ---- Fixed values: pathway columns, marker ids and rules ---------------------------------

SCORE_NAMES = {"CBB.Cycle": "cbb", "rTCA.Cycle": "rtca", "TCA.Cycle": "tca", "Wood.Ljungdahl": "wl"}

CBB_RULE = MarkerRule("CBB.present", [["K00855"]])
WL_RULE = MarkerRule("Wood.Ljungdahl.present", [["K00192", "K14138"], ["K03520", "K00198"]])

MARKER_RULES = [
    MarkerRule("Hydrogen Oxidation", [["K06282"], ["K06281"]]),
    MarkerRule("Hydrogen Oxidation", [["K00436"], ["K18007"]]),
    MarkerRule("Hydrogen Oxidation", [["K18332"]]),
    MarkerRule("Microaerobic", [["K00404"]]),
    MarkerRule("Microaerobic", [["K00425"], ["K00426"]]),
    MarkerRule("Aerobic", [["K02274"]]),
    MarkerRule("Aerobic", [["K02298"]]),
]

SCORE_RULES = [
    ScoreRule("Hydrogen Oxidation", "NiFe.hydrogenase", ">", 0),
    ScoreRule("Hydrogen Oxidation", "hydrogen.quinone.oxidoreductase", ">", 0),
    ScoreRule("Nitrogen Oxidation", "ammonia.oxidation..amo.pmmo.", ">", 0.33),
    ScoreRule("Nitrogen Reduction*", "nitric.oxide.reduction", ">", 0.33),
    ScoreRule("Nitrogen Reduction*", "nitrous.oxide.reduction", ">", 0.33),
    ScoreRule("Nitrogen Reduction*", "nitrite.reduction", ">", 0.33),
    ScoreRule("Nitrogen Reduction*", "dissim.nitrate.reduction", ">", 0.33),
    ScoreRule("Sulfur Oxidation*", "thiosulfate.oxidation", ">=", 0.32),
    ScoreRule("Sulfur Oxidation*", "alt.thiosulfate.oxidation.tsdA", ">=", 0.32),
    ScoreRule("Sulfur Oxidation*", "alt.thiosulfate.oxidation.doxAD", ">=", 0.32),
    ScoreRule("Sulfur Oxidation*", "sulfide.oxidation", ">", 0),
    ScoreRule("Sulfur Reduction", "dissimilatory.sulfite.....sulfide", ">", 0),
]

IRON_TRAITS = {"iron_oxidation": "Iron Oxidation", "iron_reduction": "Iron Reduction"}

KEY_GENES = {
    "K00192": "Wood-Ljungdahl",
    "K14138": "Wood-Ljungdahl",
    "K00855": "CBB",
    "K15230": "rTCA Cycle",
}

DONORS = ["Iron Oxidation", "Nitrogen Oxidation", "Hydrogen Oxidation", "Sulfur Oxidation*"]
ACCEPTORS = ["Sulfur Reduction", "Nitrogen Reduction*", "Iron Reduction", "Microaerobic", "Aerobic"]
FIXATION = ["CBB.present", "rTCA.present", "Wood.Ljungdahl.present"]
METABOLISMS = [
    "Hydrogen Oxidation", "Sulfur Oxidation*", "Iron Oxidation", "Nitrogen Oxidation",
    "Sulfur Reduction", "Nitrogen Reduction*", "Iron Reduction", "Microaerobic", "Aerobic",
    "CBB.present", "rTCA.present", "Wood.Ljungdahl.present",
]

# ---- Fixed values: curated edits ---------------------------------------------------------

OXIDATIVE_DSR = [
    "bin_145", "bin_264", "bin_110", "bin_12", "bin_255", "bin_265", "bin_280", "bin_5", "bin_136", "bin_14",
    "bin_169", "bin_38", "bin_16", "bin_322", "bin_143", "bin_198", "bin_301", "bin_87", "bin_153", "bin_254",
]

INCOMPLETE_AA3 = [
    "bin_144", "bin_149", "bin_157", "bin_178", "bin_190", "bin_49", "bin_75", "bin_84", "bin_328", "bin_365",
    "bin_373", "bin_113", "bin_118", "bin_120", "bin_124", "bin_168", "bin_175", "bin_176", "bin_3", "bin_40",
    "bin_47", "bin_56", "bin_224", "bin_252", "bin_257", "bin_369", "bin_404", "bin_106", "bin_109", "bin_364",
    "bin_240", "bin_402",
]

TAXON_RULES = [
    ("class", "Anaerolineae", "Aerobic", 0),
    ("phylum", "Bipolaricaulota", "Aerobic", 0),
    ("phylum", "FirmicutesH", "Aerobic", 0),
    ("order", "Thermodesulfovibrionales", "Aerobic", 0),
    ("phylum", "Desulfobacterota", "Aerobic", 0),
    ("class", "Anaerolineae", "Microaerobic", 0),
    ("phylum", "Desulfobacterota", "Microaerobic", 0),
    ("phylum", "Bipolaricaulota", "Microaerobic", 0),
]

RUBISCO_FORMS = {
    "CBB_FormI": [
        "bin_3", "bin_252", "bin_224", "bin_71", "bin_145", "bin_132", "bin_265", "bin_322", "bin_280",
        "bin_194", "bin_381", "bin_365", "bin_207", "bin_379", "bin_387", "bin_20", "bin_130",
        "bin_16", "bin_12", "bin_169", "bin_264", "bin_75", "bin_198", "bin_143", "bin_301",
    ],
    "CBB_FormII": ["bin_261", "bin_5", "bin_100", "bin_136", "bin_14", "bin_161", "bin_308", "bin_87", "bin_110"],
    "CBB_FormI_and_II": ["bin_153", "bin_254", "bin_49"],
    "CBB_Form_Unknown": ["bin_386", "bin_263", "bin_251", "bin_55"],
}

EXTRA_CLASSES = [
    "WOR~3, WOR~3", "Micrarchaeota, Micrarchaeia", "Crenarchaeota, Bathyarchaeia", "Micrarchaeota, Iainarchaeia",
    "Nanoarchaeota, Woesearchaeia", "Nanoarchaeota, Aenigmarchaeia", "unknown phylum, unknown class",
    "Patescibacteria, Microgenomatia",
]

# ---- Fixed values: genome quality and culture levels -------------------------------------

MIN_TRNA = 18
RRNA = ["23s", "16s", "5s"]
QUALITY_HEADINGS = {
    "entity": "Bin #",
    "name": "Taxa ID",
    "size": "size",
    "completeness": "Completeness (%)",
    "contamination": "Contamination (%)",
    "23s": "23S rRNA",
    "16s": "16S rRNA",
    "5s": "5S rRNA",
    "trna_total": "# of individual tRNA",
}
CULTURE_LEVELS = ["Domain", "Phylum", "Class", "Order", "Family", "Genus", "Species"]

# ---- Fixed values: covariates ------------------------------------------------------------

UNIMPUTED = ["region", "volcano", "co2_d13", "feo", "h2s"]
FIRST_SCALED, LAST_SCALED = "alt", "ag_s"
MODEL = ["temp", "ph", "dic", "doc", "fe_ac", "ni_ac", "po4", "al_s", "cr_s", "ni_s"]
REDUCED_MODEL = ["temp", "ph", "dic", "doc", "fe_ac", "ni_ac", "po4", "al_s", "ni_s"]
REGIONAL_MODEL = ["temp", "dic", "fe_ac", "ni_ac", "po4", "al_s"]
PREVALENT_MODEL = ["dic", "ni_ac"]
MAX_VIF = 10.0
IMPUTATION = {"max_iter": 10, "trees": 5000, "seed": 82}
PERMUTATIONS = 9999

RATIOS = {
    "so4.cl": (["so4"], ["cl"]),
    "cl.dic": (["cl"], ["dic"]),
    "so4.dic": (["so4"], ["dic"]),
    "ni_ac.fe_ac": (["ni_ac"], ["fe_ac"]),
    "ni_s.fe_s": (["ni_s"], ["fe_s"]),
    "co2.ch4": (["co2"], ["ch4"]),
    "co_ac.fe_ac": (["co_ac"], ["fe_ac"]),
    "ch4.h2": (["ch4"], ["h2"]),
    "ca.mg": (["ca"], ["mg"]),
    "ca.k_na": (["ca"], ["k", "na"]),
    "k_na.mg": (["k", "na"], ["mg"]),
    "fe_ac.al_ac": (["fe_ac"], ["al_ac"]),
    "fe_s.al_s": (["fe_s"], ["al_s"]),
}

RATIO_MODEL = [
    "so4.dic", "ni_ac.fe_ac", "ni_s.fe_s", "co2.ch4", "ch4.h2", "ca.k_na", "k_na.mg", "fe_ac.al_ac", "fe_s.al_s",
]
FINAL_RATIO_MODEL = ["so4.dic", "ni_s.fe_s", "ca.k_na", "fe_s.al_s"]
