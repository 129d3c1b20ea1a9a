from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from abundia.functions import numeric as N
from abundia.functions import text as X
from abundia.operators import rollup
from abundia.operators.rollup import rescale_minmax
from abundia.sources import csv as S
from abundia.sources import schema, scratch


def one(spark, schema_, row, *columns):
    return spark.createDataFrame([row], schema_).select(*columns).first()


def test_taxon_name_squeezes_blank_ranks(spark):
    got = one(spark, "a string, b string, c string, d string", ("bin_1", "Bacteria", "", "Clost"), X.taxon_name(["a", "b", "c", "d"]))
    assert got[0] == "bin_1, Bacteria, , Clost"
    got = one(spark, "a string, b string, c string, d string", ("bin_1", "Bacteria", "", ""), X.taxon_name(["a", "b", "c", "d"]))
    assert got[0] == "bin_1, Bacteria"


def test_joined_keeps_empty_and_names_missing(spark):
    assert one(spark, "a string, b string, c string", ("x", "", None), X.joined(["a", "b", "c"], "-"))[0] == "x--NA"


def test_class_label_and_strip_first(spark):
    row = one(spark, "phylum string, class string, name string", ("P", None, "bin_9, P, C"), X.class_label(), X.strip_first_item("name"))
    assert tuple(row) == ("P, unknown class", "P, C")


def test_keys_and_tokens(spark):
    row = one(
        spark, "a string, b string", ("PRE_fix..BQF_BQ17_2", "bin_2.x faa"),
        X.site_key("a"), X.site_key("b"), X.short_label("b"), X.split_part("b", " ", 1), X.split_part("b", " ", 5),
    )
    assert tuple(row) == ("BQF", "bin_2.x faa", "bin 2", "faa", None)
    assert one(spark, "a string", ("solo",), X.short_label("a"))[0] == "solo NA"


def test_ratio_rules(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    got = [r[0] for r in rows.select(N.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, None, 0.25, None]


def test_infinite_and_binary(spark):
    row = one(
        spark, "a double, b double, c double", (math.inf, -2.0, 0.0),
        N.finite_or_zero(F.col("a")), N.binary(F.col("b")), N.positive(F.col("b")), N.cut_off(F.col("c"), 0.03),
    )
    assert tuple(row) == (0.0, 1, 0, 0.0)


def test_percent_text(spark):
    assert one(spark, "a double", (0.606,), X.percent_text(F.col("a")))[0] == "61%"


def test_rescale_constant_is_midpoint(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    got = {(r.g, r.v): r.rescaled for r in rescale_minmax(rows, "v", ["g"], (1.0, 20.0)).collect()}
    assert got == {("a", 2.0): 1.0, ("a", 4.0): 20.0, ("b", 5.0): 10.5}


def test_csv_reads_bom_missing_and_quoted_comma(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿Metabolism,gene,ko\n"Cyt_c,_cbb3",ccoP,K00406\nNA,x,K1\n', encoding="utf-8")
    rows = S.read_csv(spark, str(path), schema.MARKER).collect()
    assert [tuple(r) for r in rows] == [("Cyt_c,_cbb3", "ccoP", "K00406"), (None, "x", "K1")]
    renamed = S.read_csv(spark, str(path), rename={"ko": "marker"})
    assert renamed.columns == ["Metabolism", "gene", "marker"]


def test_union_of_files_fills_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("entity,gene_id,marker\ne1,g1,K1\n")
    (tmp_path / "b.csv").write_text("marker,entity\nK2,e2\n")
    rows = S.read_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, rows.select("entity", "gene_id", "marker").collect())) == [("e1", "g1", "K1"), ("e2", None, "K2")]


def test_numeric_parse_and_sink(spark, tmp_path):
    rows = S.numeric(spark.createDataFrame([("1.5",), ("x",), (None,)], "v string"), ["v"])
    assert [r.v for r in rows.collect()] == [1.5, None, None]
    for kind in ("csv", "parquet"):
        S.write_table(rows, str(tmp_path / kind), kind)
    back = S.numeric(S.read_csv(spark, str(tmp_path / "csv")), ["v"])
    assert sorted(str(r.v) for r in back.collect()) == ["1.5", "None", "None"]
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3


def test_wide_abundance_must_be_complete(spark):
    wide = spark.createDataFrame([("e1", 1.0, 2.0)], "id string, s1 double, s2 double")
    assert S.abundance_from_wide(wide, "id", ["s1", "s2"]).count() == 2
    hole = spark.createDataFrame([("e1", 1.0, None)], "id string, s1 double, s2 double")
    with pytest.raises(Exception, match="must not be NULL"):
        S.abundance_from_wide(hole, "id", ["s1", "s2"]).collect()


@pytest.mark.parametrize("cells", [[3.0, 0.0, 0.0, 5.0, 1.0], [1e9 + 1, 1e9 - 1, 1e9 + 0.5, 1e9, 1e9 + 2], [7.0, 7.0, 7.0, 7.0, 7.0]])
def test_standard_error_matches_pandas(spark, cells):
    """Also of large cells that differ little, whose sums of squares have no digits left."""
    rows = spark.createDataFrame([("e", c) for c in cells if c], "entity string, abundance double")
    assert rollup.entity_stats(rows, 5).first().standard_error == pytest.approx(pd.Series(cells).sem(), rel=1e-6)
    assert rollup.entity_stats(rows.limit(0), 5).count() == 0
    assert rollup.entity_stats(rows, 1).first().standard_error is None


class FakeSession:
    """Just the settings a session is asked for."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})()


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch.scratch_root(FakeSession("spark://host:7077", "hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(FakeSession("yarn"))
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_bounded_lists_and_lookups_refuse_to_grow(spark):
    assert scratch.bounded_values(spark.range(3), "id", 3) == [0, 1, 2]
    with pytest.raises(ValueError):
        scratch.bounded_values(spark.range(4), "id", 3)
    with pytest.raises(ValueError):
        scratch.small_table(spark, [(i,) for i in range(scratch.MAX_SMALL_ROWS + 1)], "i int")
