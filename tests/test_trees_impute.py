from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import functions as F

from abundia.operators import impute as I
from abundia.operators import trees as G
from abundia.plans import registry


def test_deeper_label_wins(spark):
    rows = [(1, None, "outer"), (2, 1, None), (3, 2, "inner"), (4, 3, None), (5, 4, None), (6, 2, None), (9, None, None), (10, 9, None)]
    edges = spark.createDataFrame(rows, "node long, parent long, label string")
    got = {r.node: r.clade for r in G.clade_label(edges).collect()}
    assert got == {1: "outer", 2: "outer", 3: "inner", 4: "inner", 5: "inner", 6: "outer", 9: None, 10: None}


def test_long_chain(spark):
    edges = spark.range(0, 400).select(
        F.col("id").alias("node"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"),
        F.when(F.col("id") == 7, "mark").alias("label"),
    )
    got = {r.node: r.clade for r in G.clade_label(edges).collect()}
    assert all(got[i] == ("mark" if i >= 7 else None) for i in range(400))


def test_pointers_of_a_hot_root_a_chain_and_a_missing_node(spark):
    # half of the nodes point at one root, a chain hangs below it, one node points at nothing
    up = {0: None} | {i: 0 for i in range(1, 300)} | {i: i - 1 for i in range(300, 340)} | {500: 999}
    amount = {i: i % 7 for i in up}
    state = spark.createDataFrame([(i, t, amount[i]) for i, t in up.items()], "node long, to long, value long")

    def path(i):
        return 0 if i is None or i not in up else amount[i] + path(up[i])

    assert {r.node: r.value for r in G.resolve_pointers(state, add=True).collect()} == {i: path(i) for i in up}
    got = {r.node: r.value for r in G.resolve_pointers(state).collect()}
    assert got == {i: None if i == 500 else amount[0] for i in up}


def test_tip_labels(spark):
    rows = [
        (1, None, None, 0.0), (2, 1, "bin_5faa.x_rest", 0.0), (3, 1, "bin_5faa y", 0.5), (4, 1, "Unc01 abc_d", 0.25),
    ]
    edges = spark.createDataFrame(rows, "node long, parent long, label string, length double")
    got = {r.node: (r.tip_label, r.length) for r in G.tip_labels(edges).collect()}
    assert got == {2: ("bin 5faa", 1e-16), 3: ("bin 5faa.1", 0.5), 4: ("Unc01 abc", 0.25)}


def holed(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], []
    for i in range(160):
        a = float(rng.normal())
        b = 3 * a + float(rng.normal(scale=0.1))
        c = "hi" if a > 0 else "lo"
        truth.append((i, a, b, c))
        rows.append((i, a, None if i % 7 == 0 else b, None if i % 11 == 0 else c))
    kind = "id int, a double, b double, c string"
    return spark.createDataFrame(rows, kind), spark.createDataFrame(truth, kind)


def test_baseline_fill(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, None, "a"), (3, 3.0, None), (4, 2.0, None)], "id int, x double, t string")
    got = {r.id: (r.x, r.t) for r in I.impute_baseline(df, ["x", "t"]).collect()}
    assert got == {1: (1.0, "b"), 2: (2.0, "a"), 3: (3.0, "a"), 4: (2.0, "a")}


def test_forest_beats_the_mean_and_keeps_observed_cells(spark):
    df, truth = holed(spark)
    columns = ["a", "b", "c"]
    filled = I.impute_forest(df, "id", columns, max_iter=3, trees=20, depth=6)
    assert filled.columns == df.columns
    assert filled.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
    both = df.join(filled.select("id", F.col("b").alias("b2"), F.col("c").alias("c2")), "id")
    assert both.where("b IS NOT NULL AND b <> b2").count() == 0
    assert both.where("c IS NOT NULL AND c <> c2").count() == 0
    holes = df.where("b IS NULL").select("id", F.lit("b").alias("column"))
    forest = I.masked_error(truth, filled, holes, "id", ["a", "b"]).first().rmse
    mean = I.masked_error(truth, I.impute_baseline(df, columns), holes, "id", ["a", "b"]).first().rmse
    assert forest < mean / 2
    right = filled.join(truth.select("id", F.col("c").alias("t")), "id").where("c = t").count()
    assert right >= 155


def test_forest_takes_a_text_column_of_many_values(spark):
    rows = [(i, f"key{i}", float(i % 5), None if i % 9 == 0 else float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string, a double, b double")
    filled = I.impute_forest(df, "id", ["t", "a", "b"], max_iter=1, trees=5, depth=3)
    assert filled.columns == df.columns and filled.where("b IS NULL").count() == 0


def test_forest_without_holes_is_a_no_op(spark):
    _, truth = holed(spark)
    assert I.impute_forest(truth, "id", ["a", "b", "c"]) is truth


def test_registered_forest_is_the_whole_job(spark, monkeypatch):
    whole, calls = inspect.signature(I.impute_forest), []
    monkeypatch.setattr(registry.I, "impute_forest", lambda *a, **b: calls.append(whole.bind(*a, **b)))
    registry.QUERIES["impute_forest"](spark, "/root/testdata/sf0.001")
    calls[0].apply_defaults()
    for name in ("max_iter", "trees", "depth"):
        assert calls[0].arguments[name] >= whole.parameters[name].default


def test_passes_end_when_no_kind_of_change_shrinks():
    assert not I.settled((0.5, 0.2), (0.4, 0.3)) and not I.settled((0.3, 0.3), (0.4, 0.2))
    assert I.settled((0.5, 0.3), (0.4, 0.3)) and I.settled((0.0, 0.0), (0.0, 0.0))
    assert I.settled((0.5, None), (0.4, None)) and not I.settled((None, 0.1), (None, 0.2))


def test_forest_grows_on_rows_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_TASK", 40)
    rows = [(i, None if i % 7 == 0 else float(i % 10), float(i % 10) * 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    dealt, fit = [], I._dealt
    monkeypatch.setattr(I, "_dealt", lambda *a: dealt.append(fit(*a)) or dealt[-1])
    twice = [sorted(tuple(r) for r in I.impute_forest(df, "id", ["a", "b"], max_iter=1, trees=5, depth=3).collect()) for _ in range(2)]
    assert {d.rdd.getNumPartitions() for d in dealt} == {3}
    assert twice[0] == twice[1] and [r[0] for r in twice[0]] == list(range(100))
    assert all(r[1] is not None and (r[0] % 7 == 0 or r[1] == r[0] % 10) for r in twice[0])
