from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundia.operators import ordination as Z
from abundia.operators import permute as P
from abundia.operators import transform as D
from abundia.operators.constraints import aliased

NAMES = ["u", "v", "w"]


def data(seed=0, n=12, m=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(rng.random((n, m)) < 0.4, 0, rng.integers(1, 9, (n, m))).astype(float)
    y[:, 0] += 3
    y[:, 1:8] += np.maximum(0, np.round(4 * x[:, :1]))
    return x, y


def frames(spark, x, y):
    cells = [(f"s{i:02d}", f"e{j}", float(v)) for (i, j), v in np.ndenumerate(y) if v]
    covs = [(f"s{i:02d}", *map(float, r)) for i, r in enumerate(x)]
    return (
        spark.createDataFrame(cells, "site string, entity string, abundance double"),
        spark.createDataFrame(covs, "site string, u double, v double, w double"),
    )


def reference(x, y):
    """Constrained axes by weighted regression and singular values."""
    p = y / y.sum()
    r, c = p.sum(1), p.sum(0)
    keep = c > 0
    p, c = p[:, keep], c[keep]
    bar = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    wx = np.sqrt(r)[:, None] * (x - r @ x)
    q, _ = np.linalg.qr(wx)
    u, s, vt = np.linalg.svd(q @ (q.T @ bar), full_matrices=False)
    k = x.shape[1]
    species = vt[:k].T / np.sqrt(c)[:, None]
    sites = (bar @ vt[:k].T) / s[:k] / np.sqrt(r)[:, None]
    return (bar**2).sum(), s[:k] ** 2, species, sites, np.flatnonzero(keep)


def test_axes_scores_and_inertia(spark):
    x, y = data()
    total, values, species, sites, kept = reference(x, y)
    model = Z.fit(*frames(spark, x, y), NAMES)
    assert model.inertia == pytest.approx(total)
    assert np.allclose(model.values, values)
    assert model.constrained == pytest.approx(values.sum())
    rows = Z.eigenvalues(model, spark).collect()
    assert [r.axis for r in rows] == ["CCA1", "CCA2", "CCA3"] and rows[-1].cumulative == pytest.approx(1)
    assert 0 < Z.inertia_summary(model, spark).first().explained < 1
    for scaling in ("sites", "species"):
        root = np.sqrt(values)
        got = {r.entity: r for r in Z.entity_scores(model, scaling, 3).collect()}
        place = {r.site: r for r in Z.site_scores(model, scaling, 3).collect()}
        for a in range(3):
            e = np.array([got[f"e{j}"][f"CCA{a + 1}"] for j in kept])
            s = np.array([place[f"s{i:02d}"][f"CCA{a + 1}"] for i in range(len(x))])
            want_e = species[:, a] * (root[a] if scaling == "species" else 1)
            want_s = sites[:, a] * (1 if scaling == "species" else root[a])
            sign = np.sign(e @ want_e)
            assert np.allclose(e * sign, want_e) and np.allclose(s * sign, want_s)
    biplot = Z.biplot_scores(model, spark, 3).collect()
    assert all(sum(r[f"CCA{a + 1}"] ** 2 for a in range(3)) == pytest.approx(1) for r in biplot)


def test_vif_is_weighted(spark):
    x, y = data(1)
    x[:, 2] = x[:, 0] + 0.2 * x[:, 2]
    r = y.sum(1) / y.sum()
    moved = (x - r @ x) * np.sqrt(r)[:, None]
    corr = moved.T @ moved / np.outer(*(np.linalg.norm(moved, axis=0),) * 2)
    got = {v.covariate: v.vif for v in Z.vif(*frames(spark, x, y), NAMES).collect()}
    assert np.allclose([got[n] for n in NAMES], np.diag(np.linalg.inv(corr)))
    assert got["u"] > 10 > got["v"]


def permuted(n_sites, n, seed):
    names = [f"s{i:02d}" for i in range(n_sites)]
    for perm in range(1, n + 1):
        yield sorted(range(n_sites), key=lambda i: (hashlib.md5(f"{seed}|{perm}|{names[i]}".encode()).hexdigest(), names[i]))


def explained(x, y, columns):
    if not columns:
        return 0.0
    return reference(x[:, columns], y)[1].sum()


def first_beyond(x, z, y):
    p = y / y.sum()
    r, c = p.sum(1), p.sum(0)
    bar = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    wx, wz = (np.sqrt(r)[:, None] * (m - r @ m) for m in (x, z))
    if z.shape[1]:
        q, _ = np.linalg.qr(wz)
        wx = wx - q @ (q.T @ wx)
    u, s, _ = np.linalg.svd(wx, full_matrices=False)
    q = u[:, s > 1e-9]
    return np.linalg.svd(q.T @ bar)[1][0] ** 2


@pytest.mark.parametrize("limit", [1024, 2])
def test_permutation_tests(spark, limit):
    """Both ways to the moments agree with refitting every permutation."""
    x, y = data(2)
    y = y[:, y.sum(0) > 0]
    n, n_sites = 19, len(x)
    m = P.moments(*frames(spark, x, y), NAMES, n, 5, max_kernel_sites=limit)
    total = reference(x, y)[0]
    assert m.inertia == pytest.approx(total)
    rest = n_sites - 4
    orders = [list(range(n_sites)), *permuted(n_sites, n, 5)]

    def outcome(statistic):
        f = [statistic(x[o], o) for o in orders]
        return f[0], sum(v >= f[0] - 1e-9 for v in f[1:])

    def whole(z, _):
        full = explained(z, y, [0, 1, 2])
        return full / 3 / ((total - full) / rest)

    got = P.model_test(m).first()
    f, reached = outcome(whole)
    assert got.f == pytest.approx(f) and got.reached == reached and got.p == (1 + reached) / (n + 1)
    for row in P.margin_test(m).collect():
        others = [i for i, name in enumerate(NAMES) if name != row.term]

        def term(z, _):
            full = explained(z, y, [0, 1, 2])
            return (full - explained(z, y, others)) / ((total - full) / rest)

        f, reached = outcome(term)
        assert row.f == pytest.approx(f) and row.reached == reached
    axes = x @ P._axes(m, NAMES)
    for a, row in enumerate(P.axis_test(m).collect()):

        def axis(z, o):
            full = explained(z, y, [0, 1, 2])
            return first_beyond(z, axes[o][:, :a], y) / ((total - full) / rest)

        f, reached = outcome(axis)
        assert row.term == f"CCA{a + 1}" and row.f == pytest.approx(f) and row.reached == reached
        assert 1 / (n + 1) <= row.p <= 1


@pytest.mark.parametrize("kind", ["int", "double", "timestamp"])
def test_site_keys_of_any_type_give_the_same_permutations_both_ways(spark, kind):
    x, y = data(6, n=8, m=6)
    cells, covs = frames(spark, x, y)
    key = F.lit(100000000) + F.substring("site", 2, 2).cast("int")
    key = F.timestamp_seconds(key) if kind == "timestamp" else key.cast(kind)
    cells, covs = cells.withColumn("site", key), covs.withColumn("site", key)
    rows = []
    for limit in (1024, 1):
        table = P.moments(cells, covs, NAMES, 9, 5, max_kernel_sites=limit).table
        rows.append([[*r.g, *r.s] for r in table.orderBy("perm").collect()])
    assert len(rows[0]) == 10 and np.allclose(*rows)


@pytest.mark.parametrize("direction", ["backward", "both"])
def test_stepwise_keeps_the_driver_of_the_table(spark, direction):
    x, y = data(3, n=16)
    chosen = P.stepwise(P.moments(*frames(spark, x, y), NAMES, 99, 1), direction=direction).collect()
    kept = [r.covariate for r in chosen if r.kept]
    assert "u" in kept and len(kept) < 3
    assert all((r.step > 0) == (not r.kept) for r in chosen)


def test_hellinger_sites_have_unit_length(spark):
    x, y = data(4)
    cells, covs = frames(spark, x, y)
    norms = D.hellinger(cells).groupBy("site").agg(F.sum(F.col("abundance") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    empty = spark.createDataFrame([("s", "e", 0.0)], "site string, entity string, abundance double")
    assert D.hellinger(empty).first().abundance == 0.0
    z = D.zscore(covs.withColumn("flat", F.lit(2.0)), "site", [*NAMES, "flat"])
    stats = {r.covariate: r for r in z.groupBy("covariate").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()}
    assert all(stats[n].m == pytest.approx(0, abs=1e-12) and stats[n].s == pytest.approx(1) for n in NAMES)
    assert stats["flat"].m is None
    wide = D.zscore_wide(covs.withColumn("flat", F.lit(2.0)), [*NAMES, "flat"]).toPandas()
    assert np.allclose(wide[NAMES].std(ddof=1), 1) and wide.flat.isna().all()


def test_decorated_scores(spark):
    x, y = data(5)
    cells, covs = frames(spark, x, y)
    model = Z.fit(cells, covs, NAMES)
    dim = cells.select("entity").distinct().select("entity", F.lit("P").alias("phylum"), F.lit("").alias("class"))
    named = Z.decorate_entities(Z.entity_scores(model), dim, cells, len(x)).collect()
    assert {r["class"] for r in named} == {"P, unknown class"}
    assert min(r["size"] for r in named) == 1.0 and max(r["size"] for r in named) == 20.0
    site_dim = covs.select("site", F.col("site").alias("code"), F.lit("F").alias("type"), F.lit("arc").alias("region"))
    assert {r.abbrev for r in Z.decorate_sites(Z.site_scores(model), site_dim).collect()} == {f"s{i:02d}F" for i in range(len(x))}


def test_constraints_that_follow_from_earlier_ones_are_left_out(spark):
    """A covariate, its double, a constant and a sum give the model of the two real ones and a list."""
    x, y = data(7)
    cells, covs = frames(spark, x, y)
    wide = covs.select("site", "u", (2 * F.col("u")).alias("twice"), F.lit(3.5).alias("flat"), "v", (F.col("u") - 4 * F.col("v") + 7).alias("mixed"))
    names = ["u", "twice", "flat", "v", "mixed"]
    model, plain = Z.fit(cells, wide, names), Z.fit(cells, covs, ["u", "v"])
    assert model.names == ["u", "v"] and np.allclose(model.values, plain.values) and model.constrained == pytest.approx(plain.constrained)
    listed = {(r.covariate, r.reason, r.source): r.coefficient for r in aliased(model.choice, spark).collect()}
    assert set(listed) == {
        ("twice", "aliased", "u"), ("flat", "constant", None), ("mixed", "aliased", "u"), ("mixed", "aliased", "v"),
    }
    assert listed["twice", "aliased", "u"] == pytest.approx(2) and listed["mixed", "aliased", "v"] == pytest.approx(-4)
    got = {r.covariate: r.vif for r in Z.vif(cells, wide, names).collect()}
    want = {r.covariate: r.vif for r in Z.vif(cells, covs, ["u", "v"]).collect()}
    assert got["u"] == pytest.approx(want["u"]) and got["v"] == pytest.approx(want["v"])
    assert got["twice"] is None and got["flat"] is None and got["mixed"] is None
    rows = Z.entity_scores(model).orderBy("entity").collect()
    assert np.allclose([r.CCA1 for r in rows], [r.CCA1 for r in Z.entity_scores(plain).orderBy("entity").collect()])
    many, few = P.moments(cells, wide, names, 19, 3), P.moments(cells, covs, ["u", "v"], 19, 3)
    for test in (P.model_test, P.margin_test, P.axis_test):
        a, b = test(many).collect(), test(few).collect()
        assert [(r.term, r.reached) for r in a] == [(r.term, r.reached) for r in b]
        assert np.allclose([r.f for r in a], [r.f for r in b])
    # asked for alone, the double takes part
    assert [r.term for r in P.margin_test(many, ["twice", "v"]).collect()] == ["twice", "v"]
    steps = {r.covariate: (r.kept, r.step) for r in P.stepwise(many).collect()}
    assert list(steps) == names and steps["twice"] == steps["flat"] == steps["mixed"] == (0, 0)


def test_nearly_equal_and_only_constant_constraints(spark):
    x, y = data(8)
    cells, covs = frames(spark, x, y)
    close = covs.select("site", "u", (F.col("u") + 1e-3 * F.col("v")).alias("near"), F.lit(1e9).alias("flat"))
    assert Z.fit(cells, close, ["u", "near"]).names == ["u", "near"]
    empty = Z.fit(cells, close, ["flat"])
    assert empty.names == [] and empty.constrained == 0.0
    assert Z.eigenvalues(empty, spark).count() == 0 and Z.inertia_summary(empty, spark).first().explained == 0.0
    assert P.model_test(P.moments(cells, close, ["flat"], 9, 1)).count() == 0
    assert [r.vif for r in Z.vif(cells, close, ["flat"]).collect()] == [None]


def test_a_constant_covariate_takes_no_part_after_scaling(spark):
    x, y = data()
    cells, covariates = frames(spark, x, y)
    scaled = D.zscore_wide(covariates.withColumn("w", F.lit(1.0)), NAMES)
    model, plain = Z.fit(cells, scaled, NAMES), Z.fit(cells, covariates, ["u", "v"])
    assert model.names == ["u", "v"] and model.choice.dropped == {"w": {}}
    assert model.inertia == pytest.approx(plain.inertia) and model.constrained == pytest.approx(plain.constrained)
    for most in (1024, 1):
        both = [P.moments(cells, t, n, 19, 7, most) for t, n in ((scaled, NAMES), (covariates, ["u", "v"]))]
        mine, theirs = ([(r.term, round(r.f, 9), r.reached) for r in P.model_test(m).unionByName(P.margin_test(m)).collect()] for m in both)
        assert mine == theirs
