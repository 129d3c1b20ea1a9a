"""Permutation tests of a canonical correspondence analysis.

A permutation gives each site the covariates of another one and centres them
again with the weights of the sites they land on. Every statistic then follows
from two small matrices per permutation (see ``ordination``):

    G = sum_i r_i x_i x_i'        S = sum_j h_j h_j' = sum_ik K_ik x_i x_k'

so the permutations are rows of one written table, and the tests of the model,
of its terms, of its axes and the stepwise choice all read that table. With
few sites K (sites x sites) is summed once over the entities; with many sites
each permutation meets the non-zero cells directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundia.operators.constraints import Choice, choose
from abundia.operators.gram import as_matrix, gram, index_of, sparse_rows
from abundia.operators.ordering import running_total
from abundia.sources.scratch import bounded_values, saved

MAX_KERNEL_SITES = 1024
TIE = 1e-9


@dataclass
class Moments:
    """G and S of the observed table (permutation 0) and of every permutation."""

    spark: SparkSession
    names: list[str]
    n: int
    n_sites: int
    inertia: float
    gram: np.ndarray
    moment: np.ndarray
    table: DataFrame  # perm, g array<double>, s array<double>
    constant: list[str]

    def choice(self, names: Sequence[str] | None = None) -> Choice:
        """Which of some covariates take part when they are tested together."""
        names = list(names or self.names)
        places = self.places(names)
        return choose(names, self.gram[np.ix_(places, places)], self.constant)

    def usable(self, names: Sequence[str] | None = None) -> list[str]:
        return self.choice(names).kept_names

    def places(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(name) for name in names]


def _shuffled(site: F.Column, perm: F.Column, seed: int) -> F.Column:
    """Sort key of a site in a permutation: md5 of "seed|perm|site", the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), perm.cast("string"), site.cast("string")))


def _kernel_moments(cells: DataFrame, covariates: DataFrame, names: list[str], sites: list, total: float, n: int, seed: int) -> DataFrame:
    """(perm, g, s) by way of the sites x sites matrix."""
    spark, k, q = cells.sparkSession, len(sites), len(names)
    sums = cells.groupBy("entity").agg(F.sum("abundance").alias("_sum"))
    scaled = cells.join(sums, "entity").withColumn("_x", F.col("abundance") / F.sqrt(F.col("_sum") * F.lit(total)))
    kernel = as_matrix(gram(sparse_rows(index_of(scaled, "site", sites), "entity", "_x"), k), k)
    by_site = dict(cells.groupBy("site").agg(F.sum("abundance")).collect())
    rows = {r[0]: r[1:] for r in covariates.select("site", F.col("site").cast("string"), *names).collect()}
    weights = np.array([by_site[s] / total for s in sites])
    x = np.array([[float(v) for v in rows[s][1:]] for s in sites])

    # the key text is Spark's own cast, as in the direct path, so both give the same permutations
    listed = F.array(*[F.struct(F.lit(rows[s][0]).alias("site"), F.lit(i).alias("place")) for i, s in enumerate(sites)])
    keyed = F.transform(listed, lambda s: F.struct(_shuffled(s["site"], F.col("perm"), seed).alias("key"), s["place"].alias("place")))
    order = F.transform(F.array_sort(keyed), lambda s: s["place"])
    own = F.array(*[F.lit(i) for i in range(k)])
    perms = spark.range(0, n + 1).select(F.col("id").alias("perm"))
    perms = perms.select("perm", F.when(F.col("perm") == 0, own).otherwise(order).alias("order"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            placed = x[orders]
            placed = placed - np.einsum("i,bik->bk", weights, placed)[:, None, :]
            g = np.einsum("bik,i,bil->bkl", placed, weights, placed)
            s = np.einsum("bik,bil->bkl", placed, kernel @ placed)
            ends = pa.array(np.arange(0, (len(batch) + 1) * q * q, q * q, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(m.ravel())) for m in (g, s)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["perm", "g", "s"])

    return perms.mapInArrow(task, "perm bigint, g array<double>, s array<double>")


def _direct_moments(cells: DataFrame, covariates: DataFrame, names: list[str], total: float, n: int, seed: int) -> DataFrame:
    """(perm, g, s) for any number of sites: permuted covariates meet the cells by site."""
    q = len(names)
    weights = cells.groupBy("site").agg((F.sum("abundance") / total).alias("r"))
    weighted = saved(weights.join(covariates.select("site", *names), "site"))
    own = running_total(weighted, [], [F.col("site")], out="_at")
    spread = weighted.select("*", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("perm"))
    first = F.when(F.col("perm") != 0, _shuffled(F.col("site"), F.col("perm"), seed)).otherwise(F.lit(""))
    moved = running_total(spread.withColumn("_key", first), ["perm"], [F.col("_key"), F.col("site")], out="_at")
    placed = moved.select("perm", "_at", *names).join(own.select("_at", "site", "r"), "_at")
    means = placed.groupBy("perm").agg(*[F.sum(F.col("r") * F.col(c)).alias(f"_m{i}") for i, c in enumerate(names)])
    placed = saved(
        placed.join(means, "perm").select("perm", "site", "r", *[(F.col(c) - F.col(f"_m{i}")).alias(f"x{i}") for i, c in enumerate(names)])
    )

    def products(prefix: str, weight: F.Column, out: str) -> F.Column:
        terms = [F.sum(weight * F.col(f"{prefix}{i}") * F.col(f"{prefix}{j}")) for i in range(q) for j in range(q)]
        return F.array(*terms).alias(out)

    g = placed.groupBy("perm").agg(products("x", F.col("r"), "g"))
    shares = cells.select("site", "entity", (F.col("abundance") / total).alias("p"))
    by_entity = shares.join(placed, "site").groupBy("perm", "entity").agg(
        F.sum("p").alias("c"), *[F.sum(F.col("p") * F.col(f"x{i}")).alias(f"h{i}") for i in range(q)]
    )
    s = by_entity.groupBy("perm").agg(products("h", 1 / F.col("c"), "s"))
    return g.join(s, "perm")


def moments(
    cells: DataFrame,
    covariates: DataFrame,
    names: Sequence[str],
    n: int = 999,
    seed: int = 1,
    max_kernel_sites: int = MAX_KERNEL_SITES,
) -> Moments:
    """Summarise the observed table and ``n`` permutations of its covariates.

    A covariate without any value, such as the z-score of a constant one, counts as constant.
    """
    names = list(names)
    cells = saved(cells.where("abundance <> 0").join(covariates.select("site"), "site", "left_semi").select("site", "entity", "abundance"))
    covariates = saved(covariates.select("site", *names).join(cells.select("site").distinct(), "site", "left_semi"))
    total = cells.agg(F.sum("abundance")).first()[0]
    flat = [((F.count(n) == 0) | (F.min(n) == F.max(n))).alias(f"f{i}") for i, n in enumerate(names)]
    row = covariates.agg(F.count("*").alias("n_sites"), *[F.count(n).alias(f"c{i}") for i, n in enumerate(names)], *flat).first()
    n_sites, constant = row["n_sites"], [n for i, n in enumerate(names) if row[f"f{i}"]]
    covariates = covariates.withColumns({n: F.lit(0.0) for i, n in enumerate(names) if not row[f"c{i}"]})
    if n_sites <= max_kernel_sites:
        sites = bounded_values(covariates, "site", max_kernel_sites)
        table = _kernel_moments(cells, covariates, names, sites, total, n, seed)
    else:
        table = _direct_moments(cells, covariates, names, total, n, seed)
    table = saved(table)
    first = table.where("perm = 0").first()
    by_site = cells.groupBy("site").agg(F.sum("abundance").alias("_r"))
    own = cells.join(by_site, "site").groupBy("entity").agg(
        F.sum("abundance").alias("_c"), F.sum(F.col("abundance") * F.col("abundance") / F.col("_r")).alias("_own")
    )
    inertia = own.agg(F.sum(F.col("_own") / F.col("_c"))).first()[0] - 1
    q = len(names)
    return Moments(
        cells.sparkSession, names, n, n_sites, float(inertia),
        np.array(first["g"]).reshape(q, q), np.array(first["s"]).reshape(q, q), table, constant,
    )


def _explained(g: np.ndarray, s: np.ndarray, keep: Sequence[int]) -> np.ndarray:
    """Inertia explained by some of the covariates, for a stack of (G, S)."""
    if not keep:
        return np.zeros(len(g))
    inner = np.ix_(range(len(g)), keep, keep)
    return np.trace(np.linalg.pinv(g[inner], hermitian=True) @ s[inner], axis1=1, axis2=2)


def _first_beyond(g: np.ndarray, s: np.ndarray, keep: Sequence[int], earlier: np.ndarray) -> np.ndarray:
    """Largest eigenvalue of the part explained beyond some combinations of the covariates.

    ``earlier`` holds their coefficients. What is left of the covariate space
    is the G-orthogonal complement of those combinations.
    """
    inner = np.ix_(range(len(g)), keep, keep)
    g, s = g[inner], s[inner]
    values, vectors = np.linalg.eigh(g)
    usable = values > 1e-12 * values.max(axis=1, keepdims=True)
    root = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1.0)), 0.0)
    half = vectors * root[:, None, :]
    inside = np.swapaxes(half, 1, 2) @ s @ half
    if earlier.shape[1]:
        # in these coordinates a combination w is half^-1 w
        basis, _ = np.linalg.qr(np.swapaxes(half, 1, 2) @ (g @ earlier))
        off = np.eye(g.shape[1]) - basis @ np.swapaxes(basis, 1, 2)
        inside = off @ inside @ off
    return np.linalg.eigvalsh(inside)[:, -1]


Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _test(moments_: Moments, statistic: Statistic) -> tuple[float, int, float]:
    """Observed statistic, permutations that reach it, and p."""
    q = len(moments_.names)
    observed = float(statistic(moments_.gram[None], moments_.moment[None])[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, s = (batch.column(i).flatten().to_numpy().reshape(-1, q, q) for i in (0, 1))
            reached = int((statistic(g, s) >= observed - TIE).sum()) if len(g) else 0
            yield pa.RecordBatch.from_arrays([pa.array([reached], pa.int64())], ["reached"])

    counts = moments_.table.where("perm > 0").select("g", "s").mapInArrow(score, "reached bigint")
    reached = int(counts.agg(F.coalesce(F.sum("reached"), F.lit(0))).first()[0])
    return observed, reached, (1 + reached) / (moments_.n + 1)


def _f_of_model(m: Moments, names: Sequence[str]) -> Statistic:
    keep, rest, inertia = m.places(names), m.n_sites - len(names) - 1, m.inertia

    def statistic(g: np.ndarray, s: np.ndarray) -> np.ndarray:
        fitted = _explained(g, s, keep)
        return (fitted / len(keep)) / ((inertia - fitted) / rest)

    return statistic


def _f_of_term(m: Moments, names: Sequence[str], term: str) -> Statistic:
    keep, rest, inertia = m.places(names), m.n_sites - len(names) - 1, m.inertia
    without = m.places([n for n in names if n != term])

    def statistic(g: np.ndarray, s: np.ndarray) -> np.ndarray:
        full = _explained(g, s, keep)
        return (full - _explained(g, s, without)) / ((inertia - full) / rest)

    return statistic


def _f_of_axis(m: Moments, names: Sequence[str], earlier: np.ndarray) -> Statistic:
    keep, rest, inertia = m.places(names), m.n_sites - len(names) - 1, m.inertia

    def statistic(g: np.ndarray, s: np.ndarray) -> np.ndarray:
        return _first_beyond(g, s, keep, earlier) / ((inertia - _explained(g, s, keep)) / rest)

    return statistic


def _axes(m: Moments, names: Sequence[str]) -> np.ndarray:
    """Coefficients of the observed constrained axes, largest eigenvalue first."""
    inner = np.ix_(m.places(names), m.places(names))
    half = np.linalg.inv(np.linalg.cholesky(m.gram[inner]))
    values, vectors = np.linalg.eigh(half @ m.moment[inner] @ half.T)
    return half.T @ vectors[:, np.argsort(values)[::-1]]


def _table(m: Moments, rows: list[tuple]) -> DataFrame:
    return m.spark.createDataFrame(rows, "term string, f double, reached bigint, p double")


def model_test(m: Moments, names: Sequence[str] | None = None) -> DataFrame:
    """F of the whole model and the share of permutations that reach it."""
    names = m.usable(names)
    return _table(m, [("model", *_test(m, _f_of_model(m, names)))] if names else [])


def margin_test(m: Moments, names: Sequence[str] | None = None) -> DataFrame:
    """The same for what each covariate adds to all the others."""
    names = m.usable(names)
    return _table(m, [(term, *_test(m, _f_of_term(m, names, term))) for term in names])


def axis_test(m: Moments, names: Sequence[str] | None = None) -> DataFrame:
    """The same for each constrained axis, the earlier axes partialled out."""
    names = m.usable(names)
    axes = _axes(m, names)
    rows = [(f"CCA{a + 1}", *_test(m, _f_of_axis(m, names, axes[:, :a]))) for a in range(axes.shape[1])]
    return _table(m, rows)


def stepwise(m: Moments, p_out: float = 0.1, p_in: float = 0.05, max_steps: int = 50, direction: str = "backward") -> DataFrame:
    """Drop covariates by permutation p until nothing moves: (covariate, kept, step).

    Each step drops the worst covariate whose p is above ``p_out``. With
    ``direction="both"`` a step that drops nothing adds the best left-out one
    whose p is at most ``p_in``. Covariates that take no part from the start
    have step 0.
    """
    if direction not in ("backward", "both"):
        raise ValueError(f"unknown direction {direction}")
    names = m.usable()
    kept, moved, seen = list(names), {}, {tuple(names)}
    for step in range(1, max_steps + 1):
        drops = []
        for term in kept if len(kept) > 1 else []:
            f, _, p = _test(m, _f_of_term(m, kept, term))
            drops.append((p, -f, term))
        worst = max(drops, default=None)
        if worst and worst[0] > p_out:
            kept = [k for k in kept if k != worst[2]]
            moved[worst[2]] = step
        else:
            adds = []
            for term in [t for t in names if t not in kept] if direction == "both" else []:
                f, _, p = _test(m, _f_of_term(m, [t for t in names if t in kept or t == term], term))
                adds.append((p, -f, term))
            best = min(adds, default=None)
            if not best or best[0] > p_in:
                break
            kept = [t for t in names if t in kept or t == best[2]]
            moved[best[2]] = step
        if tuple(kept) in seen:
            break
        seen.add(tuple(kept))
    rows = [(name, int(name in kept), moved.get(name, 0)) for name in m.names]
    return m.spark.createDataFrame(rows, "covariate string, kept int, step int")
