"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree, by default domain, language, source. The token
budget flows from the root: at each node it is divided among the children by
weight, a child that holds less than its share gives the rest back to its
siblings, and only what all siblings together cannot hold goes back to the
parent's siblings. A child can hold its tokens times ``epochs``.

A leaf's budget is spent on whole epochs first; of the next epoch it takes the
shortest prefix, in that epoch's seeded order, that reaches the rest. A prefix
ends at one document, so the whole selection is a table with one row a leaf: full
epochs and the sort key of the last document. Applying it is a map over the
documents. The border is found by sums over ``SLICES`` ranges of the order, then
inside one range only, so no leaf is ever sorted as a whole.

Defined cases: null text has no tokens; a null level value is a value of its own;
a document of no tokens is taken when its place in the order is; rows with the same
doc_id and text have the same place and are all taken or all left; an empty table
gives an empty result; extra columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundia.llm.common import WORD, id_or_least, saved

LEVELS = ("domain", "lang", "source")
MAX_LEAVES = 100_000
SLICE_BITS = 12
SLICES = 1 << SLICE_BITS

#: Weights of the query, by path; a path that is not named weighs 1.
WEIGHTS = {("d0",): 5.0, ("d1",): 3.0, ("d2",): 2.0, **{(f"d{i}", "en"): 4.0 for i in range(3)}}


def domain_of(source: Column) -> Column:
    """Domain of a source: its trailing number modulo 3; other names are domain d0."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.concat(F.lit("d"), (number % 3).cast("string"))


def fill(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """Divide ``amount`` by weight with no child above its room."""
    given, open_ = [0.0] * len(room), [i for i, w in enumerate(weights) if w > 0]
    while open_ and amount > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] <= amount * weights[i] / total]
        if not full:
            for i in open_:
                given[i] = amount * weights[i] / total
            break
        for i in full:
            given[i] = room[i]
        amount -= sum(room[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(tokens: dict[tuple, int], budget: float, weights: dict[tuple, float], epochs: int) -> dict[tuple, int]:
    """Whole tokens of each leaf path."""

    def room(paths: list[tuple], depth: int) -> float:
        """What a subtree can hold; a child of weight 0 holds nothing."""
        if depth == len(paths[0]):
            return float(tokens[paths[0]] * epochs)
        return sum(room(own, depth + 1) for path, own in children(paths, depth) if weights.get(path, 1.0) > 0)

    def children(paths: list[tuple], depth: int):
        groups = defaultdict(list)
        for path in paths:
            groups[path[: depth + 1]].append(path)
        return sorted(groups.items(), key=lambda g: [(x is not None, x or "") for x in g[0]])

    def spend(paths: list[tuple], depth: int, amount: float) -> None:
        if depth == len(paths[0]):
            out[paths[0]] = int(amount + 1e-6)
            return
        groups = children(paths, depth)
        given = fill(amount, [weights.get(p, 1.0) for p, _ in groups], [room(own, depth + 1) for _, own in groups])
        for (_, own), part in zip(groups, given, strict=True):
            spend(own, depth + 1, part)

    out: dict[tuple, int] = {}
    if tokens:
        spend(sorted(tokens, key=lambda p: [(x is not None, x or "") for x in p]), 0, budget)
    return out


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _place(seed: int, epoch: Column) -> Column:
    """Place of a document in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch, "id", "text_key")


def _slice(place: Column) -> Column:
    return F.shiftright(place, 64 - SLICE_BITS) + SLICES // 2


def slim(docs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Identity, leaf and token count of every row."""
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    named = [value.cast("string").alias(f"l{i}") for i, value in enumerate(levels.values())]
    return docs.select(id_or_least().alias("id"), _text_key().alias("text_key"), *named, count.alias("tokens"))


def plan(rows: DataFrame, depth: int, share: float, weights: dict[tuple, float], epochs: int, seed: int) -> DataFrame:
    """One row a leaf: l0.., budget, full epochs, and the key (place, id, text_key) of the last document of the prefix."""
    spark = rows.sparkSession
    names = [f"l{i}" for i in range(depth)]
    found = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    tokens = {tuple(r[n] for n in names): r["tokens"] for r in found}
    spent = budgets(tokens, share * sum(tokens.values()), weights, epochs)
    split = [(*leaf, b, b // tokens[leaf] if tokens[leaf] else 0, b % tokens[leaf] if tokens[leaf] else 0) for leaf, b in spent.items()]
    kinds = ", ".join(f"{n} string" for n in names)
    leaves = spark.createDataFrame(split, f"{kinds}, budget long, full int, rest long")
    placed = on_leaf(rows, leaves, names).withColumn("place", _place(seed, F.col("full"))).withColumn("slice", _slice(F.col("place")))
    sums = placed.where("rest > 0").groupBy(*names, "rest", "slice").agg(F.sum("tokens").alias("part"))
    ahead = Window.partitionBy(*names).orderBy("slice")
    border = sums.withColumn("upto", F.sum("part").over(ahead)).where("upto >= rest AND upto - part < rest")
    border = saved(border.select(*names, F.col("slice").alias("edge"), (F.col("upto") - F.col("part")).alias("before")))
    inside = on_leaf(placed, border, names).where("slice = edge")
    order = Window.partitionBy(*names).orderBy("place", "id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).where("upto - tokens < rest")
    last = taken.groupBy(*names).agg(F.max(F.struct("place", "id", "text_key")).alias("cut"))
    return saved(on_leaf(leaves, last, names, "left").select(*names, "budget", "full", "cut.*"))


def on_leaf(rows: DataFrame, leaves: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of at most ``MAX_LEAVES`` rows."""
    other = leaves.select(*[F.col(n).alias(f"__{n}") for n in names], *[c for c in leaves.columns if c not in names])
    same = [rows[n].eqNullSafe(other[f"__{n}"]) for n in names]
    return rows.join(F.broadcast(other), same, how).drop(*[f"__{n}" for n in names])


def _copies(seed: int) -> Column:
    cut = F.struct(F.col("place"), F.col("cut_id"), F.col("cut_key"))
    own = F.struct(_place(seed, F.col("full")).alias("place"), F.col("id").alias("cut_id"), F.col("text_key").alias("cut_key"))
    return (F.col("full") + F.when(own <= cut, 1).otherwise(0)).cast("int")


def _applied(rows: DataFrame, cuts: DataFrame, depth: int, seed: int) -> DataFrame:
    """``rows`` with budget and copies."""
    cuts = cuts.withColumnsRenamed({"text_key": "cut_key"}).withColumnRenamed("id", "cut_id")
    return on_leaf(rows, cuts, [f"l{i}" for i in range(depth)]).withColumn("copies", _copies(seed)).drop("full", "place", "cut_id", "cut_key")


def selection(docs: DataFrame, levels: dict[str, Column], share: float, weights: dict[tuple, float], epochs: int = 3, seed: int = 17) -> DataFrame:
    """Identity, leaf, tokens, leaf budget and number of copies of every row."""
    rows = saved(slim(docs, levels))
    found = _applied(rows, plan(rows, len(levels), share, weights, epochs, seed), len(levels), seed)
    return found.withColumn("id", F.nullif("id", F.lit(-(1 << 63)).cast("long")))


def mix(docs: DataFrame, levels: dict[str, Column], share: float, weights: dict[tuple, float], epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    rows = saved(slim(docs, levels))
    cuts = plan(rows, len(levels), share, weights, epochs, seed)
    named = {f"l{i}": value.cast("string") for i, value in enumerate(levels.values())}
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_or_least().alias("id"), _text_key().alias("text_key"), *[v.alias(n) for n, v in named.items()])
    taken = _applied(held, cuts, len(levels), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
