"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles. When all documents order their shingles the
same way, a pair of similarity t or more shares at least ceil(t * n) shingles of each
side, so with a prefix of n - ceil(t * n) + l shingles on both sides it shares at
least l of them there. Every document chooses its own l: a longer prefix costs more
postings, but asks for more shared ones before a pair is verified; it takes the l
with the least estimated cost. Two documents with l1 and l2 then share min(l1, l2).

Stages, each a Spark job over whole tables:

1. Equal sets become one class (two 64-bit sums over the set and its size).
2. A first prefix, in the order of fingerprints and with l in proportion to n, tells
   which classes can have a link at all: as many of its shingles must stand in
   another first prefix as the smallest possible partner asks for.
3. Over the whole sets of what is left every shingle's document frequency is counted,
   and a document goes when too few of its shingles are held by another one; this is
   repeated while it removes many. Nothing here is estimated, so the order of stage 4
   keeps its meaning at every size of the input.
4. Shingles are ordered by document frequency, then by fingerprint; the cost of an l
   is estimated from the frequencies, and prefixes become postings.
5. Links. A group of n near copies would give n * n / 2 pairs, so postings first
   meet one pivot each, by turns the most central set (the text that the others are
   copies of, if it is there) and a seeded one; verified links merge groups, and only
   shingles that still lie in several groups go on. When a round links little, stages 3
   and 4 are done once more with groups in place of documents. Then, or when few pairs
   are left, all remaining pairs of different groups of like size with enough shared
   shingles are verified, so no link between groups is missed. A pair is not verified
   when its shared prefix shingles rule the level out: of two prefixes one ends first
   in the common order, and all shared shingles that are not in both lie behind that
   end. Nor is it when one side has too few shingles that any other document holds, or
   when 256 parity bits of the two sets differ in more places than linked sets can.
6. Groups are labelled with their smallest doc_id.

Set sizes, intersections and similarities are exact on 64-bit shingle fingerprints.

Defined cases: null and blank texts have an empty set and are linked with nothing;
a text with fewer words than a shingle is one shingle; rows that share a doc_id
are one document that has the links of all its texts; a null doc_id is linked with
nothing and keeps component_id null; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm import common as C
from abundia.llm.common import saved

SHINGLE = 5
#: Similarity as a percentage.
LEVEL = 80
#: Extension of the first prefix, as a percentage of the set.
FIRST = 10
#: Rounds of frequencies go on while they remove one of so many documents.
PRUNE = 20
#: Longest extension of a prefix that is considered.
MOST_MATCHES = 8
#: Cost of verifying a pair, in postings read.
VERIFY = 50.0
#: Rounds with pivots go on while one of so many documents finds a link.
WORTH = 20
#: Remaining pairs that are met at once, as a multiple of the postings.
SPARE = 4
#: 64-bit words of a set's parity bits.
PARITY = 4


def shingle_sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, in the order of the rows."""
    offsets, data = C.text_buffers(batch.column(column))
    for low, high in C.pieces(offsets):
        words = C.Words(offsets[low : high + 1], data[offsets[low] : offsets[high]], lower=True)
        hashes = words.hashes()
        windows = C.all_windows(hashes, width)
        for i in range(high - low):
            a, b = words.bounds[i], words.bounds[i + 1]
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                yield C.all_windows(hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _share(n: int, level: int) -> int:
    """Shingles that a set of n has in common with any linked one, at least."""
    return -(-level * n // 100)


def first_prefix(n: int, level: int) -> tuple[int, int]:
    """(length, need): the first prefix of a set of n shingles, and how many of it every linked set has in its own.

    The extension grows with the set, so the smallest set that may be linked asks for least.
    """

    def extension(m: int) -> int:
        return min(1 + FIRST * m // 100, _share(m, level))

    return n - _share(n, level) + extension(n), extension(_share(n, level))


def _first(docs: DataFrame, width: int, level: int) -> DataFrame:
    """doc_id, n, two sums that stand for the set, the first prefix and its need."""

    def run(batches):
        for batch in batches:
            n, one, two, need, parts = [], [], [], [], []
            for found in shingle_sets(batch, 1, width):
                length, least = first_prefix(len(found), level) if len(found) else (0, 0)
                n.append(len(found))
                one.append(found.sum(dtype=np.uint64))
                two.append(C.mix(found + np.uint64(C.BASE)).sum(dtype=np.uint64))
                need.append(least)
                parts.append(found[:length])
            flat = C.longs(np.concatenate(parts)) if parts else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    C.longs(np.array(one, np.uint64)),
                    C.longs(np.array(two, np.uint64)),
                    pa.array(need, pa.int64()),
                    C.lists_of(flat, [len(p) for p in parts]),
                ],
                ["doc_id", "n", "one", "two", "need", "prefix"],
            )

    return _ids(docs).mapInArrow(run, "doc_id long, n long, one long, two long, need long, prefix array<long>")


def choose_prefix(found: np.ndarray, counts: np.ndarray, level: int, alone: int = 0) -> tuple[int, np.ndarray]:
    """(l, prefix) of one set: the extension of least estimated cost.

    ``alone`` more shingles come before all of ``found`` and cost nothing, since no other document holds them.
    """
    n = len(found) + alone
    order = np.lexsort((found, counts))
    base = n - _share(n, level)
    lengths = np.arange(base + 1, min(n, base + MOST_MATCHES) + 1)
    load = np.cumsum(counts[order])[lengths - alone - 1]
    cost = load * (1.0 + VERIFY / (lengths - base))
    best = int(np.argmin(cost))
    return best + 1, found[order[: lengths[best] - alone]]


def parity(found: np.ndarray) -> np.ndarray:
    """Of each of 64 * ``PARITY`` bits, whether an odd number of the fingerprints falls on it.

    Two sets differ in at least as many members as their bits do.
    """
    bits = np.bincount((found % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _candidates(base: DataFrame) -> DataFrame:
    """doc_id of the classes whose first prefix has enough shingles in another one's."""
    # all texts of a doc_id count together here, by the least of their needs: this only adds candidates
    tokens = base.select("doc_id", F.explode("prefix").alias("token"))
    common = saved(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    met = tokens.join(common, "token").groupBy("doc_id").agg(F.count("*").alias("met"))
    least = base.groupBy("doc_id").agg(F.min("need").alias("need"))
    out = saved(met.join(least, "doc_id").where("met >= need").select("doc_id"))
    C.drop_table(common)
    return out


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, the sum that tells texts of one doc_id apart, and the whole sorted set."""

    def run(batches):
        for batch in batches:
            found = list(shingle_sets(batch, 1, width))
            flat = C.longs(np.concatenate(found)) if found else pa.array([], pa.int64())
            one = np.array([f.sum(dtype=np.uint64) for f in found], np.uint64)
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), C.longs(one), C.lists_of(flat, sizes)], ["doc_id", "n", "one", "items"]
            )

    return docs.mapInArrow(run, "doc_id long, n long, one long, items array<long>")


def _frequencies(sets: DataFrame, level: int) -> DataFrame:
    """doc, n, one and ``held``: frequency and fingerprint of every shingle that another document holds too."""
    tokens = sets.select(F.col("doc_id").alias("doc"), "n", "one", F.explode("items").alias("token"))
    before, held = sets.count(), None
    while True:
        common = saved(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
        found = tokens.join(common, "token").groupBy("doc", "n", "one").agg(F.collect_set(F.struct("c", "token")).alias("held"))
        now = saved(found.where(f"100 * size(held) >= {level} * n"))
        C.drop_table(common)
        if held is not None:
            C.drop_table(held)
        held, after = now, now.count()
        if (before - after) * PRUNE <= before:
            return held
        before = after
        tokens = held.select("doc", "n", "one", F.explode("held.token").alias("token"))


def _between(held: DataFrame, roots: DataFrame, level: int) -> DataFrame:
    """``held`` of shingles that stand in several groups, for documents that have enough of them to be linked with another group."""
    groups = roots.select(F.col("node").alias("doc"), "root")
    tokens = held.join(groups, "doc").select("doc", "n", "one", "root", F.explode("held.token").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    common = saved(counts.where("low < high").select("token", "c"))
    found = tokens.join(common, "token").groupBy("doc", "n", "one").agg(F.collect_set(F.struct("c", "token")).alias("held"))
    out = saved(found.where(f"100 * size(held) >= {level} * n"))
    C.drop_table(common)
    return out


def _odds() -> list[str]:
    return [f"odd{k}" for k in range(PARITY)]


def _postings(held: DataFrame, level: int) -> DataFrame:
    """token, doc, n, l, shingles behind the prefix, shingles that others hold, how central the set is, its parity bits: one row for each of a prefix.

    A set is the more central the more other documents hold its shingles (mean of log2 of the frequencies, in thousandths).
    """
    odds = _odds()

    def run(batches):
        for batch in batches:
            n, most = batch.column("n").to_numpy(), []
            tokens, counts = batch.column("token"), batch.column("c")
            ends = tokens.offsets.to_numpy()
            every, weight = tokens.values.to_numpy().view(np.uint64), counts.values.to_numpy()
            least, rest, mid, parts, odd = [], [], [], [], []
            for i in range(batch.num_rows):
                mine = slice(ends[i], ends[i + 1])
                size = int(ends[i + 1] - ends[i])
                l, part = choose_prefix(every[mine], weight[mine], level, int(n[i]) - size)
                least.append(l)
                rest.append(size - len(part))
                most.append(size)
                mid.append(int(1000 * np.log2(weight[mine]).sum() / n[i]))
                parts.append(part)
                odd.append(parity(every[mine]))
            flat = C.longs(np.concatenate(parts)) if parts else pa.array([], pa.int64())
            bits = np.array(odd, np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("n"),
                    pa.array(least, pa.int32()),
                    pa.array(rest, pa.int64()),
                    pa.array(most, pa.int64()),
                    pa.array(mid, pa.int64()),
                    *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITY)],
                    C.lists_of(flat, [len(p) for p in parts]),
                ],
                ["doc", "n", "l", "rest", "most", "mid", *odds, "prefix"],
            )

    rows = held.select("doc", "n", F.col("held.token").alias("token"), F.col("held.c").alias("c"))
    out = rows.mapInArrow(run, f"doc long, n long, l int, rest long, most long, mid long, {' long, '.join(odds)} long, prefix array<long>")
    return out.select(F.explode("prefix").alias("token"), "doc", "n", "l", "rest", "most", "mid", *odds)


def _verified(pairs: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the level."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = np.zeros(batch.num_rows, bool)
            left, right = x.values.to_numpy(), y.values.to_numpy()
            lo, ro = x.offsets.to_numpy(), y.offsets.to_numpy()
            for i in range(batch.num_rows):
                p, q = left[lo[i] : lo[i + 1]], right[ro[i] : ro[i + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                good[i] = 100 * both >= level * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _links(lists: DataFrame, sets: DataFrame, level: int, roots: DataFrame, last: bool = False) -> tuple[DataFrame, bool]:
    """(node, root) with the links of ``lists`` (see ``_postings``), and whether none is left between groups; ``lists`` is deleted."""
    turn = 0
    fits = f"100 * least(n, bn) >= {level} * greatest(n, bn) AND {100 + level} * least(most, bmost) >= {level} * (n + bn)"
    # what no other document holds is in one of the two only, and so is a member for each bit of unlike parity
    unlike = " + ".join(["n - most + bn - bmost", *[f"bit_count({o} ^ b{o})" for o in _odds()]])
    fits += f" AND {100 + level} * ({unlike}) <= {100 - level} * (n + bn)"
    enough = f"shared >= least AND {100 + level} * (shared + behind) >= {level} * sizes"
    docs, found = roots.count(), 0
    while True:
        now = lists.join(roots.withColumnRenamed("node", "doc"), "doc")
        spread = now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        lists_left = saved(now.join(spread, "token"))
        C.drop_table(lists)
        lists = lists_left.drop("root")  # a shingle of one group stays in one group
        per_group = lists_left.groupBy("token", "root").agg(F.count("*").alias("k"))
        cross = per_group.groupBy("token").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("p"))
        rows, pairs_left = lists_left.count(), cross.agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]
        if rows == 0:
            C.drop_table(lists_left)
            return roots, True
        last = last or turn > 0 and pairs_left <= SPARE * rows
        if not last and turn > 1 and found * WORTH < docs:
            C.drop_table(lists_left)
            return roots, False
        columns = ("n", "l", "rest", "most", *_odds(), "root")
        theirs = [F.col(c).alias(f"b{c}") for c in columns]
        if last:  # linked sets are of the same or of neighbouring size classes
            kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / level + 1e-9))) if level < 100 else F.col("n")
            other = lists_left.select("token", F.col("doc").alias("b"), *theirs, kind.alias("size"))
            near = F.explode(F.array(*[kind + i for i in (-1, 0, 1)])).alias("size")
            met = lists_left.select("token", "doc", *columns, near).join(other, ["token", "size"]).where(f"doc < b AND root <> broot AND {fits}")
        else:
            # of near copies of one text that is there too, that text is the most central one
            rank = -F.col("mid") if turn % 2 == 0 else F.lit(0).cast("long")
            drawn = F.struct(rank.alias("near"), F.xxhash64("doc", F.lit(turn)).alias("h"), F.col("doc").alias("b"), *theirs)
            pivot = lists_left.groupBy("token").agg(F.min(drawn).alias("p")).select("token", "p.*")
            met = lists_left.join(pivot, "token").where(f"root <> broot AND {fits}")
        met = met.groupBy(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).agg(
            F.count("*").alias("shared"),
            F.min(F.least("l", "bl")).alias("least"),
            F.max(F.greatest("rest", "brest")).alias("behind"),
            F.min(F.col("n") + F.col("bn")).alias("sizes"),
        )
        pairs = met.where(enough).select("a", "b")
        good = saved(_verified(pairs, sets, level))
        linked = good.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"
        )
        edges = saved(linked.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        C.drop_table(good)
        found = edges.count()
        if found:
            moved = C.contract(edges, roots.select(F.col("root").alias("node")).distinct())
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
            before, roots = roots, saved(roots.join(step, "root").select("node", F.col("to").alias("root")))
            C.drop_table(moved)
            C.drop_table(before)
        C.drop_table(edges)
        if last:
            C.drop_table(lists_left)
            return roots, True
        turn += 1


def components(docs: DataFrame, width: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    wide = saved(_first(docs, width, level))
    marks = saved(wide.select("doc_id", "n", "one", "two"))  # the prefixes go when the candidates are known
    has_set = "doc_id IS NOT NULL AND n > 0"
    known = marks.where(has_set)
    classes = saved(known.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep")))
    first = wide.where(has_set).join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "one", "two"], "left_semi")
    live = _candidates(first)
    C.drop_table(wide)
    sets = saved(_sets(_ids(docs).join(live, "doc_id", "left_semi"), width).where("n > 0"))
    C.drop_table(live)
    held = _frequencies(sets, level)
    lists = saved(_postings(held, level))
    start = saved(held.select(F.col("doc").alias("node")).distinct().select("node", F.col("node").alias("root")))
    roots, done = _links(lists, sets, level, start)
    if not done:  # pivots link little: only shingles that stand in several groups count from here on
        held, before = _between(held, roots, level), held
        C.drop_table(before)
        lists = saved(_postings(held, level))
        roots, _ = _links(lists, sets, level, roots, last=True)
    C.drop_table(held)
    C.drop_table(sets)
    # every row's class, every class's group, every group's smallest id
    rows = marks.join(classes, ["n", "one", "two"], "left").select("doc_id", F.col("n").alias("n_shingles"), "rep")
    same = rows.where("rep IS NOT NULL AND rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = same.join(known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    if not repeated.isEmpty():  # a doc_id with several texts ties their classes together
        base = rows.where("rep IS NOT NULL").select(F.col("rep").alias("node")).union(rows.where("doc_id IS NOT NULL").select("doc_id")).distinct()
        start = base.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        start = saved(start)
        tied = C.contract(
            repeated.join(start.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(start.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")),
            start.select(F.col("root").alias("node")).distinct(),
        )
        roots = saved(start.join(tied.select(F.col("node").alias("root"), F.col("root").alias("to")), "root").select("node", F.col("to").alias("root")))
    placed = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("group", F.coalesce("root", "rep"))
    label = saved(placed.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("label")))
    out = placed.join(label, "group", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows without a doc_id stay."""
    found = components(docs, width, level)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "gone_id")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
