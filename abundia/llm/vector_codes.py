"""Vector code compression: product codebooks fitted by exact rounds under norm-of-sum bounds.

A vector of whole numbers is cut into ``parts`` pieces; each piece position has a
codebook of ``entries`` entries and a vector's code is the index of the nearest
entry for each piece. Codebooks start at the smallest ids and are refitted by
rounds of assignment and floored means. All distances are exact whole numbers.

An assignment is not computed again where it cannot have changed. Entries are dealt
into ``GROUPS`` groups; for every piece and group the table of states keeps a lower
bound of the distance to all entries but the assigned one, and the round at which
that bound was computed. All codebooks so far are kept, so in a later round the
bound is lowered by the net displacement of the group's entries between its own
round and now (the norm of the sum of their moves), which is never more than the
sum of their drifts round by round. Only groups whose bound does not lie above the
exact distance to the assigned entry are scanned again.

Each round is one map over the table of states, which is written, and one sum per
entry and component over it: inside tasks first, then one small row a component.
The driver holds codebooks only, ``entries`` vectors a round.

Defined cases: rows whose vector is null or holds null or non-finite components are
left out; a shorter vector is read as if zeros followed up to the longest one, and so
is the last piece if the length is no multiple of ``parts``; components beyond
``LIMIT`` / 256 in size count as that; a null vec_id comes before all others; rows
that share a vec_id are each coded, and stand in the order of their vectors where
codebooks start; with fewer rows than entries there are as many entries as rows;
null labels form one group; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundia.llm.common import drop_table, id_or_least, saved

PARTS = 16
ENTRIES = 64
ROUNDS = 2
GROUPS = 4
SCALE = 256.0
#: Whole numbers are held within this, so that squares add up in 64 bits.
LIMIT = 1 << 24
#: Values worked on at once inside a task.
PIECE = 1 << 21


def whole(vector: Column) -> Column:
    """Components as whole numbers."""
    low, high = F.lit(float(-LIMIT)), F.lit(float(LIMIT))
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), low), high).cast("int"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if x.shape[-1] * (2 * int(most)) ** 2 < 1 << 53:  # exact in doubles too
        x, entries = x.astype(float), entries.astype(float)
    found = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]
    return found.astype(np.int64)


def downwards(bound: np.ndarray) -> np.ndarray:
    """As single precision, never above the given value."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def grouped(entries: int, groups: int = GROUPS) -> list[np.ndarray]:
    return [g for g in np.array_split(np.arange(entries), groups) if len(g)]


def displacements(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """(round, part, group): how far a group's entries have moved at most, net, from that round's codebooks to the last."""
    moved = np.stack([np.sqrt(((history[-1] - old).astype(float) ** 2).sum(-1)) for old in history])
    return np.stack([moved[:, :, g].max(-1) for g in groups], -1) * (1 + 1e-9)


class Piece:
    """Assignment of one piece position for a block of rows, under bounds."""

    def __init__(self, entries: np.ndarray, groups: list[np.ndarray], moved: np.ndarray, now: int):
        self.entries, self.groups, self.moved, self.now = entries, groups, moved, now

    def start(self, x: np.ndarray):
        """(codes, squared distances, bounds, stamps) without anything known."""
        n, shape = len(x), (len(x), len(self.groups))
        code, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        return self._scan(x, code, best, np.full(shape, -np.inf), np.ones(shape, bool))

    def follow(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray):
        """The same from an earlier round's codes, bounds and stamps; ``scanned`` tells what was looked at again."""
        gap = (x - self.entries[code]).astype(np.int64)
        best = (gap * gap).sum(1)
        lowered = bounds - self.moved[stamps, np.arange(len(self.groups))[None]]
        reach = np.sqrt(best.astype(float))[:, None] * (1 + 1e-9) + 1e-6
        return self._scan(x, code, best, lowered, lowered <= reach, stamps, bounds)

    def _scan(self, x, code, best, lowered, needed, stamps=None, bounds=None):
        first, first_best = code, best
        code, best = code.copy(), best.copy()
        looked = []
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(needed[:, g])
            found = squares(x[rows], self.entries[members]) if len(rows) else np.zeros((0, len(members)), np.int64)
            looked.append((rows, found))
            if len(rows):
                least = found.argmin(1)
                value, index = found[np.arange(len(rows)), least], members[least]
                better = (value < best[rows]) | ((value == best[rows]) & (index < code[rows]))
                code[rows[better]], best[rows[better]] = index[better], value[better]
        stamps = np.full(lowered.shape, self.now, np.uint8) if stamps is None else stamps.copy()
        bounds = np.zeros(lowered.shape, np.float32) if bounds is None else bounds.copy()
        for g, members in enumerate(self.groups):
            rows, found = looked[g]
            if len(rows):
                away = np.where(members[None] == code[rows][:, None], np.inf, np.sqrt(found.astype(float)))
                bounds[rows, g], stamps[rows, g] = downwards(away.min(1)), self.now
            # an entry that is no longer assigned comes under the bound of its group again
            left = np.flatnonzero((code != first) & (first >= members[0]) & (first <= members[-1]) & ~needed[:, g])
            bounds[left, g] = downwards(np.minimum(lowered[left, g], np.sqrt(first_best[left].astype(float))))
            stamps[left, g] = self.now
        return code, best, bounds, stamps


class Fit:
    """What is known about the shape of the data: the same for every round."""

    def __init__(self, parts: int, width: int, entries: int):
        self.parts, self.width, self.groups = parts, width, grouped(entries)

    def cut(self, column: pa.Array) -> np.ndarray:
        """(rows, parts, width) of a list column, zeros where a vector has ended."""
        offsets = column.offsets.to_numpy()
        sizes, values = np.diff(offsets), column.values.to_numpy()[offsets[0] : offsets[-1]]
        out = np.zeros((len(column), self.parts * self.width), np.int64)
        out[np.arange(out.shape[1])[None] < sizes[:, None]] = values
        return out.reshape(len(column), self.parts, self.width)


STATE = "codes binary, bounds binary, stamps binary, error long"


def assigned(rows: DataFrame, fit: Fit, history: list[np.ndarray]) -> DataFrame:
    """Rows with the state after one more assignment, to the last codebooks of ``history``."""
    now, known = len(history) - 1, len(history) > 1
    sent = rows.sparkSession.sparkContext.broadcast((history[-1], displacements(history, fit.groups)))
    shape = (fit.parts, len(fit.groups))

    def run(batches: Iterator[pa.RecordBatch]):
        books, moved = sent.value
        pieces = [Piece(books[p], fit.groups, moved[:, p], now) for p in range(fit.parts)]
        step = max(1, PIECE // (fit.parts * fit.width + fit.parts * books.shape[1]))
        for whole_batch in batches:
            for low in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(low, step)
                n = batch.num_rows
                x = fit.cut(batch.column("x"))
                codes, bounds = np.zeros((n, fit.parts), np.uint8), np.zeros((n, *shape), np.float32)
                stamps, error = np.zeros((n, *shape), np.uint8), np.zeros(n, np.int64)
                if known:
                    read = lambda name, kind: np.frombuffer(b"".join(v.as_py() for v in batch.column(name)), kind)
                    old = read("codes", np.uint8).reshape(n, fit.parts), read("bounds", np.float32).reshape(bounds.shape), read("stamps", np.uint8).reshape(bounds.shape)
                for p, piece in enumerate(pieces):
                    if known:
                        found = piece.follow(x[:, p], old[0][:, p].astype(np.int64), old[1][:, p], old[2][:, p])
                    else:
                        found = piece.start(x[:, p])
                    codes[:, p], bounds[:, p], stamps[:, p] = found[0], found[2], found[3]
                    error += found[1]
                binary = [pa.array([a[i].tobytes() for i in range(n)], pa.binary()) for a in (codes, bounds, stamps)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "x")], *binary, pa.array(error)], ["vec_id", "label", "x", "codes", "bounds", "stamps", "error"])

    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, x array<int>, {STATE}"
    return rows.mapInArrow(run, kind)


def refitted(state: DataFrame, fit: Fit, books: np.ndarray) -> np.ndarray:
    """Floored means of the pieces of every entry; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = fit.cut(batch.column("x"))
            codes = np.frombuffer(b"".join(v.as_py() for v in batch.column("codes")), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], codes[:, p], x[:, p])
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        flat = total.ravel()
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(flat[slots])], ["slot", "v"])

    sums = state.select("x", "codes").mapInArrow(run, "slot long, v long").groupBy("slot").agg(F.sum("v").alias("v"))
    flat = np.zeros(parts * entries * (width + 1), np.int64)
    for row in sums.collect():  # one row a component of an entry
        flat[row.slot] = row.v
    total = flat.reshape(parts, entries, width + 1)
    count = total[..., width:]
    return np.where(count > 0, total[..., :width] // np.maximum(count, 1), books)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes as ``parts`` bytes, error) of every usable row, and the codebooks (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is stored in one byte a part")
    rows = vectors.where(usable(F.col("embedding")))
    rows = saved(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole(F.col("embedding")).alias("x")))
    width = -(-(rows.agg(F.max(F.size("x"))).first()[0] or 0) // parts)
    first = [row.x for row in rows.orderBy(id_or_least("vec_id"), F.col("vec_id").isNotNull(), "x").limit(entries).collect()]
    fit = Fit(parts, width, len(first))
    if not first:
        empty = rows.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    history = [fit.cut(pa.array(first, pa.list_(pa.int32()))).transpose(1, 0, 2)]
    state = rows
    for _ in range(rounds):
        after = saved(assigned(state, fit, history))
        drop_table(state)
        state = after
        history.append(refitted(state, fit, history[-1]))
    found = saved(assigned(state, fit, history).select("vec_id", "label", "codes", "error"))
    drop_table(state)
    return found, history[-1]


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code in hex, error, the error of all rows of its label, and a digest of the codebooks."""
    found, books = compressed(vectors, parts, entries, rounds)
    # written first, so that few labels travel to the rows and many meet them by a sorted join
    sums = saved(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"))
    both = found.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
