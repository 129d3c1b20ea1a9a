"""Shared parts: words and fingerprints of Arrow text batches, scratch tables, connected groups.

Texts are handled as UTF-8 bytes in numpy. A fingerprint is a polynomial in the
token values modulo 2**64, taken from one running sum over a whole batch, so all
windows of a length cost a few vector operations whatever the length is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundia.sources import scratch

#: Bytes of text worked on at once inside a task; a longer document is worked on alone.
PIECE = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.cumprod(known)
    return known[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64) - offsets[0], values[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, in order; every row is in one."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


class Words:
    """Words of consecutive texts: byte ranges, and the range of words of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool, blank: np.ndarray = _space):
        self.data = _lower[data] if lower else data
        offsets = offsets - offsets[0]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        ink = ~blank[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        first[inner] = ink[inner]
        inner = inner[inner > 0]
        last[inner - 1] = ink[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return fingerprints(_value[self.data], self.starts, self.ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _value[data]


def running(values: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def fingerprints(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of each range of ``values``; equal ranges have equal ones wherever they stand."""
    sums = running(values)
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def all_windows(values: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of every window of ``length`` values, also of those across texts."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = running(values)
    return mix((sums[length:] - sums[:-length]) * powers(INVERSE, n) + np.uint64(length))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def lists_of(values: pa.Array, sizes) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def id_or_least(column: str = "doc_id") -> Column:
    """The document id as a key of order; null counts as smaller than any id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)).cast("long"))


def _folders(df: DataFrame) -> set[str]:
    return {name.rsplit("/", 1)[0] for name in df.inputFiles()}


def _drop(spark: SparkSession, folders: set[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    _drop(df.sparkSession, _folders(df))


def _follow(moves: DataFrame, onward: DataFrame) -> DataFrame:
    step = onward.select(F.col("a").alias("to"), F.col("to").alias("next"))
    return moves.join(step, "to").select("a", F.col("next").alias("to"))


def contract(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected groups: (node, root) for every node, from undirected edges (a, b).

    Each round every node points at the node with the least seeded hash at most two
    edges away, follows that node's pointer too, and the edges are redrawn between the
    new nodes, so a star is gone after a round and chains shrink by a constant factor
    whatever their ids are. All steps are
    joins and groupings over tables written to the shared folder.
    """
    roots = nodes.select("node", F.col("node").alias("root"))
    edges = saved(edges.where("a <> b").select("a", "b").distinct())
    turn, written = 0, []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).select("a", "b")
        ends = both.select("a").distinct().select("a", F.col("a").alias("b"))
        closed = both.union(ends)
        first = closed.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))).alias("n"))
        once = saved(first.select("a", "n.h", "n.to"))
        reach = closed.join(once.select(F.col("a").alias("b"), F.struct("h", "to").alias("n")), "b")
        twice = reach.groupBy("a").agg(F.min("n").alias("n")).select("a", "n.to")
        moves = saved(_follow(twice, twice))
        step = moves.withColumnsRenamed({"a": "root", "to": "moved"})
        roots = saved(roots.join(step, "root", "left").select("node", F.coalesce("moved", "root").alias("root")))
        redrawn = (
            edges.join(moves.withColumnsRenamed({"to": "ta"}), "a")
            .join(moves.withColumnsRenamed({"a": "b", "to": "tb"}), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        redrawn = saved(redrawn)
        for old in (edges, once, moves, *written):
            drop_table(old)
        edges, written, turn = redrawn, [roots], turn + 1
    drop_table(edges)
    return roots


#: Folders of the scratch tables written inside each ``settled`` that is under way; plain text, since this module travels to the tasks.
_open: list[set[str]] = []


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns and delete every other scratch table that was written on the way to it."""
    _open.append(set())
    try:
        out = saved(make())
    finally:
        written = _open.pop()
    kept = _folders(out)
    _drop(out.sparkSession, written - kept)
    if _open:
        _open[-1] |= kept
    return out


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; its shuffle files go when the write has ended."""
    table = scratch.saved(df)
    if _open:
        _open[-1].update(_folders(table))
    return table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
