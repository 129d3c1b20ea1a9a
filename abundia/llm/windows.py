"""Windows of consecutive tokens, grouped by an anchor that depends on their content only.

The anchor of a window is the gram of ``gram`` tokens with the least fingerprint,
the first of equal ones, so equal windows have equal anchors at equal offsets.
Neighbouring windows mostly share one place: a maximal run of them is one row

    id, text_key, anchor, run, start, count

where ``run`` is the fingerprint of all its tokens. No two windows of a run are
equal, as their anchors stand at different offsets. Two equal runs hold equal
windows; windows of unequal runs can be equal only if their anchors are. So a
corpus is compared by a few rows per hundred tokens, and single windows are formed
only for runs that share an anchor with a different run.

``RepeatSketch`` is a count-min sketch of anchors that tells "seen" from "seen
again": two bits a cell, merged with or, which never forgets a repetition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm import common as C
from abundia.llm.common import saved

RUNS = "id long, text_key long, anchor long, run long, start int, count int, again boolean"
DEPTH = 2
CELLS = 1 << 25
BLOCK = 1 << 20
FAN = 32
HALF = (1 << 32) - 1

#: From the bytes of consecutive texts and their offsets to token values and the range of tokens of each text.
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = C.Words(offsets, data, lower=False)
    return words.hashes(), words.bounds


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.byte_values(data), offsets - offsets[0]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def runs_of(values: np.ndarray, bounds: np.ndarray, window: int, gram: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start in the text, windows, anchor, run) of every run of consecutive texts, or of their wanted windows."""
    none = np.zeros(0, np.int64)
    if len(values) < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = C.all_windows(values, gram)
    # the order is that of the upper half of a fingerprint, then of place: content alone decides
    rank = (grams & np.uint64(HALF << 32)) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(rank, window - gram + 1) & np.uint64(HALF)).astype(np.int64)
    ends = bounds[1:] - window + 1
    full = ends > bounds[:-1]
    edge = np.zeros(len(place) + 1, np.int64)
    np.add.at(edge, bounds[:-1][full], 1)
    np.add.at(edge, ends[full], -1)
    inside = np.cumsum(edge[:-1]) > 0
    if wanted is not None:
        inside &= wanted[: len(inside)]
    first, last = inside.copy(), inside.copy()
    change = place[1:] != place[:-1]
    first[1:] &= change | ~inside[:-1]
    last[:-1] &= change | ~inside[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    return text, starts - bounds[text], stops - starts, grams[place[starts]], C.fingerprints(values, starts, stops - 1 + window)


def keyed(docs: DataFrame) -> DataFrame:
    """id and text_key tell a row of documents; both columns and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(C.id_or_least().alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _pieces(batch: pa.RecordBatch, tokens: Tokens) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    offsets, data = C.text_buffers(batch.column(batch.schema.get_field_index("text")))
    for low, high in C.pieces(offsets, C.PIECE // 2):
        yield low, *tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1])


def _cells(anchors: np.ndarray) -> list[np.ndarray]:
    return [(C.mix(anchors + np.uint64(row)) & np.uint64(CELLS - 1)).astype(np.int64) for row in range(DEPTH)]


def repeat_sketch(docs: DataFrame, tokens: Tokens, window: int, gram: int, within: bool) -> np.ndarray:
    """Bitmaps, one per row of the sketch, of cells that were met at least twice.

    ``within``: repetitions inside one text count too. Partition sketches are
    merged in a tree of ``FAN``, a block of cells at a time.
    """

    def count(batches):
        state = np.zeros((DEPTH, CELLS), np.uint8)
        for batch in batches:
            for _, values, bounds in _pieces(batch, tokens):
                text, _, _, anchor, _ = runs_of(values, bounds, window, gram)
                if not within:
                    order = np.lexsort((anchor, text))
                    text, anchor = text[order], anchor[order]
                    new = np.ones(len(anchor), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
                    anchor = anchor[new]
                for row, cells in zip(state, _cells(anchor), strict=True):
                    met, times = np.unique(cells, return_counts=True)
                    row[met] = np.minimum(row[met] + np.minimum(times, 2), 2)
        part = TaskContext.get().partitionId()
        flat = state.reshape(-1)
        for i in range(len(flat) // BLOCK):
            block = flat[i * BLOCK : (i + 1) * BLOCK]
            if block.any():
                yield out(part, i, np.packbits(block > 0), np.packbits(block > 1))

    def out(part: int, block: int, seen: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([block]), pa.array([seen.tobytes()]), pa.array([again.tobytes()])], ["part", "block", "seen", "again"]
        )

    def merge(key, table):  # at most FAN pairs of bitmaps
        seen, again = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
        for s, a in zip(table["seen"], table["again"], strict=True):
            s, a = np.frombuffer(s.as_py(), np.uint8), np.frombuffer(a.as_py(), np.uint8)
            again |= a | (seen & s)
            seen |= s
        return pa.Table.from_batches([out(key[0].as_py(), key[1].as_py(), seen, again)])

    kind = "part long, block long, seen binary, again binary"
    sent = level = saved(keyed(docs).mapInArrow(count, kind))
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", "block").applyInArrow(merge, kind)
    bits = np.zeros(DEPTH * CELLS // 8, np.uint8)
    for row in level.select("block", "again").collect():  # DEPTH * CELLS / 8 bytes in all
        bits[row.block * (BLOCK // 8) : (row.block + 1) * (BLOCK // 8)] = np.frombuffer(bytes(row.again), np.uint8)
    C.drop_table(sent)
    return bits.reshape(DEPTH, CELLS // 8)


def _repeated(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    good = np.ones(len(anchors), bool)
    for row, cells in zip(bits, _cells(anchors), strict=True):
        good &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return good


def run_rows(docs: DataFrame, tokens: Tokens, window: int, gram: int, sketch=None) -> DataFrame:
    """Runs of every text, without those whose anchor the (broadcast) sketch shows to be alone.

    ``again``: an equal run starts earlier in the same text.
    """

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for low, values, bounds in _pieces(batch, tokens):
                text, start, count, anchor, whole = runs_of(values, bounds, window, gram)
                if sketch is not None:
                    good = _repeated(sketch.value, anchor)
                    text, start, count, anchor, whole = (x[good] for x in (text, start, count, anchor, whole))
                if not len(text):
                    continue
                order = np.lexsort((start, whole, text))
                again = np.zeros(len(text), bool)
                again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                at = pa.array(text + low)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), C.longs(anchor), C.longs(whole), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)],
                    ["id", "text_key", "anchor", "run", "start", "count", "again"],
                )

    return keyed(docs).mapInArrow(run, RUNS)


def single_windows(docs: DataFrame, wanted: DataFrame, tokens: Tokens, window: int) -> DataFrame:
    """(w, id, text_key, start) of every window in the wanted runs (id, text_key, start, count)."""

    def run(batches):
        for batch in batches:
            ids, keys, asked = batch.column(0), batch.column(1), batch.column(3)
            offsets, data = C.text_buffers(batch.column(2))
            for i in range(batch.num_rows):
                values, _ = tokens(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2])
                prints = C.all_windows(values, window)
                spans = asked[i].values
                first, count = spans.field("start").to_numpy(), spans.field("count").to_numpy()
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                at = np.unique(at)
                yield pa.RecordBatch.from_arrays(
                    [C.longs(prints[at]), pa.repeat(ids[i], len(at)), pa.repeat(keys[i], len(at)), pa.array(at.astype(np.int32))], ["w", "id", "text_key", "start"]
                )

    spans = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    return keyed(docs).join(spans, ["id", "text_key"]).select("id", "text_key", "text", "spans").mapInArrow(run, "w long, id long, text_key long, start int")


def sub_runs(docs: DataFrame, wanted: DataFrame, tokens: Tokens, window: int, gram: int) -> DataFrame:
    """The windows of the wanted runs (id, text_key, start, count) as runs of another gram length."""

    def run(batches):
        for batch in batches:
            ids, keys, asked = batch.column(0), batch.column(1), batch.column(3)
            offsets, data = C.text_buffers(batch.column(2))
            for i in range(batch.num_rows):
                values, bounds = tokens(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2])
                spans = asked[i].values
                a = spans.field("start").to_numpy().astype(np.int64)
                edge = np.zeros(len(values) + 2, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + spans.field("count").to_numpy(), -1)
                _, start, count, anchor, whole = runs_of(values, bounds, window, gram, np.cumsum(edge) > 0)
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(ids[i], n), pa.repeat(keys[i], n), C.longs(anchor), C.longs(whole), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["id", "text_key", "anchor", "run", "start", "count"],
                )

    spans = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    rows = keyed(docs).join(spans, ["id", "text_key"]).select("id", "text_key", "text", "spans")
    return rows.mapInArrow(run, "id long, text_key long, anchor long, run long, start int, count int")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and ``spans``, the flat sorted (start, end) token ranges to remove; null where there are none."""
    lists = spans.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    doc_id = F.nullif("id", F.lit(-(1 << 63)).cast("long")).alias("doc_id")
    return keyed(docs).join(lists, ["id", "text_key"], "left").select(doc_id, "text", "spans")


def removed_mask(n: int, spans: pa.Scalar) -> np.ndarray | None:
    """Which of ``n`` tokens a list of (start, end) covers; None for none."""
    if not spans.is_valid:
        return None
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
    np.add.at(edge, spans.values.field("end").to_numpy(), -1)
    return np.cumsum(edge[:-1]) > 0
