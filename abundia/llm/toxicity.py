"""Toxicity by a convolutional text classifier.

Words are hashed to embedding rows, and so are their first ``HEADS`` bytes, so that
unseen forms of a known stem have a place; a word's vector is the sum. Filters of several widths slide over the
embeddings, each filter keeps its maximum over the text, and a logistic layer on
these maxima gives the score. Training uses every labelled row outside the held-out
fold; a gradient touches the maxima only. One embedding
dimension for words and one for each head starts at the smoothed log odds of the
hashed row, counted over all these rows, the rest at random. In each of ``EPOCHS`` passes every task goes
through its rows from the same model, and the changes are averaged: an embedding row by how
often a task touched it, the rest by the rows of a task. Changes are added up in Spark by
blocks of the model, so the driver gets one model a pass whatever the input.

Scoring covers every whole text: the model is broadcast (a few MB whatever the
input), filters are applied as small matrix products, and maxima are taken per text. A threshold per language, in steps of 1 / ``GRID``, is calibrated on the
training rows of every fifth doc_id, all of them, by a second fit that did not see these; it gives the column ``flagged`` and never enters a score.

Defined cases: a null or empty text is scored from padding alone; without labelled
rows of both classes every score is the smoothed share of label 1; a null language
is calibrated with all languages together; repeated rows are scored alike; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm import common as C
from abundia.llm.common import saved

ROWS = 1 << 16
WIDE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
HEADS = (4, 5)
KINDS = 1 + len(HEADS)
EPOCHS = 4
#: Rows that a task of a pass should have at least.
SLICE = 4000
#: Embedding rows whose changes are added up together.
BLOCK = 256
GRID = 1 << 14
PAD = 0

_blank = np.ones(256, bool)
_blank[48:58] = _blank[65:91] = _blank[97:123] = _blank[128:] = False


def padded_tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of consecutive texts, each followed by padding, and where each text starts."""
    words = C.Words(offsets, data, lower=True, blank=_blank)
    values = C.byte_values(words.data)
    prints = [words.hashes()] + [C.fingerprints(values, words.starts, np.minimum(words.starts + n, words.ends)) for n in HEADS]
    rows = np.stack([C.mix(p + np.uint64(k)) % np.uint64(ROWS - 1) for k, p in enumerate(prints)], axis=1).astype(np.int64) + 1
    tail = max(WIDTHS)
    starts = words.bounds[:-1] + tail * np.arange(len(words.bounds) - 1)
    out = np.full((len(rows) + tail * len(starts), KINDS), PAD, np.int64)
    text = np.repeat(np.arange(len(starts)), np.diff(words.bounds))
    out[np.arange(len(rows)) + tail * text] = rows
    return out, starts


class Model:
    """Embeddings, filters (by width), their biases and the logistic layer."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.words = draw.normal(0, 0.05, (ROWS, WIDE)).astype(np.float32)
        self.words[PAD] = 0
        self.filters = [draw.normal(0, 0.1, (w, WIDE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, :KINDS, : FILTERS // 2] += 1.0 / len(f) / KINDS
        self.out = draw.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        for i, w in enumerate(WIDTHS):
            self.out[i * FILTERS : i * FILTERS + FILTERS // 2] = 0.3 / w
        self.bias = np.float32(0)
        self.constant: float | None = None

    def vectors(self, tokens: np.ndarray) -> np.ndarray:
        """A vector for each token, and some of padding behind the last."""
        out = np.zeros((len(tokens) + max(WIDTHS), WIDE), np.float32)
        for k in range(KINDS):
            out[: len(tokens)] += self.words[tokens[:, k]]
        return out

    def scores(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        vectors, pooled = self.vectors(tokens), []
        for f in self.filters:
            value = sum(vectors[j : j + len(tokens)] @ f[j] for j in range(len(f)))
            pooled.append(np.maximum.reduceat(value, starts, axis=0))
        z = np.concatenate(pooled, axis=1) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def beginning(good: np.ndarray, bad: np.ndarray, seen: np.ndarray, n_good: int, n_bad: int, seed: int = 5) -> Model:
    """The model before training: ``good`` and ``bad`` rows that hold each hashed row, ``seen`` rows that hold it by kind."""
    model = Model(seed)
    share = (n_bad + 1) / (n_good + n_bad + 2)
    if not n_good or not n_bad:
        model.constant = share
        return model
    odds = np.log((bad + 2.0) / (n_bad + 4.0)) - np.log((good + 2.0 * n_good / n_bad) / (n_good + 4.0 * n_good / n_bad))
    for kind in range(KINDS):
        mine = seen[kind] > 0
        model.words[mine, kind] = odds[mine]
    model.words[PAD] = 0
    model.bias = np.float32(np.log(share / (1 - share)) - 1.0)
    return model


def memory_of(model: Model) -> dict[str, np.ndarray]:
    """Sums of squared gradients before training."""
    memory: dict[str, np.ndarray] = {"words": np.full((ROWS, WIDE), 1e-3), "out": np.full(len(model.out), 1e-3), "bias": np.array(1e-3)}
    return memory | {f"f{i}": np.full(f.shape, 1e-3) for i, f in enumerate(model.filters)}


def steps(model: Model, memory: dict[str, np.ndarray], touched: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, draw: np.random.Generator) -> None:
    """One pass over token rows of texts (each with its padding), which changes ``model``, ``memory`` and ``touched``."""
    order = draw.permutation(len(texts))
    for low in range(0, len(order), 32):
        pick = order[low : low + 32]
        sizes = np.array([len(texts[i]) for i in pick])
        tokens, starts = np.concatenate([texts[i] for i in pick]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ahead = np.concatenate([tokens, np.zeros((max(WIDTHS), KINDS), np.int64)])
        vectors = model.vectors(tokens)
        pooled, places = [], []
        for f in model.filters:
            value = sum(vectors[j : j + len(tokens)] @ f[j] for j in range(len(f)))
            best = np.stack([a + value[a : a + n].argmax(axis=0) for a, n in zip(starts, sizes, strict=True)])
            places.append(best)
            pooled.append(np.take_along_axis(value, best, axis=0))
        h = np.concatenate(pooled, axis=1)
        p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30)))
        error = ((p - labels[pick]) / len(pick)).astype(np.float32)
        down = error[:, None] * model.out[None, :]
        grow = {"out": h.T @ error + 1e-4 * model.out, "bias": error.sum()}
        rows, parts = [], []
        for i, f in enumerate(model.filters):
            g, at = down[:, i * FILTERS : (i + 1) * FILTERS], places[i]
            own = np.zeros_like(f)
            for j in range(len(f)):
                own[j] = np.einsum("df,dfe->ef", g, vectors[at + j])
                step = (g[:, :, None] * f[j].T[None, :, :]).reshape(-1, WIDE)
                for kind in range(KINDS):
                    rows.append(ahead[at + j, kind].ravel())
                    parts.append(step)
            grow[f"f{i}"] = own
        met, inverse, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        touched[met] += often
        change = np.zeros((len(met), WIDE), np.float32)
        np.add.at(change, inverse, np.concatenate(parts))
        memory["words"][met] += change**2
        model.words[met] -= 0.05 * change / np.sqrt(memory["words"][met])
        model.words[PAD] = 0
        for name, g in grow.items():
            memory[name] += g**2
            step = (0.05 * g / np.sqrt(memory[name])).astype(np.float32)
            if name == "out":
                model.out -= step
            elif name == "bias":
                model.bias -= step
            else:
                model.filters[int(name[1:])] -= step


def packed(model: Model, memory: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows, the rest), each with its memory."""
    rest = [model.out, np.atleast_1d(model.bias), *[f.ravel() for f in model.filters]]
    kept = [memory["out"], np.atleast_1d(memory["bias"]), *[memory[f"f{i}"].ravel() for i in range(len(model.filters))]]
    return np.concatenate([model.words, memory["words"]], axis=1), np.concatenate([*rest, *kept]).astype(np.float64)


def unpacked(model: Model, memory: dict[str, np.ndarray], words: np.ndarray, rest: np.ndarray) -> None:
    model.words, memory["words"] = words[:, :WIDE].astype(np.float32), words[:, WIDE:].copy()
    values, kept = np.split(rest, 2)
    sizes = np.cumsum([len(model.out), 1, *[f.size for f in model.filters]])[:-1]
    out, bias, *filters = np.split(values, sizes)
    model.out, model.bias = out.astype(np.float32), np.float32(bias[0])
    model.filters = [f.reshape(old.shape).astype(np.float32) for f, old in zip(filters, model.filters, strict=True)]
    memory["out"], bias, *filters = np.split(kept, sizes)
    memory["bias"] = bias[0]
    for i, f in enumerate(filters):
        memory[f"f{i}"] = f.reshape(model.filters[i].shape)


def best_threshold(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the highest F1 from counts by score in steps of 1 / ``GRID``, 0.5 where it cannot be told."""
    if not good.sum() or not bad.sum():
        return 0.5
    order = np.argsort(-steps)
    hit, taken = np.cumsum(bad[order]), np.cumsum((good + bad)[order])
    return float(steps[order[int(np.argmax(2 * hit / (taken + bad.sum())))]] / GRID)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(label, lang, spare, tokens) of every labelled document outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.where((F.crc32(F.col("l_id").cast("string")) % folds != held) & F.col("label").isin(0, 1))

    def run(batches):
        for batch in batches:
            offsets, data = C.text_buffers(batch.column(2))
            found = []
            for low, high in C.pieces(offsets):
                tokens, starts = padded_tokens(offsets[low : high + 1], data[offsets[low] : offsets[high]])
                found += [t.tobytes() for t in np.split(tokens.astype(np.uint16), starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "lang", "tokens"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    text = text.where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    rows = text.mapInArrow(run, "doc_id long, lang string, tokens binary").join(known.hint("merge"), F.col("doc_id") == F.col("l_id"))
    return saved(rows.select("label", "lang", (F.pmod("doc_id", F.lit(5)) == 1).alias("spare"), "tokens"))


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64).reshape(-1, KINDS) for x in column.to_pylist()]


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the value vectors of each block."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, np.float64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "data"])

    table = saved(parts.repartition("block").mapInArrow(run, "block int, data binary"))  # shuffle files of a pass go with it
    found = {r["block"]: np.frombuffer(r["data"], np.float64) for r in table.collect()}
    C.drop_table(table)
    return found


def _blocks(rows: np.ndarray, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the model that are not all 0, in blocks, and the rest as block -1."""
    parts = {-1: rest}
    for i in range(0, len(rows), BLOCK):
        if rows[i : i + BLOCK].any():
            parts[i // BLOCK] = rows[i : i + BLOCK]
    data = [np.ascontiguousarray(x, np.float64).tobytes() for x in parts.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def _rows_of(blocks: dict[int, np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((ROWS, width))
    for block, data in blocks.items():
        if block >= 0:
            out[block * BLOCK : (block + 1) * BLOCK] = data.reshape(-1, width)
    return out


def train(rows: DataFrame, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Fit on every row of ``rows`` (label, tokens)."""
    context = rows.sparkSession.sparkContext

    def counted(batches):
        counts, size = np.zeros((ROWS, 2 + KINDS)), np.zeros(2)
        for batch in batches:
            for tokens, label in zip(_texts(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                counts[np.unique(tokens), label] += 1
                size[label] += 1
                for kind in range(KINDS):
                    counts[tokens[:, kind], 2 + kind] = 1
        yield from _blocks(counts, size)

    given = rows.select("label", "tokens")
    blocks = _added(given.mapInArrow(counted, "block int, data binary"))
    n_good, n_bad = (int(x) for x in blocks.get(-1, np.zeros(2)))
    counts = _rows_of(blocks, 2 + KINDS)
    model = beginning(counts[:, 0], counts[:, 1], counts[:, 2:].T, n_good, n_bad, seed)
    if model.constant is not None:
        return model
    memory = memory_of(model)
    given = given.coalesce(max(1, (n_good + n_bad) // SLICE))
    for turn in range(epochs):
        shared = context.broadcast((model, memory))

        def one(batches, shared=shared, turn=turn):
            before, kept = shared.value
            words, rest = packed(before, kept)
            mine, own = Model(seed), {}
            unpacked(mine, own, words, rest)
            touched, n, draw = np.zeros(ROWS), 0, np.random.default_rng([seed, turn])
            for batch in batches:
                texts = _texts(batch.column(1))
                steps(mine, own, touched, texts, batch.column(0).to_numpy().astype(np.int64), draw)
                n += len(texts)
            new_words, new_rest = packed(mine, own)
            change = np.concatenate([(new_words - words) * touched[:, None], touched[:, None]], axis=1)
            yield from _blocks(change, np.append((new_rest - rest) * n, n))

        blocks = _added(given.mapInArrow(one, "block int, data binary"))
        words, rest = packed(model, memory)
        change, other = _rows_of(blocks, 2 * WIDE + 1), blocks[-1]
        words = words + change[:, :-1] / np.maximum(change[:, -1:], 1)
        unpacked(model, memory, words, rest + other[:-1] / other[-1])
        shared.unpersist()
    return model


def calibrated(rows: DataFrame, model: Model) -> dict[str | None, float]:
    """The threshold of each language from every row of ``rows`` (None: all together)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(2))
            starts = np.cumsum([0, *[len(t) for t in texts[:-1]]])
            scores = shared.value.scores(np.concatenate(texts), starts) if texts else np.zeros(0)
            step = np.floor(scores * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(step)], ["label", "lang", "step"])

    found = rows.select("label", "lang", "tokens").mapInArrow(run, "label int, lang string, step long")
    bars = found.groupBy("lang", "step").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()

    def cut(bars):
        bad, n = np.array([r["bad"] for r in bars], np.int64), np.array([r["n"] for r in bars], np.int64)
        return best_threshold(np.array([r["step"] for r in bars], np.int64), n - bad, bad)

    cuts: dict[str | None, float] = {None: cut(bars)}
    for lang in {r["lang"] for r in bars} - {None}:
        mine = [r for r in bars if r["lang"] == lang]
        cuts[lang] = cut(mine) if sum(r["bad"] for r in mine) >= 10 else cuts[None]
    return cuts


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> tuple[Model, dict[str | None, float]]:
    """The model and a threshold for each language (None: all together)."""
    rows = training_rows(docs, labels, folds, held)
    model, cuts = train(rows), calibrated(rows.where("spare"), train(rows.where("NOT spare")))
    C.drop_table(rows)
    return model, cuts


def score(docs: DataFrame, model: Model, cuts: dict[str | None, float]) -> DataFrame:
    """doc_id, score, predicted, flagged for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, cuts))

    def run(batches):
        model, cuts = shared.value
        for batch in batches:
            offsets, data = C.text_buffers(batch.column(2))
            found = [np.zeros(0)]
            for low, high in C.pieces(offsets):
                found.append(model.scores(*padded_tokens(offsets[low : high + 1], data[offsets[low] : offsets[high]])))
            scores = np.concatenate(found)
            cut = np.array([cuts.get(x, cuts[None]) for x in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(scores >= cut)], ["doc_id", "score", "predicted", "flagged"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, flagged boolean")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores of every document by a model that never saw the held-out fold."""
    out = score(docs, *fit(docs, labels, folds, held))
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)))
