"""Importance resampling towards a target distribution of hashed n-grams.

A text is lower-cased (A-Z only) and its separators are collapsed to single
spaces. One regular expression, scanned with overlapping matches, then starts at
every word: the blank before it, the word, and up to ``n`` - 1 words more, each an
inner group, with a lookahead for the blank behind. The group ends of one match are
the spans of all n-grams that start at this word; each span's CRC-32 modulo
``buckets`` is its feature.

All raw documents and all target texts are counted into the buckets. A bucket's
gain is the log ratio of the two smoothed shares, a document's weight the mean gain
of its features, and its score the weight plus a Gumbel draw seeded by its id. The
highest scores among documents of ``min_words`` words are a sample without
replacement with probabilities in proportion to exp(weight). Gains, weights and
draws are floored thousandths.

Texts are scanned once: features are written as two bytes each, counted inside
tasks, and read again for the weights. What is sent out is one gain a bucket.
Ranks come from a range partitioning by score, never from one sorted task.

Defined cases: a null text has no words; a document without features has weight 0;
a null doc_id is seeded like an empty id and ranks before every other id; rows that
repeat a doc_id are drawn each for itself, ties going to fewer features; without
target texts only the smoothing counts; an empty table gives an empty result; extra
columns are not read by ``scores`` and are kept by ``resample``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundia.llm.common import drop_table, saved
from abundia.operators.ordering import dense_positions

N = 2
BUCKETS = 10_000
MIN_WORDS = 20
#: Part of the documents that is drawn, as a percentage.
SHARE = 25
SEED = "7"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEPARATORS = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_pattern(n: int) -> str:
    """A blank, then 1 to ``n`` words; group k ends where the k-th word ends."""
    inner = ""
    for _ in range(n - 1):
        inner = rf"(?: ([^ ]++){inner})?"
    return rf" ([^ ]++){inner}(?= )"


def feature_scanner(n: int, buckets: int):
    """A function of UTF-8 bytes that gives (number of words, buckets of all n-grams)."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket is stored in two bytes")
    separators, ngrams, crc = re.compile(_SEPARATORS), regex.compile(ngram_pattern(n).encode()), zlib.crc32

    def scan(text: bytes) -> tuple[int, np.ndarray]:
        flat = b" " + separators.sub(b" ", text.translate(_LOWER)).strip(b" ") + b" "
        hashes, words = [], 0
        for match in ngrams.finditer(flat, overlapped=True):
            first, end = match.span(1)
            hashes.append(crc(flat[first:end]))
            words += 1
            for k in range(2, n + 1):
                end = match.end(k)
                if end < 0:
                    break
                hashes.append(crc(flat[first:end]))
        return words, (np.array(hashes, np.uint32) % np.uint32(buckets)).astype(np.uint16)

    return scan


def features(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """id, text, row: to id, row, n_words, n_features and the buckets as two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]):
        scan = feature_scanner(n, buckets)
        for batch in batches:
            rows = [scan((text.as_py() or "").encode()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array([words for words, _ in rows], pa.int64()),
                    pa.array([len(found) for _, found in rows], pa.int64()),
                    pa.array([found.tobytes() for _, found in rows], pa.binary()),
                ],
                ["id", "row", "n_words", "n_features", "found"],
            )

    return texts.select("id", "text", "row").mapInArrow(run, "id long, row long, n_words long, n_features long, found binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the rows and all buckets of a batch."""
    sizes = batch.column("n_features").to_numpy()
    parts = [np.frombuffer(found.as_buffer(), np.uint16) for found in batch.column("found")]
    return np.cumsum(sizes), np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: summed inside tasks, then one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "k"])

    parts = found.select("n_features", "found").mapInArrow(run, "bucket long, k long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("k").alias("k")).collect():  # ``buckets`` rows at most
        out[row.bucket] = row.k
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of every bucket."""
    s, t, k = raw.astype(float), target.astype(float), float(len(raw))
    ratio = (t + 1.0) * (s.sum() + k) / ((s + 1.0) * (t.sum() + k))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, row, n_words, n_features and weight."""
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]):
        table = sent.value
        for batch in batches:
            ends, flat = _flat(batch)
            sums = np.concatenate([[0], np.cumsum(table[flat])])
            sizes = batch.column("n_features").to_numpy()
            total = sums[ends] - sums[ends - sizes]
            mean = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            columns = [batch.column(c) for c in ("id", "row", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mean, pa.int64())], ["id", "row", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "id long, row long, n_words long, n_features long, weight long")


def gumbel(seed: str, name: str):
    """Thousandths of a Gumbel draw from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((head + 0.5) / 4294967296.0))).cast("long")


def _ranked(rows: DataFrame, share: int, min_words: int) -> DataFrame:
    """Rows (id, row, n_words, n_features, weight) with score and rank."""
    rows = saved(rows.withColumn("score", F.col("weight") + gumbel(SEED, "id")))
    fit = rows.where(F.col("n_words") >= min_words)
    drawn = share * fit.count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features"), F.col("row")]
    placed = dense_positions(fit, order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place").cast("long")).alias("rank")
    left = rows.where(F.col("n_words") < min_words).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*rows.columns, rank).union(left)


def _scored(texts: DataFrame, target: DataFrame, n: int, buckets: int, share: int, min_words: int) -> DataFrame:
    found = saved(features(texts, n, buckets))
    none = F.lit(None).cast("long")
    wanted = features(target.select(none.alias("id"), "text", none.alias("row")), n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    slim = saved(weights(found, gain))
    drop_table(found)
    return _ranked(slim, share, min_words)


def scores(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("row"))
    out = _scored(texts, target, n, buckets, share, min_words)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that are drawn, unchanged; written once, so that every row has a fixed number."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = saved(docs.select(whole, F.monotonically_increasing_id().alias("row")))
    texts = held.select(F.col("whole.doc_id").cast("long").alias("id"), F.col("whole.text").alias("text"), "row")
    drawn = _scored(texts, target, n, buckets, share, min_words).where("rank IS NOT NULL").select("row")
    return held.join(drawn, "row", "left_semi").select("whole.*")
