"""Packing into length buckets that are optimal for the global histogram.

Lengths are counted over all documents, and dynamic programming over the
histogram picks the ``buckets`` boundaries with the least padding in total. Inside
a bucket, documents in seeded order fill batches of a token budget: a batch of
bucket length L holds budget // L documents, one at least.

The histogram has a bar for every distinct length: n of them need n * n / 2 tokens,
so 100,000 bars take a corpus of five thousand million. A bucket's cost is a line in
its length, so the programme walks a hull of lines and takes a few steps a bar. Ranks
inside a bucket come from counts per range of the order plus a rank inside the range,
so a bucket that holds most documents is numbered by many tasks.

Defined cases: null and empty texts have length 0 and take one padding token; a
document longer than the budget is a batch of its own, uncut; repeated rows take a
place each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundia.llm.common import WORD, saved

BUCKETS = 8
BATCH_TOKENS = 16_384
SLICE_BITS = 12


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bucket lengths, rising; the last is the greatest length. ``lengths`` rise."""
    n = len(lengths)
    upto = [0, *accumulate(counts)]
    best = [size * upto[j + 1] for j, size in enumerate(lengths)]  # one bucket for the first j + 1 lengths
    came = [[-1] * n]
    for _ in range(1, min(buckets, n)):
        now, origin = best.copy(), [-1] * n
        lines: deque[tuple[int, int, int]] = deque()  # (slope, height, i): best[i] - upto[i + 1] * size, lower hull
        for j in range(1, n):
            slope, height = -upto[j], best[j - 1]
            while len(lines) > 1:
                (s1, h1, _), (s2, h2, _) = lines[-2], lines[-1]
                if (height - h1) * (s1 - s2) >= (h2 - h1) * (s1 - slope):
                    break
                lines.pop()
            lines.append((slope, height, j - 1))
            size = lengths[j]
            while len(lines) > 1 and lines[1][0] * size + lines[1][1] < lines[0][0] * size + lines[0][1]:
                lines.popleft()
            cost = size * upto[j + 1] + lines[0][0] * size + lines[0][1]
            if cost < now[j]:
                now[j], origin[j] = cost, lines[0][2]
        came.append(origin)
        best = now
    out, j = [], n - 1
    for level in range(len(came) - 1, -1, -1):
        if level == 0 or came[level][j] >= 0:
            out.append(lengths[j])
            j = came[level][j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, seed: int = 17) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch, position, padding for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("place"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        )
    )
    held = F.greatest(F.col("n_tokens"), F.lit(1))
    bars = sorted(tuple(r) for r in rows.groupBy(held.cast("long").alias("n")).count().collect())  # a row for each distinct length
    edges = boundaries([b[0] for b in bars], [b[1] for b in bars], buckets) if bars else [1]
    bucket = F.lit(edges[-1])
    for edge in reversed(edges[:-1]):
        bucket = F.when(held <= edge, edge).otherwise(bucket)
    laid = rows.withColumn("bucket_len", bucket.cast("long")).withColumn("slice", F.shiftright("place", 64 - SLICE_BITS))
    counts = laid.groupBy("bucket_len", "slice").agg(F.count("*").alias("k"))
    before = Window.partitionBy("bucket_len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(counts.select("bucket_len", "slice", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset")))
    # at most buckets * 2 ** SLICE_BITS rows
    ranked = laid.join(F.broadcast(offsets), ["bucket_len", "slice"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(Window.partitionBy("bucket_len", "slice").orderBy("place", "doc_id", "n_tokens")) - 1
    )
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_len")), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket_len",
        F.floor(F.col("rank") / room).cast("long").alias("batch"),
        (F.col("rank") % room).cast("long").alias("position"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
