"""Importance resampling: spans of the scanner, brute force over edge cases, and the drawn rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest

from abundia.llm import resampling as R
from tests.llm.test_llm import EDGES, LOWER, frame

TARGET = [(1, "one two three"), (2, None), (3, "w1x1 w2x2 w3x3"), (4, "")]


def features(text, n=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def brute(rows, target):
    found = [features(t) for _, t in rows]
    raw, wanted = [0] * 10000, [0] * 10000
    for _, buckets in found:
        for b in buckets:
            raw[b] += 1
    for _, t in target:
        for b in features(t)[1]:
            wanted[b] += 1
    s, t = sum(raw), sum(wanted)
    out = []
    for (i, _), (words, buckets) in zip(rows, found, strict=True):
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in buckets]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(buckets), weight, score, None, words])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for rank, row in enumerate(fit[: 25 * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("text", ["", "one", "One-two  THREE", "a1é ü b\x00c", "x " * 50, "-- lead and trail --", "\n\t"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlapping_scan_emits_every_ngram(text, n):
    words, found = R.feature_scanner(n, 10000)(text.encode())
    assert (words, found.tolist()) == features(text, n)


def test_scores_match_brute_force_on_edges(spark):
    rows = EDGES + [(100 + i, f"w{i % 7} " * (i % 41)) for i in range(60)] + [(None, "w1 " * 30)]
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = R.scores(frame(spark, rows), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, TARGET)


def test_empty_tables(spark):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert R.scores(frame(spark, []), target).count() == 0
    rows = [(i, f"w{i} " * 25) for i in range(8)]
    none = R.scores(frame(spark, rows), target.limit(0))
    assert sorted((tuple(r) for r in none.collect()), key=repr) == brute(rows, [])


def test_resample_returns_whole_rows(spark):
    names = "doc_id long, text string, row long, id string, found string, whole string"
    rows = [(i % 30 if i % 9 else None, f"w{i % 5} " * (18 + i % 6), i, "x", "y", None) for i in range(120)]
    docs = spark.createDataFrame(rows, names)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    drawn = [tuple(r) for r in R.resample(docs, target).collect()]
    fit = sum(len(r[1].split()) >= 20 for r in rows)
    assert len(drawn) == len(set(drawn)) == fit // 4 and set(drawn) <= set(rows)
    ranked = [r for r in R.scores(docs, target).collect() if r["rank"] is not None]
    assert sorted(repr(r[0]) for r in drawn) == sorted(repr(r.doc_id) for r in ranked)
