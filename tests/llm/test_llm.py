"""The training-data operators: SQL, brute force, round trips, and the edge cases each docstring defines."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundia.llm import chat, exact_dedup, lm, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, toxicity
from abundia.llm.oracles import ORACLES
from abundia.llm.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rows long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "src1", 0, "x", 1) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000))
EDGES = [
    (1, LONG), (2, LONG + " tail"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one  TWO"), (None, "one two"),
    (8, LONG), (8, LONG), (9, "a " * 300), (10, "ünï cödé " * 40), (11, "x" + LONG[:900]), (12, "y" + LONG[:900]),
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df()) == ""


def test_ngram_join_edges(spark):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.components(frame(spark, EDGES)).collect()}
    sets = {i: _shingles(t) for i, t in EDGES if i is not None}
    for (i, n), group in rows.items():
        if i is None:
            assert group is None
            continue
        assert n == len(sets[i])
        assert group == min(_reach(i, sets))
    assert ngram_join.components(frame(spark, [])).count() == 0
    assert {r.doc_id for r in ngram_join.keep_one(frame(spark, EDGES)).collect()} >= {None, 1, 3, 4, 5, 6, 9, 10}


def _shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _reach(start, sets):
    seen, todo = {start}, [start]
    while todo:
        a = sets[todo.pop()]
        for j, b in sets.items():
            if j not in seen and a and b and 100 * len(a & b) >= 80 * len(a | b):
                seen.add(j)
                todo.append(j)
    return seen


@pytest.mark.parametrize("spare", [ngram_join.SPARE, 0])
def test_ngram_join_links_texts_with_additions(spark, monkeypatch, spare):
    # a text of 100 shingles and the same with 25, 20, 14 and 9 of its own: J 0.80, 0.83, 0.87 and 0.91; 26 are too many
    monkeypatch.setattr(ngram_join, "SPARE", spare)  # 0: pivots first
    docs = []
    for k, more in enumerate([25, 20, 14, 9, 26] * 6):
        base, own = [f"p{k}b{i}" for i in range(104)], [f"p{k}o{i}" for i in range(more)]
        docs.append((2 * k, " ".join(base)))
        docs.append((2 * k + 1, " ".join(base + own if k % 2 else own + base)))
    docs += [(1000, " ".join(f"q{i}" for i in range(104))), (1001, " ".join([f"q{i}" for i in range(52)] + [f"r{i}" for i in range(12)] + [f"q{i}" for i in range(52, 104)]))]
    docs += [(1002, " ".join(f"q{i}" for i in range(10, 104)))]
    sets = {i: _shingles(t) for i, t in docs}
    got = {r.doc_id: r.component_id for r in ngram_join.components(frame(spark, docs)).collect()}
    assert got == {i: min(_reach(i, sets)) for i in sets}


@pytest.mark.parametrize("level", [50, 80, 95])
def test_first_prefix_misses_no_pair(level):
    draw = np.random.default_rng(level)
    for _ in range(300):
        n = int(draw.integers(1, 120))
        x = np.unique(draw.integers(0, 1 << 40, n, dtype=np.uint64))
        y = np.unique(np.concatenate([draw.permutation(x)[: draw.integers(n // 2, n + 1)], draw.integers(0, 1 << 40, int(draw.integers(0, 30)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= level * (len(x) + len(y) - both):
            (p, a), (q, b) = (ngram_join.first_prefix(len(s), level) for s in (x, y))
            assert len(np.intersect1d(x[:p], y[:q])) >= max(a, b)


def test_ngram_join_with_one_passage_in_half_of_the_documents(spark):
    # a passage that most of a text consists of, own words of many lengths, and chains of near copies
    draw = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(160):
        own = [f"d{i}w{j}" for j in range(int(draw.integers(0, 30)))]
        docs.append((i, " ".join(passage + own if i % 2 else [f"e{i}w{j}" for j in range(50)] + own)))
    for i in range(0, 160, 8):
        body = docs[i][1].split()
        for k in range(3):
            body = [*body, f"x{i}k{k}"]
            docs.append((1000 + 4 * i + k, " ".join(body)))
    sets = {i: _shingles(t) for i, t in docs}
    got = {r.doc_id: r.component_id for r in ngram_join.components(frame(spark, docs)).collect()}
    assert got == {i: min(_reach(i, sets)) for i in sets}


def test_ngram_join_meets_near_copies_of_one_text_at_that_text(spark, monkeypatch):
    # every copy is linked with the text alone: J 0.81 with it, 0.68 at most with another copy
    draw = np.random.default_rng(11)
    base = [f"b{i}" for i in range(154)]
    docs = [(500, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for at in draw.choice(np.arange(5, 150, 10), 3, replace=False):
            copy[at] = f"c{i}x{at}"
        docs.append((i, " ".join(copy)))
    docs += [(1000 + i, " ".join(f"o{i}w{j}" for j in range(60))) for i in range(10)]
    sets, met, plain = {i: _shingles(t) for i, t in docs}, [], ngram_join._verified

    def noted(pairs, *rest):
        met.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", noted)
    got = {r.doc_id: r.component_id for r in ngram_join.components(frame(spark, docs)).collect()}
    assert got == {i: min(_reach(i, sets)) for i in sets}
    assert sum(met) <= 2 * len(docs)


def test_parity_bits_differ_no_more_than_the_sets():
    draw = np.random.default_rng(4)
    for _ in range(200):
        x = np.unique(draw.integers(0, 1 << 63, int(draw.integers(1, 400)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[: draw.integers(0, len(x) + 1)], draw.integers(0, 1 << 63, int(draw.integers(0, 60)), dtype=np.uint64)]))
        unlike = sum(int(b).bit_count() for b in (ngram_join.parity(x) ^ ngram_join.parity(y)).view(np.uint64))
        assert unlike <= len(np.setxor1d(x, y))
        assert not (ngram_join.parity(x) ^ ngram_join.parity(x[::-1])).any()


def test_multi_match_prefix_misses_no_pair():
    draw = np.random.default_rng(3)
    counts = draw.integers(1, 50, 4000)
    for _ in range(200):
        base = draw.choice(4000, 60, replace=False).astype(np.uint64)
        other = base.copy()
        other[: draw.integers(0, 10)] = draw.choice(4000, 1)[0]
        x, y = np.unique(base), np.unique(other)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (a, p), (b, q) = (ngram_join.choose_prefix(s, counts[s.astype(int)], 80) for s in (x, y))
            assert len(np.intersect1d(p, q)) >= min(a, b)


@pytest.mark.parametrize("docs", [EDGES, []])
def test_suffix_dedup_against_brute_force(spark, docs):
    docs = [d for i, d in enumerate(docs) if d not in docs[:i]]
    got = {r.doc_id: r for r in suffix_dedup.removed(frame(spark, docs)).collect()}
    seen: set[bytes] = set()
    for i, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), int(gone.sum()), spans, kept)


def test_substring_dedup_edges(spark):
    docs = [d for i, d in enumerate(EDGES) if d not in EDGES[:i]]
    got = {r.doc_id: r for r in substring_dedup.cleaned(frame(spark, docs)).collect()}
    first: dict[tuple, int] = {}
    for i, text in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        w, gone, mine = words(text), set(), []
        for s in range(len(w) - 49):
            window = tuple(w[s : s + 50])
            if window in first:
                gone |= set(range(s, s + 50))
            mine.append(window)
        for window in mine:
            first.setdefault(window, i)
        assert got[i].n_words == len(w) and got[i].n_removed == len(gone)
        assert got[i].kept == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert substring_dedup.cleaned(frame(spark, [])).count() == 0


def test_exact_dedup_edges(spark):
    kept = exact_dedup.dedup(frame(spark, EDGES))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 12]
    large = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(frame(spark, EDGES), largest=True).collect()}
    assert large[1] == (8, 3) and large[3] == (4, 2) and large[None] == (6, 2)
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_exact_dedup_of_a_partition_of_several_batches(spark):
    # 10,000 rows go to Python at once; a group of seven equal texts lies across that line
    n = 3 * 7000
    docs = spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "concat('text ', id % 3000) AS text")
    found = exact_dedup.groups(docs, largest=True).collect()
    assert len(found) == n
    assert all((r.keep_id, r.group_size, r.kept) == (n - 3000 + r.doc_id % 3000, 7, r.doc_id >= n - 3000) for r in found)
    assert {r.doc_id for r in exact_dedup.dedup(docs).collect()} == set(range(3000))


def test_quality_base_counts_and_verdict(spark):
    junk = [(100 + i, "BUY!! NOW!! $$$ " * 30) for i in range(5)]
    clean = [(200 + i, " ".join(f"c{(i * 7 + j) % 211}" for j in range(60))) for i in range(20)]
    docs = frame(spark, [*EDGES, (13, "a b c\na b c\n\n# $ x\na b c"), *junk, *clean])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i, text in [(9, "a " * 300), (10, "ünï cödé " * 40), (13, "a b c\na b c\n\n# $ x\na b c"), (3, None)]:
        w, t = words(text), text or ""
        windows = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        twice = {p for s in range(len(w) - 7) if windows[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_rules(frame(spark, []), labels.where("false")).count() == 0


def test_quality_counts_of_repeats_at_the_edges(spark):
    eight, ten = [f"e{i}" for i in range(8)], [f"t{i}" for i in range(10)]
    texts = [
        eight, eight[:7], [*eight, *eight], [*eight, "x", *eight[:7]], [*ten[:5], "x", *ten[:5], "y", *ten[:5]], [*ten, *ten[1:], "#*$ %&|<>"],
        ["a"] * 8, ["a"] * 9, [*eight, *ten, *eight, *ten[:4]], ["ünï", "\U0001f600|", "a#b"], [],
    ]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs += [(50, "a\x0bb\x0c#\r c"), (51, "$\u00a0% \u2003x")]
    found = quality.counted(frame(spark, docs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "sequence(" not in plan  # a pass over every character, and a copy of every window
    got = {r.doc_id: r for r in found.collect()}
    for i, text in docs:
        w = words(text)
        windows = collections.Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        twice = {p for s in range(len(w) - 7) if windows[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(twice))
        assert got[i].n_symbols == sum(text.count(c) for c in "#*$%&|<>")


def test_budgets_share_shortage_with_siblings_first():
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "y"): 1000}
    assert mixing.budgets(tokens, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 50, ("b", "y"): 50}
    tokens[("a", "y")] = 20
    assert mixing.budgets(tokens, 200, {}, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 85, ("b", "y"): 85}
    assert mixing.budgets({}, 5, {}, 1) == {}


def test_mixing_takes_the_shortest_prefix(spark):
    docs = frame(spark, [(i, "t " * (1 + i % 9)) for i in range(200)] + [(None, None)])
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    for share, epochs in ((0.4, 1), (2.3, 3)):
        rows = mixing.selection(docs, levels, share, {}, epochs).collect()
        total, budget = sum(r.tokens for r in rows), rows[0].budget
        assert budget == int(share * total + 1e-6)
        spent = sum(r.tokens * r.copies for r in rows)
        assert budget <= spent < budget + 9
        assert mixing.mix(docs, levels, share, {}, epochs).count() == sum(r.copies for r in rows)
    assert mixing.mix(frame(spark, []), levels, 0.5, {}).count() == 0


def test_buckets_are_optimal_and_batches_full(spark):
    lengths, counts = [1, 3, 4, 9, 10, 30, 31], [5, 2, 7, 1, 3, 2, 2]
    best = min(
        (sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts, strict=True)), edges)
        for edges in [sorted({a, b, 31}) for a in lengths for b in lengths]
    )[0]
    edges = packing.boundaries(lengths, counts, 3)
    assert sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts, strict=True)) == best
    rows = packing.pack(frame(spark, [(i, "t " * (i % 40)) for i in range(300)] + EDGES), 4, 200).collect()
    assert len(rows) == 300 + len(EDGES)
    batches = collections.Counter((r.bucket_len, r.batch) for r in rows)
    for (length, _), n in batches.items():
        assert n * length <= 200 or n == 1
    assert len({(r.bucket_len, r.batch, r.position) for r in rows}) == len(rows)
    assert packing.pack(frame(spark, [])).count() == 0


def test_one_long_text_leaves_the_buckets_of_short_ones_optimal(spark):
    sizes = [1 + i % 7 + 5 * (i % 3) for i in range(90)] + [20_000]
    rows = packing.pack(frame(spark, [(i, "t " * n) for i, n in enumerate(sizes)]), 4, 200).collect()
    known = sorted(set(sizes))
    best = min(sum(min(e for e in (*edges, 20_000) if e >= n) - n for n in sizes) for edges in itertools.combinations(known, 3))
    assert sum(r.padding for r in rows) == best


def test_boundaries_match_brute_force():
    draw = np.random.default_rng(5)
    for _ in range(200):
        lengths = sorted({int(x) for x in draw.integers(1, 10 ** int(draw.integers(1, 7)), 9)})
        counts = [int(x) for x in draw.integers(1, 10 ** int(draw.integers(1, 6)), len(lengths))]
        padding = lambda edges: sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts, strict=True))
        for buckets in (1, 2, 3, 4, 20):
            some = min(buckets, len(lengths)) - 1
            best = min(padding((*edges, lengths[-1])) for edges in itertools.combinations(lengths, some))
            edges = packing.boundaries(lengths, counts, buckets)
            assert len(edges) <= buckets and edges == sorted(set(edges)) and padding(edges) == best


def test_lm_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    tokens = {r.doc_id: [*words((r.text or "").translate(LOWER)), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    total, distinct = sum(c.values()), len(c)
    for i, ts in tokens.items():
        base = sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in ts)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ts), sum(c[t] > 0 for t in ts), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    assert sum(got[i].score for i in tokens if held[i]) > sum(got[i].base_score for i in tokens if held[i])
    edges = {r.doc_id: r.n_tokens for r in lm.scored(frame(spark, EDGES)).collect()}
    assert edges[3] == edges[4] == 1 and edges[6] == 3
    assert lm.scored(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard,dictionary,chunk", [(1 << 20, 1 << 20, 1 << 21), (200, 40, 300)])
def test_lm_keeps_every_word_pair_and_triple(spark, monkeypatch, shard, dictionary, chunk):
    for name, value in (("SHARD", shard), ("DICTIONARY", dictionary), ("CHUNK", chunk)):
        monkeypatch.setattr(lm, name, value)
    draw = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{int(x)}" for x in draw.zipf(1.3, 40) % 300)) for i in range(60)]
    docs += [(60, docs[0][1]), (60, docs[0][1]), (61, None), (None, "W1 w2 w9999"), *[(i, f"only{i} w1 w1 w1 w1") for i in range(70, 76)]]
    tokens = [["<s>", *words((t or "").translate(LOWER)), "</s>"] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    assert any(held)
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for seq, out in zip(tokens, held, strict=True):
        if not out:
            one.update(seq[1:])
            two.update(itertools.pairwise(seq))
            three.update(zip(seq, seq[1:], seq[2:], strict=False))
    follow = collections.defaultdict(list)
    for counts in (two, three):
        for key, c in counts.items():
            follow[key[:-1]].append(c)

    def probability(context, w):
        if not context:
            return (one[w] + 1) / (sum(one.values()) + len(one) + 1)
        lower, after = probability(context[1:], w), follow.get(context, [])
        c = (two if len(context) == 1 else three)[(*context, w)]
        return (max(c - 0.75, 0) + 0.75 * len(after) * lower) / sum(after) if after else lower

    want = {}
    for (i, _), seq in zip(docs, tokens, strict=True):
        want[i] = sum(math.log10(probability(tuple(seq[max(0, k - 2) : k]), seq[k])) for k in range(1, len(seq)))
    rows = lm.scored(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)


def test_lm_sends_a_pair_to_the_shards_that_hold_it(spark, monkeypatch):
    for name, value in (("SHARD", 200), ("DICTIONARY", 40), ("CHUNK", 300)):
        monkeypatch.setattr(lm, name, value)
    seen, plain = [], lm._extra

    def noted(rows, rare, table, shards, chunk):
        out = plain(rows, rare, table, shards, chunk)
        seen.append((len(shards.homes()), out.where(f"kind = {lm.PAIR}").select("shard", "v", "w").collect()))
        return out

    monkeypatch.setattr(lm, "_extra", noted)
    # the frequent word stands before one other word in all texts, and before a word of its own in each
    lm.scored(frame(spark, [(i, f"hot common hot own{i} end{i} " * 3) for i in range(80)])).count()
    (homes, sent), = seen
    assert homes > 4 and len(sent) == len(set(sent))
    places = collections.Counter((r.v, r.w) for r in sent)
    assert 0 < len(places) < 80 and min(places.values()) > 1  # what one shard alone holds is counted there


def test_lm_pairs_in_most_shards_are_in_a_file(spark, monkeypatch):
    for name, value in (("SHARD", 200), ("DICTIONARY", 40), ("CHUNK", 300)):
        monkeypatch.setattr(lm, name, value)
    seen, plain = [], lm._extra

    def noted(rows, rare, table, shards, chunk):
        out = plain(rows, rare, table, shards, chunk)
        listed = lm.Dictionary(lm.SparkFiles.get(shards.listed[0]), shards.listed[1]) if shards.listed else None
        seen.append((listed, out.where(f"kind = {lm.PAIR}").select("shard", "v", "w").collect()))
        return out

    monkeypatch.setattr(lm, "_extra", noted)
    # 24 frequent words; each pair of them is in many shards, since many words stand before it
    docs = [(i, f"a{i} b{i % 12} c{i % 2} d{i % 7} b{i * 5 % 12} c{i // 2 % 2} d{i % 5} " * 3) for i in range(300)]
    assert lm.scored(frame(spark, docs)).count() == 300
    (listed, sent), = seen
    assert listed is not None and 0 < len(listed.words) <= 40
    places = collections.Counter((r.v, r.w) for r in sent)
    u64 = lambda x: np.array([x], np.int64).view(np.uint64)
    assert not any(listed.look_up(lm._pair(u64(v), u64(w)))[0][0] for v, w in places)
    monkeypatch.setattr(lm, "DICTIONARY", 1 << 20)
    seen.clear()
    lm.scored(frame(spark, docs)).count()
    (none, every), = seen
    before = collections.Counter((r.v, r.w) for r in every)
    assert none is None and len(before) == len(places) + len(listed.words)
    assert max(places.values(), default=0) < min(n for pair, n in before.items() if pair not in places)
    assert len(sent) < len(every) / 2


def test_lm_keys_travel_once_for_a_chunk(spark):
    docs = frame(spark, [(i, f"w{i % 9} w{i % 4} w{i % 7} w{i % 3} " * 5) for i in range(400)]).coalesce(1)
    rows = lm._rows(docs, 7, 2)
    none = np.zeros(0, np.uint64)
    name, header = lm.shipped(spark, none, none)
    blocks = rows.select("key", "held_out", "text").mapInArrow(lm._blocks(lm.Shards(30, none, none), 0, 1, 1 << 21, name, header), lm.BLOCK).collect()
    assert len(blocks) > 5 and len({r.chunk for r in blocks}) == 1
    parts = [lm._unpacked(r.data) for r in blocks]
    assert sum(len(p[-1]) for p in parts) == 8 * 400
    assert sorted({int(x) for p in parts for x in lm._places(p[7])}) == list(range(400))


def test_lm_numbers_and_blocks_come_back():
    draw = np.random.default_rng(3)
    for top, width in ((200, 1), (60_000, 2), (10**9, 4)):
        numbers = np.append(draw.integers(0, top, 300), top)
        data = lm._narrow(numbers)
        assert len(data) == 1 + width * 301 and lm._wide(data).tolist() == numbers.tolist()
    assert lm._wide(lm._narrow(np.zeros(0, np.int64))).tolist() == []
    for parts in ([b"", b"abc", b""], [b""], [bytes(1000), draw.bytes(100)]):
        assert lm._unpacked(lm._packed(parts)) == parts


def test_lm_places_of_words_come_back_from_their_steps():
    draw = np.random.default_rng(2)
    for top, n, width in ((1 << 16, 500, 2), (1 << 20, 400, 2), (1 << 20, 3, 4), (10, 0, 2)):
        places = np.unique(draw.integers(0, top, n)) if n != 3 else np.array([5, 6, 900_000])
        data = lm._steps(places)
        assert len(data) == 1 + width * len(places)
        assert lm._places(data).tolist() == places.tolist()


def test_elias_fano_finds_and_accesses():
    draw = np.random.default_rng(1)
    for top in (10, 5000, 10**9, 10**13):
        values = np.unique(draw.integers(0, top, 3000))
        one = lm.EliasFano.of(lm.EliasFano.arrays(values))
        assert (one.access(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, draw.integers(0, 2 * top, 3000)])
        want = {v: i for i, v in enumerate(values.tolist())}
        assert one.find(asked).tolist() == [want.get(v, -1) for v in asked.tolist()]


def test_toxicity_learns_and_scores_edges(spark):
    draw = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(300):
        w = [f"n{x}" for x in draw.integers(0, 200, 40)]
        bad = i % 4 == 0
        rows.append((1000 + i, " ".join([*w[:20], "scum" if bad else "nice", *w[20:]])))
        labels.append((1000 + i, 1, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows + EDGES), marks).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(frame(spark, []), marks).count() == 0
    assert toxicity.toxicity(frame(spark, EDGES), marks.where("false")).count() == len(EDGES)


def test_toxicity_counts_and_trains_on_every_labelled_row(spark, monkeypatch):
    # more rows of a class than the 4,000 that were once drawn; one of them alone holds a word
    rows = [(i, f"w{i % 50} " + ("scum" if i % 2 else "nice") + (f" single{i}" if i % 400 == 7 else "")) for i in range(9000)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    seen = {}
    plain = toxicity.beginning

    def noted(good, bad, kinds, n_good, n_bad, seed=5):
        seen.setdefault("sizes", []).append((n_good, n_bad))
        seen.setdefault("bad", []).append(bad)
        return plain(good, bad, kinds, n_good, n_bad, seed)

    monkeypatch.setattr(toxicity, "beginning", noted)
    model, cuts = toxicity.fit(frame(spark, rows), marks)
    taken = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    assert seen["sizes"][0] == (sum(i % 2 == 0 for i in taken), sum(i % 2 for i in taken))
    data = np.frombuffer(b"scum", np.uint8)
    assert seen["bad"][0][toxicity.padded_tokens(np.array([0, 4]), data)[0][0, 0]] == sum(i % 2 for i in taken)
    for i in (j for j in taken if j % 400 == 7):
        word = np.frombuffer(f"single{i}".encode(), np.uint8)
        assert seen["bad"][0][toxicity.padded_tokens(np.array([0, len(word)]), word)[0][0, 0]] >= 1
    assert set(cuts) == {None, "en"} and model.constant is None


def test_templates():
    text, spans = chat.rendered(chat.TEMPLATE, [("user", "</s>[INST] ok"), ("assistant", "a\\.b <s>")])
    assert chat.turns_of(text) == [("user", "</s>[INST] ok"), ("assistant", "a\\.b <s>")]
    assert [chat.unescape(text[a:b]) for a, b in spans] == ["a\\.b <s>"]
    assert chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}no{% else %}d{% endif %}")) == [("emit", ("const", "abCd"))]
    for bad in ("{{ message.__class__ }}", "{{ open }}", "{% import os %}", "{% if true %}", "{{ 'a' | eval }}", "{{ message.text() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None, "z"), (1, 0, "user", "hi", "z"), (None, None, None, "x", "z"), (1, 1, "assistant", "b", "z")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(talk)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\nb\n").hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.read_back(chat.formatted(talk.where("false"))).count() == 0


def test_pipeline_keeps_columns_and_ends_packed(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns
        docs = exact_dedup.saved(kept)
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == ids


CLASHING = [
    "row", "id", "digest", "check", "size", "keep", "rows", "part", "slice", "__digest", "__check", "__size", "__keep", "gone_id",
    "gone_key", "text_key", "kept", "llr", "bucket", "weight", "hashes", "lines", "words", "n_words", "node", "root", "doc", "token",
    "a", "b", "n", "l", "rep", "group", "label", "component_id", "keep_id", "tokens", "leaf", "l0", "l1", "l2", "epoch", "draw", "taken",
]


@pytest.mark.parametrize("step", ["quality", "exact", "near", "mixing"])
def test_stages_leave_columns_with_their_own_names_alone(spark, step):
    """A column of the input may carry any name that an operator uses inside, and comes out unchanged."""
    texts = [(i, f"alpha beta gamma delta {i} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(6)]
    texts += [(6, texts[0][1]), (7, "one two"), (8, None), (None, "one two three")]
    plain = spark.createDataFrame([(i, t, "en", "src1") for i, t in texts], "doc_id long, text string, lang string, source string")
    extra = {name: F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in CLASHING}
    docs = plain.withColumns(extra)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    stage = {
        "quality": lambda d: quality.keep_good(d, labels),
        "exact": exact_dedup.dedup,
        "near": ngram_join.keep_one,
        "mixing": lambda d: mixing.mix(d, levels, 0.9, {}),
    }[step]
    got, want = stage(docs), stage(plain)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in want.collect())
    for r in rows:
        assert all(r[name] == f"{name}-{'none' if r.doc_id is None else r.doc_id}" for name in CLASHING)


def test_toxicity_leaves_no_shuffle_files_of_its_passes(spark, monkeypatch):
    """What a pass sends is gone when the next one starts, and the labels meet the texts alike at every size."""
    rows = [(i, ("bad worse " if i % 2 else "good better ") + f"w{i}") for i in range(1, 60)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    written, plain = [], toxicity.saved

    def noted(df):
        written.append(df._jdf.queryExecution().toString())
        return plain(df)

    monkeypatch.setattr(toxicity, "saved", noted)
    toxicity.train(toxicity.training_rows(frame(spark, rows), marks), epochs=2)
    assert len(written) == 4  # the rows, the counts and two passes
    assert "SortMergeJoin" in written[0] and "BroadcastHashJoin" not in written[0]
    assert all("REPARTITION_BY_COL" in plan for plan in written[1:])


def test_pipeline_leaves_only_what_is_still_read(spark, monkeypatch):
    """Scratch tables of a stage, and the documents of the stage before, are gone when its own are written."""
    import corpus_pipeline
    from abundia.sources import scratch

    written, plain = [], scratch.saved

    def noted(df):
        out = plain(df)
        written.append(out.inputFiles())
        return out

    monkeypatch.setattr(scratch, "saved", noted)
    out = corpus_pipeline.run(spark, SF)
    path = spark._jvm.org.apache.hadoop.fs.Path

    def there(name):
        return path(name).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(name))

    assert out.count() > 0 and len(written) > 15
    before_packing = [files for files in written if files and set(files) & set(out.inputFiles())]
    assert before_packing and all(there(f) for files in before_packing for f in files)
    left = sum(any(there(f) for f in files) for files in written)
    assert left <= 3  # the mixed documents and packing's own tables
    assert there(f"file://{SF}/documents.parquet")


def test_ngram_join_keeps_no_prefix_that_nothing_reads(spark, monkeypatch):
    wide, seen = [], []
    save, count = ngram_join.saved, ngram_join._frequencies

    def saved(df):
        out = save(df)
        wide.extend(out.inputFiles() if "prefix" in out.columns else [])
        return out

    def frequencies(sets, level):
        seen.append([f for f in wide if os.path.exists(f.removeprefix("file://"))])
        return count(sets, level)

    monkeypatch.setattr(ngram_join, "saved", saved)
    monkeypatch.setattr(ngram_join, "_frequencies", frequencies)
    assert ngram_join.components(frame(spark, EDGES)).count() == len(EDGES)
    assert wide and seen == [[]]


def test_ngram_join_with_several_texts_of_one_doc_id(spark):
    # 1 and 5 are linked by one text of 1 each, 9 hangs on the other text of 1 by way of copies
    texts = [" ".join(f"{p}{i}" for i in range(60)) for p in "abc"]
    docs = [(1, texts[0]), (1, texts[1]), (5, texts[0] + " more"), (9, texts[1] + " more"), (9, texts[1] + " more"), (7, texts[2]), (7, texts[2] + " x")]
    assert {r.doc_id: r.component_id for r in ngram_join.components(frame(spark, docs)).collect()} == {1: 1, 5: 1, 9: 1, 7: 7}
