"""Vector codes and graph search: brute force, bounds that never change a result, recall, edge cases."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from abundia.llm import graph_search as G
from abundia.llm import vector_codes as V
from abundia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = "vec_id long, embedding array<float>, label int, x string, error string, shard int, node int, codes int"


def vectors(spark, rows):
    """Rows (id, vector, label) with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, v, l, "x", "e", 1, 2, 3) for i, v, l in rows], NAMES)


def brute_codes(rows, parts, entries, rounds):
    """{(id, vector): (code, error)}, label errors and codebooks by plain arrays."""
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in good) // parts)
    whole = np.zeros((len(good), parts * width), object)
    for i, r in enumerate(good):
        whole[i, : len(r[1])] = [min(max(int(np.floor(256 * float(np.float32(x)))), -V.LIMIT), V.LIMIT) for x in r[1]]
    whole = whole.reshape(len(good), parts, width)
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is not None, good[i][0] or 0, [int(x) for x in whole[i].ravel()][: len(good[i][1])]))
    books = whole[order[:entries]].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((whole[:, :, None] - books[None]) ** 2).sum(-1)
        code = np.array([[min(range(books.shape[1]), key=lambda e: (far[i, p, e], e)) for p in range(parts)] for i in range(len(good))])
        if turn < rounds:
            for p in range(parts):
                for e in set(code[:, p]):
                    mine = whole[code[:, p] == e, p]
                    books[p, e] = mine.sum(0) // len(mine)
    error = [int(sum(far[i, p, code[i, p]] for p in range(parts))) for i in range(len(good))]
    labels = {}
    for r, e in zip(good, error, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], bytes(code[i].astype(np.uint8)).hex(), error[i], labels[r[2]], digest) for i, r in enumerate(good)), key=repr)


def test_codes_match_brute_force_with_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(7, rows[5][1], 1), (7, rows[5][1], 1), (None, rows[9][1], None), (900, None, 1), (901, [1.0, None] * 4, 1)]
    rows += [(902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [1.0, 2.0, 3.0], 2), (905, [], 2), (906, [3e38] * 8, 2), (-4, [0.0] * 8, 2)]
    got = V.coded(vectors(spark, rows), parts=4, entries=16, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows, 4, 16, 3)


def test_codes_of_few_rows_and_none(spark):
    rows = [(i, [float(i), 1.0], 1) for i in range(3)]
    assert sorted((tuple(r) for r in V.coded(vectors(spark, rows), 2, 64, 2).collect()), key=repr) == brute_codes(rows, 2, 64, 2)
    assert V.coded(vectors(spark, [])).count() == 0
    assert V.coded(vectors(spark, [(1, None, 1)])).count() == 0


@pytest.mark.parametrize("spread", [1, 40])
def test_bounds_skip_scans_and_change_nothing(spread):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-4000, 4000, (12, 3))
    x = middles[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, 3))
    groups, history = V.grouped(12), [x[:12].copy()[None]]
    scanned = 0
    for turn in range(8):
        piece = V.Piece(history[-1][0], groups, V.displacements(history, groups)[:, 0], turn)
        state = piece.start(x) if turn == 0 else piece.follow(x, *state)
        code, error, bounds, stamps = state
        far = ((x[:, None] - history[-1]) ** 2).sum(-1)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
        for g, members in enumerate(groups):  # a bound holds at the round of its stamp for every entry but the assigned
            for s in np.unique(stamps[:, g]):
                rows = np.flatnonzero(stamps[:, g] == s)
                now = np.sqrt(((x[rows, None] - history[-1][0][members]) ** 2).sum(-1))
                moved = V.displacements(history, groups)[s, 0, g]
                now[members[None] == code[rows][:, None]] = np.inf
                assert (bounds[rows, g] - moved <= now.min(1)).all()
        scanned += (stamps == turn).sum() if turn else 0
        books = np.stack([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else history[-1][0][e] for e in range(12)])
        history.append(books[None])
        state = (code, bounds, stamps)
    assert scanned < 0.6 * 7 * stamps.size


def test_net_displacement_is_below_the_sum_of_drifts():
    there_and_back = [np.array([[[0, 0]]]), np.array([[[5, 0]]]), np.array([[[1, 0]]])]
    moved = V.displacements(there_and_back, [np.array([0])])[:, 0, 0]
    assert moved[0] == pytest.approx(1.0) and moved[1] == pytest.approx(4.0) and moved[2] == 0.0


def exact(rows, k, every):
    """{(query id, query vector): [(distance, id)]} of the nearest rows."""
    good = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            far = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v)]
            out[i, v] = sorted(far)[:k]
    return out


def test_neighbours_of_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(40)]  # many copies of a query's vector: ties go to smaller ids
    rows += [(1000 + i, [float(i), 1.0, 0.0], 0) for i in range(5)]  # fewer candidates than wanted, and another length
    rows += [(2000, None, 0), (2100, [0.0] * 6, 0), (2200, [float("nan")] * 6, 0), (2300, [1.0, None] * 3, 0), (2400, [], 0), (None, rows[3][1], 0), (100, rows[100][1], 0), (7, rows[8][1], 0)]
    got = G.neighbours(vectors(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {i: near for (i, _), near in exact(rows, 10, 100).items()}
    assert set(found) == set(want)
    for i, near in want.items():
        assert [(n, j) for n, j, _ in found[i]] == [(n, j) for n, (_, j) in enumerate(near, 1)]
        assert np.allclose([s for *_, s in found[i]], [d for d, _ in near], rtol=1e-12, atol=0)
    assert G.neighbours(vectors(spark, [])).count() == 0
    assert G.neighbours(vectors(spark, [(100, [1.0, 2.0], 0)])).count() == 0


def test_a_written_index_answers_other_queries_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(G, "GROWTH", 4)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(1200)]
    table = vectors(spark, rows)
    graphs = G.index(table)
    assert graphs.select("shard").distinct().count() > 4 and graphs.count() == 1200
    got = G.search(graphs, table.where("vec_id % 40 = 0"), k=5).collect()
    want = {(i, j) for (i, _), near in exact(rows, 5, 40).items() for _, j in near}
    assert len(got) == 150 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.97 * len(want)


def test_recall_of_the_query(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], 0) for r in table]
    want = {(i, j) for (i, _), near in exact(rows, 10, 100).items() for _, j in near}
    got = {(r.query_id, r.vec_id) for r in QUERIES["op13_graph_search"](spark, SF).collect()}
    assert len(got & want) >= 0.97 * len(want)


def test_a_graph_reaches_all_its_nodes():
    points = np.random.default_rng(4).normal(size=(700, 5)).astype(np.float32)
    graph = G.Graph(points).build()
    assert (graph.edges >= 0).sum(1).max() <= G.EDGES and not (graph.edges == np.arange(700)[:, None]).any()
    seen, todo = {graph.middle}, [graph.middle]
    while todo:
        for j in graph.edges[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) > 690
