import math

import numpy as np
import pyarrow as pa
from batchloom.llm import embedding_dedup as E
from batchloom.llm.queries import ORACLES, QUERIES
from tests.helpers import same_as_oracle


def brute(rows):
    out, usable = {}, {}
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable[i] = (np.array(v, float) / np.linalg.norm(v), label) if ok else None
    links = {i: [j for j, b in usable.items() if a and b and i != j and a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] >= E.LEAST] for i, a in usable.items()}
    for i in usable:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(seen, key=lambda x: (x is None, x))
        out[i] = (len(links[i]), root, root == i)
    return out


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 16))
    rows = [(i, base[i].tolist(), int(i % 5 == 0)) for i in range(700)]
    hub = rng.normal(size=16)
    rows += [(1000 + i, (hub + 0.22 * rng.normal(size=16)).tolist(), 0) for i in range(300)]  # a dense group around the threshold
    rows += [(2000 + i, (base[3 * i] + 0.05 * rng.normal(size=16)).tolist(), int(3 * i % 5 == 0)) for i in range(100)]
    rows += [(3000 + i, base[1].tolist(), 0) for i in range(40)]
    rows += [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 16, 0), (4003, [math.nan] * 16, 0), (4004, [math.inf] + [1.0] * 15, 0), (4005, [None] + [1.0] * 15, 0), (4006, base[1].tolist(), None), (4007, [1.0, 2.0], 0), (4008, [1.0, 2.001], 0)]
    return rows


def test_links_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "'x' AS grp", "2 AS n_links")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows])
    assert got == want
    assert max(n for n, _, _ in want.values()) > 100
    same_as_oracle(spark, QUERIES["op6_embedding_graph"], ORACLES["op6_embedding_graph"])


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert E.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = E.near_vectors(spark.createDataFrame([(None, [1.0], 1), (5, [1.0], 1), (5, [1.0], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (5, 1, 5, True), (5, 1, 5, True)]


def adjacency(x):
    """The graph on rows in both directions, as a matrix filled up with -1."""
    to = [set() for _ in x]
    for i, near in enumerate(E.robust_graph(x)):
        assert len(near) <= E.DEGREE
        for j in near.tolist():
            to[i].add(j)
            to[j].add(i)
    near = np.full((len(x), max(map(len, to))), -1)
    for i, some in enumerate(to):
        near[i, : len(some)] = sorted(some)
    return near


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_search_meets_what_is_in_range():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 8))
    x[100:] = x[:100] + 0.08 * rng.normal(size=(100, 8))
    x = unit(x)
    q, v, _, _ = E.walk(x, np.full(200, -1), [np.zeros(0, np.int64)] * 200, x, adjacency(x), 48, E.SLACK)
    pairs = set(zip(q.tolist(), v.tolist(), strict=True))
    want = set(zip(*(p.tolist() for p in np.nonzero(x @ x.T >= E.LEAST)), strict=True))
    assert pairs <= want and len(pairs) >= 0.97 * len(want)


def test_a_walk_meets_a_small_part_of_a_cell():
    rng = np.random.default_rng(2)
    n = E.SHARD
    x = rng.normal(size=(n, 64))
    x[: n // 8] = x[n // 8 : n // 4] + 0.1 * rng.normal(size=(n // 8, 64))
    x = unit(x)
    at = rng.permutation(n)
    x = x[at]
    near = np.concatenate([np.argpartition(-(x[k : k + 512] @ x.T), 17, axis=1)[:, :18] for k in range(0, n, 512)])
    asks = rng.choice(n, 256, replace=False)
    q, v, met, lost = E.walk(x[asks], asks, [np.zeros(0, np.int64)] * 256, x, near, E.BEAM, E.SLACK)
    assert met < 0.1 * 256 * n and lost < 256
    want = np.nonzero(x[asks] @ x.T >= E.LEAST)
    assert set(zip(q.tolist(), v.tolist(), strict=True)) == set(zip(*(p.tolist() for p in want), strict=True))


def test_every_cell_within_the_margin():
    c = [[math.cos(t), math.sin(t)] for t in (-0.2, -0.1, 0.0, 0.1, 0.2, 1.5)]
    rows = pa.table({"grp": ["g"] * 7, "cell": [""] * 7, "side": [0] * 6 + [1], "home": [True] * 7, "id": pa.array([0] * 6 + [9], pa.int64()), "v": [*c, [1.0, 0.0]]})
    got = E.assign(rows, [(0, 7)], E.MARGIN).to_pylist()
    assert {r["cell"] for r in got} == {f"/{k}" for k in range(5)} and [r["cell"] for r in got if r["home"]] == ["/2"]
    assert {r["cell"] for r in E.assign(rows, [(0, 7)], None).to_pylist()} <= {"/1", "/2", "/3"}


def test_labels_of_several_cells_equal_brute_force(spark, monkeypatch):
    for name, value in {"SHARD": 60, "BUILD": 24, "FAN": 8, "QUERIES": 16, "MARGIN": 0.05, "SLICE": 50}.items():
        monkeypatch.setattr(E, name, value)
    rows = [r for r in vectors() if not 1150 <= r[0] < 2000 and r[0] < 3005]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}
    assert got == brute([(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows])


def test_searches_follow_edges_into_other_cells():
    v = [[1.0, 0.0], [math.cos(0.15), math.sin(0.15)]]

    def rows(cell, kind, query, home, cells, entries):
        types = {"id": pa.int64(), "m": pa.int64(), "kind": pa.int32(), "near": pa.list_(pa.int64()), "cells": pa.list_(pa.string()), "entries": pa.list_(pa.int64())}
        data = {"grp": ["g"] * 2, "cell": [cell] * 2, "kind": kind, "query": query, "home": home, "id": [1, 2], "m": [1, 3], "v": v, "near": [[2], [1]], "cells": cells, "home_cell": ["A", "B"], "entries": entries}
        return pa.table({k: pa.array(x, types.get(k)) for k, x in data.items()})

    work = E.searcher(E.BEAM, E.SLACK)
    a = work(rows("A", [0, 0], [True, True], [True, False], [["A"], ["A", "B"]], [None, None]), [(0, 2)]).to_pylist()
    assert [(r["id"], r["n"], r["root"], r["go"]) for r in a] == [(1, 0, 1, [{"cell": "B", "entry": 2}]), (2, 1, 1, [])]
    b = work(rows("B", [1, 0], [True, False], [False, True], [["A", "B"], ["A", "B"]], [[2], None]), [(0, 2)]).to_pylist()
    assert sorted((r["id"], r["n"], r["root"], len(r["go"])) for r in b) == [(1, 3, 1, 0), (2, 0, 1, 0)]


def test_an_id_with_several_vectors_and_labels(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [0.01, 1.0], 1), (5, [1.0, 0.0], 2)]
    got = sorted((tuple(r) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("recall").collect()))
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


def test_one_vector_of_half_the_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else rng.normal(size=3).tolist(), 1) for i in range(1200)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows)


def test_audit_asks_for_every_fiftieth_row_and_averages_over_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(50, 40050, 50)]  # 800 queries without links
    rows += [(100001 + 50 * i, rows[i][1][:15] + [rows[i][1][15] + 0.01], 0) for i in range(800)]  # a link for each
    rows += [(7, [1.0] * 16, 1), (50, [1.0] * 16, 1), (8, [1.0] * 15 + [1.01], 1)]  # asked for as a copy of 7
    truth = E.true_links(E.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))[1].withColumnRenamed("rep", "id")).collect()
    assert {(r.grp, r.id, r.true_n) for r in truth} == {("16:0", i, 1) for i in range(50, 40050, 50)} | {("16:1", 7, 1)}
    truth = spark.createDataFrame([("a", i, 3000) for i in range(170)] + [("a", 1000 + i, 3) for i in range(340)], "grp string, id long, true_n long")
    found = spark.createDataFrame([("a", i, 3000) for i in range(170)], "grp string, id long, n long")
    assert abs(E.recalls(found, truth).first().recall - 1 / 3) < 1e-9
    assert E.recalls(found, truth.filter("false")).count() == 0


def two_groups():
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(2, 16), 150, axis=0) + 0.02 * rng.normal(size=(300, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_walks_enter_every_part_of_the_graph():
    x = two_groups()
    near = adjacency(x)
    assert (near[:150] < 150).all()
    a, b, _, lost = E.walk(x, np.arange(300), [np.zeros(0, np.int64)] * 300, x, near, E.BEAM, E.SLACK)
    assert set(a.tolist()) == set(range(300)) and lost >= 150 and len(a) == 2 * 150 * 150


def test_last_level_is_exhaustive(spark, monkeypatch):
    monkeypatch.setattr(E, "LAST_ROWS", 64)
    monkeypatch.setattr(E, "walk", None)
    x = two_groups()
    df = spark.createDataFrame([(f"{i % 2}", i, i % 3 + 1, v.tolist()) for i, v in enumerate(x)], "grp string, id long, m long, v array<double>")
    got = {(r.grp, r.id): r.n for r in E.all_links(df).groupBy("grp", "id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    near = (x @ x.T >= E.LEAST) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2) & ~np.eye(300, dtype=bool)
    assert got == {(f"{i % 2}", i): int(near[i] @ (np.arange(300) % 3 + 1)) for i in range(300)}


def test_a_label_without_audited_links_keeps_to_the_graph(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(50 * i, rng.normal(size=16).tolist(), 0) for i in range(1, 600)]
    rows += [(50 * i + 1, (np.array(rows[i][1]) + 0.03 * rng.normal(size=16)).tolist(), 0) for i in range(580, 590)]
    rows = [r for r in rows if not 580 * 50 < r[0] <= 591 * 50 or r[0] % 50]  # the queries with a copy go
    rows += [(r[0] + 1, (np.array(r[1]) + 0.03 * rng.normal(size=16)).tolist(), 0) for r in rows if r[0] % 50]
    compared = []
    exact = E.all_links
    monkeypatch.setattr(E, "all_links", lambda nodes: (compared.append(nodes.count()), exact(nodes))[1])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept, r.recall) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: x[:3] for i, x in got.items()} == brute(rows) and sum(x[0] for x in got.values()) == 20
    assert compared == [0] and {x[3] for x in got.values()} == {1.0}
    monkeypatch.setattr(E, "MORE", 0)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept, r.recall) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: x[:3] for i, x in got.items()} == brute(rows) and compared == [0, 0] and {x[3] for x in got.values()} == {None}


def test_a_measured_label_that_misses_a_link_is_compared(spark, monkeypatch):
    rows = [r for r in vectors() if r[0] < 1000 or r[0] == 2000]
    rows = [(i, v, 0) for i, v, _ in rows]
    seen = []
    exact, search = E.all_links, E.links

    def blind(nodes, near, *widths):
        seen.append(widths)
        found, whole = search(nodes, near, *widths)
        return found.filter("false"), whole

    monkeypatch.setattr(E, "links", blind)
    monkeypatch.setattr(E, "all_links", lambda nodes: (seen.append(nodes.count()), exact(nodes))[1])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows) and [x[0] if isinstance(x, tuple) else x for x in seen] == [E.MARGIN, 2 * E.MARGIN, 4 * E.MARGIN, len(rows)]


def test_nothing_stays_behind(spark):
    import os

    from batchloom.session import shared_dir

    before = set(os.listdir(shared_dir(spark) + "/llm")) if os.path.isdir(shared_dir(spark) + "/llm") else set()
    E.near_vectors(spark.createDataFrame([(i, [1.0, i / 7], 0) for i in range(60)], "vec_id long, embedding array<double>, label int")).count()
    assert {x.rpartition("-")[0][:12] for x in set(os.listdir(shared_dir(spark) + "/llm")) - before} == {"near-vectors"}
