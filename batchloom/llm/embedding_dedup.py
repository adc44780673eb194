"""Operator 6: near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Only vectors with equal labels (and lengths) are compared, by cosine in double precision. Identical vectors of a label are
one node with a count.

Build: a label's nodes are split by k-means, level by level, into build shards of about ``BUILD`` nodes, each node going to the
two nearest, so shards overlap. Centroids of a part come from a sample of it whose size follows their number; they are
fitted in the part's own task and meet its nodes in a shuffle, so nothing grows on the driver or in a broadcast. A shard's
graph links a node to robust-pruned near ones (a neighbour goes if a kept one is nearer to it than the node, by the factor
``ALPHA``), in both directions. The adjacency lists of a node from all its shards are united into one flat graph a label.

Search: a label of up to ``SHARD`` nodes is one search cell; larger ones are split in the same way into cells, where a node is
at home in the nearest and a guest in all others within ``MARGIN`` of it, with its united list. Every node of a cell is a
query: it walks greedily from the cell's medoid with a beam, then expands every node in range, with some slack, until no new
one turns up. A query is itself a node, so its walk can be checked: where it did not arrive at its own node, that node is
entered by hand. Nodes in range are verified by the double cosine and counted in their home cell only. A guest in range
whose home the query is not in sends the query there, with the guest as a further start, until no query moves: so a search
follows edges into any cell. Tasks hand out one row a query (number of links, smallest id of the local component), never
pairs. At ``SHARD`` nodes a walk meets under a tenth of them.

The audit compares the links of all rows whose id is divisible by 50 with brute force over all rows, in blocks of queries
against blocks of rows. In a label whose queries have no links, about ``MORE`` further nodes are asked for. Recall is the mean
over a label's queries of the share of links found, so a hot group weighs no more than its queries. While a label misses an
audited link, margin, beam and slack double for it, twice. A label that was measured and still misses one, or that has a part
that k-means cannot split, is compared by products, block against block, which is exhaustive. A label in which no query of
either audit has a link keeps what the graph found.

Edge cases: null, empty or zero vectors, vectors with null or non-finite components, null labels and null ids link with
nothing (0 links, own component, kept); repeated rows count as vectors of their own with the same results, and rows that
share an id but not their vector or label each have their own; extra columns are ignored; an empty table gives an empty
result. No group of copies or label is collected in one task.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import connected_components, join_hot, map_groups, scratch, stored, table
from batchloom.session import ship

LEAST = 0.93
#: Nodes of a build shard (before overlap) and most nodes of a search cell.
BUILD, SHARD = 256, 8192
#: Parts that one level of k-means makes at most, sampled nodes a centroid, levels.
FAN, PER_CENTROID, LEVELS = 64, 16, 5
#: Nodes that meet a part's centroids in one task, and queries of a cell in one task.
SLICE, QUERIES = 4096, 2048
MARGIN = 0.12
DEGREE, CANDIDATES, ALPHA, BEAM, SLACK = 24, 64, 1.2, 24, 0.05
AUDIT_ROWS, MORE, WIDTHS = 1024, 512, (1, 2, 4)
#: Rows of a block of the last level.
LAST_ROWS = 1024
#: Labels whose names may be broadcast.
MOST_LABELS = 100_000
FOUND = "grp string, id bigint, n bigint, root bigint"


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of norm 1."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def robust_graph(x: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each row after robust pruning."""
    n = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    k = min(CANDIDATES, n - 1)
    order = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((n, 0), np.int64)
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, axis=1), axis=1, kind="stable"), axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * near, 0))
    own = np.take_along_axis(gap, order, axis=1)
    between = gap[order[:, :, None], order[:, None, :]]
    alive, kept = np.ones((n, k), bool), np.zeros((n, k), bool)
    rows = np.arange(n)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[rows[some], first[some]] = True
        alive[rows, first] = False
        alive &= ~(some[:, None] & (ALPHA * between[rows, first] <= own))
    return [order[i][kept[i]] for i in range(n)]


def components(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component over undirected pairs."""
    label = ids.copy()
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    return label


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows (``vec_id, grp, embedding``), and one node for each distinct vector of a label: ``grp, rep, m, v`` (``rep``: the
    smallest id; ``asked``: the audit asks for it, since a row of it has an id divisible by 50)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").filter(~bad)
    rows = rows.withColumn("most", F.array_max(F.transform("embedding", F.abs))).filter("most > 0")
    rows = rows.select("vec_id", F.concat_ws(":", F.size("embedding"), "label").alias("grp"), "embedding", "most")
    nodes = rows.groupBy("grp", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("most").alias("most"), F.max(F.col("vec_id") % 50 == 0).alias("asked"))
    scaled = F.transform("embedding", lambda x: x / F.col("most"))
    nodes = nodes.withColumn("embedding_", scaled).withColumn("norm", F.sqrt(F.aggregate("embedding_", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.drop("most"), nodes.select("grp", "rep", "m", F.transform("embedding_", lambda x: x / F.col("norm")).alias("v"), "embedding", "asked")


def kmeans(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
    """Centroids of each part from its sample; ``k``: how many."""
    grp, cell, k = (rows.column(c).to_pylist() for c in ("grp", "cell", "k"))
    vectors, out = rows.column("v").combine_chunks(), {"grp": [], "cell": [], "c": []}
    for s, e in groups:
        x = unit_rows(vectors.slice(s, e - s))
        c = x[np.linspace(0, len(x) - 1, min(k[s], len(x))).astype(int)].copy()
        for _ in range(5):
            near = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
        out["grp"] += [grp[s]] * len(c)
        out["cell"] += [cell[s]] * len(c)
        out["c"] += c.tolist()
    return pa.table({"grp": pa.array(out["grp"], pa.string()), "cell": pa.array(out["cell"], pa.string()), "c": pa.array(out["c"], pa.list_(pa.float64()))})


def assign(rows: pa.Table, groups: list[tuple[int, int]], margin: float | None) -> pa.Table:
    """Nodes (side 1) to the centroids (side 0) of their part: the two nearest, or all within a margin of the nearest."""
    side, ids, home = (rows.column(c).to_numpy() for c in ("side", "id", "home"))
    grp, cell = rows.column("grp").to_pylist(), rows.column("cell").to_pylist()
    vectors = rows.column("v").combine_chunks()
    out: dict[str, list] = {"grp": [], "cell": [], "home": [], "at": []}
    for s, e in groups:
        x = unit_rows(vectors.slice(s, e - s))
        c, q = x[side[s:e] == 0], np.flatnonzero(side[s:e] == 1)
        if not len(q):
            continue
        near = x[q] @ c.T
        best = near.argmax(axis=1)
        if margin is None:
            bar = np.partition(near, -2, axis=1)[:, -2] if near.shape[1] > 1 else near[:, 0]
            i, j = np.nonzero(near >= bar[:, None])
        else:
            i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - margin)
        out["grp"] += [grp[s]] * len(i)
        out["cell"] += [f"{cell[s]}/{k}" for k in j.tolist()]
        out["home"].append(home[s:e][q][i] & (j == best[i]))
        out["at"].append(q[i] + s)
    at = np.concatenate(out["at"]) if out["at"] else np.zeros(0, np.int64)
    flags = np.concatenate(out["home"]) if out["home"] else np.zeros(0, bool)
    return pa.table({"grp": pa.array(out["grp"], pa.string()), "cell": pa.array(out["cell"], pa.string()), "home": pa.array(flags.astype(bool)), "id": pa.array(ids[at], pa.int64()), "v": vectors.take(pa.array(at))})


def parts(nodes: DataFrame, size: int, margin: float | None) -> DataFrame:
    """``grp, cell, home, id, v``: nodes in overlapping parts of about ``size``, split by k-means level by level."""
    todo = nodes.select("grp", F.lit("").alias("cell"), F.lit(True).alias("home"), "id", "v")
    done = None
    for level in range(LEVELS):
        counts = stored(todo.groupBy("grp", "cell").agg(F.count("*").alias("n")), "part-sizes")
        most = size if level == 0 else 4 * size
        ready = join_hot(todo, counts.withColumn("big", F.col("n") > most), ["grp", "cell"])
        fine = ready.filter("NOT big").select("grp", "cell", "home", "id", "v")
        done = fine if done is None else done.unionByName(fine)
        big = counts.filter(F.col("n") > most)
        if big.isEmpty():
            return done
        big = big.withColumn("k", F.least(F.lit(FAN), F.ceil(F.col("n") / size)).cast("int")).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
        split = stored(join_hot(todo, big, ["grp", "cell"]), "parts")
        # a part's number of rows is at least the sample's, so the chance is that of its count
        chance = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        sizes = big.select("grp", "cell", "n", (PER_CENTROID * F.col("k") / F.col("n")).alias("part"))
        sample = join_hot(split, sizes, ["grp", "cell"]).filter(chance < F.col("part")).select("grp", "cell", "k", "v")
        cents = stored(map_groups(sample, ["grp", "cell"], "grp string, cell string, c array<double>", kmeans), "centroids")
        one = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
        queries = split.select("grp", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("side"), "home", "id", "v")
        centre = cents.join(big.select("grp", "cell", "slices"), ["grp", "cell"]).select("grp", "cell", one.alias("slice"), F.lit(0).alias("side"), F.lit(True).alias("home"), F.lit(0).cast("long").alias("id"), F.col("c").alias("v"))
        todo = stored(map_groups(queries.union(centre), ["grp", "cell", "slice"], "grp string, cell string, home boolean, id bigint, v array<double>", partial(assign, margin=margin)), "assigned")
    return done.unionByName(todo)


def build(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
    """Edges of the graph on each shard, in both directions."""
    ids, out = rows.column("id").to_numpy(), []
    vectors = rows.column("v").combine_chunks()
    for s, e in groups:
        if e - s > 1:
            lists = robust_graph(unit_rows(vectors.slice(s, e - s)))
            a = np.repeat(np.arange(s, e), [len(x) for x in lists])
            b = np.concatenate(lists) + s
            out.append(np.unique(np.stack([np.concatenate([a, b]), np.concatenate([b, a])]), axis=1))
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"id": pa.array(ids[both[0]], pa.int64()), "to": pa.array(ids[both[1]], pa.int64())})


def graph(nodes: DataFrame) -> DataFrame:
    """``id, near``: the united adjacency list of every node with neighbours."""
    shards = stored(parts(nodes, BUILD, None), "shards")
    counts = shards.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / (4 * BUILD)).cast("int").alias("nb"))
    dealt = join_hot(shards, stored(counts, "shard-sizes"), ["grp", "cell"])
    # a shard that k-means could not split is dealt twice, so that its pieces overlap
    twice = dealt.withColumn("deal", F.explode(F.when(F.col("nb") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    keyed = twice.select("grp", "cell", "deal", F.pmod(F.xxhash64("id", "deal"), F.col("nb")).cast("int").alias("p"), "id", "v")
    edges = map_groups(keyed, ["grp", "cell", "deal", "p"], "id bigint, to bigint", build)
    return stored(edges.groupBy("id").agg(F.collect_set("to").alias("near")), "adjacency")


def walk(queries: np.ndarray, own: np.ndarray, entries: list[np.ndarray], nodes: np.ndarray, near: np.ndarray, beam: int, slack: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pairs (query, node) in range: greedy walks from the medoid with a beam, then expansion of everything in range.

    ``own``: each query's place among the nodes (-1: none); ``entries``: further starts; ``near``: adjacency, -1 for none.
    Also the number of nodes met, and of queries whose walk did not meet their own node.
    """
    nq, n, degree = len(queries), len(nodes), near.shape[1]
    seen = np.zeros((nq, n), bool)
    flat = seen.reshape(-1)
    found_q, found_v, met = [], [], 0

    def visit(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        nonlocal met
        flat[q * n + v] = True
        met += len(q)
        score = np.empty(len(q))
        for lo in range(0, len(q), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            score[part] = np.einsum("ij,ij->i", queries[q[part]], nodes[v[part]])
        hit = score >= LEAST - slack
        found_q.append(q[hit])
        found_v.append(v[hit])
        return score

    every = np.arange(nq)
    medoid = int(np.argmax(nodes @ nodes.mean(axis=0)))
    ids, score, open_ = np.full((nq, beam), -1), np.full((nq, beam), -2.0), np.zeros((nq, beam), bool)
    ids[:, 0], score[:, 0], open_[:, 0] = medoid, visit(every, np.full(nq, medoid)), True
    for q, some in enumerate(entries):
        some = some[some != medoid]
        if len(some):
            value = visit(np.full(len(some), q), some)
            k = min(len(some), beam - 1)
            top = np.argsort(-value)[:k]
            ids[q, 1 : k + 1], score[q, 1 : k + 1], open_[q, 1 : k + 1] = some[top], value[top], True
    active = every
    while len(active):
        ready = np.where(open_[active], score[active], -3.0)
        best = ready.argmax(axis=1)
        go = ready[np.arange(len(active)), best] > -3.0
        active, best = active[go], best[go]
        if not len(active):
            break
        open_[active, best] = False
        to = near[ids[active, best]]
        new = (to >= 0) & ~seen[active[:, None], to]
        i, j = np.nonzero(new)
        value = np.full(to.shape, -2.0)
        value[i, j] = visit(active[i], to[i, j])
        all_score = np.concatenate([score[active], value], axis=1)
        top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        rows = np.arange(len(active))[:, None]
        ids[active] = np.concatenate([ids[active], to], axis=1)[rows, top]
        score[active] = all_score[rows, top]
        open_[active] = np.concatenate([open_[active], new], axis=1)[rows, top]
    lost = np.flatnonzero((own >= 0) & ~seen[every, np.maximum(own, 0)])
    visit(lost, own[lost])
    front_q, front_v = np.concatenate(found_q), np.concatenate(found_v)
    while len(front_q):
        found_q, found_v = found_q[:], found_v[:]
        fresh = len(found_q)
        step = max(1, (1 << 20) // degree)
        for lo in range(0, len(front_q), step):
            to = near[front_v[lo : lo + step]]
            q = np.repeat(front_q[lo : lo + step], degree)
            code = (q * n + to.ravel())[to.ravel() >= 0]
            code = np.unique(code[~flat[code]])
            visit(code // n, code % n)
        front_q = np.concatenate([np.zeros(0, np.int64), *found_q[fresh:]])
        front_v = np.concatenate([np.zeros(0, np.int64), *found_v[fresh:]])
    q, v = np.concatenate(found_q), np.concatenate(found_v)
    sure = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", queries[q[k : k + 65536]], nodes[v[k : k + 65536]]) >= LEAST for k in range(0, len(q), 65536))])
    return q[sure], v[sure], met, len(lost)


def searcher(beam: int, slack: float):
    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        ids, m, home, query, kind = (rows.column(c).to_numpy() for c in ("id", "m", "home", "query", "kind"))
        grp, home_cell, cells, starts = (rows.column(c).to_pylist() for c in ("grp", "home_cell", "cells", "entries"))
        vectors, lists = rows.column("v").combine_chunks(), rows.column("near").combine_chunks()
        out: dict[str, list] = {"grp": [], "id": [], "n": [], "root": [], "go": []}
        for s, e in groups:
            local = s + np.flatnonzero(kind[s:e] == 0)
            if not len(local):
                continue
            x, known = unit_rows(vectors.take(pa.array(local))), ids[local]
            order = np.argsort(known)
            place = lambda some: order[np.minimum(np.searchsorted(known[order], some), len(order) - 1)]  # noqa: B023, E731
            near_lists = lists.take(pa.array(local))
            owner = np.repeat(np.arange(len(local)), np.nan_to_num(near_lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            targets = near_lists.flatten().to_numpy()
            at = place(targets)
            here = known[at] == targets
            owner, at = owner[here], at[here]
            count = np.bincount(owner, minlength=len(local))
            near = np.full((len(local), max(1, int(count.max(initial=0)))), -1)
            near[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = at
            asks = s + np.flatnonzero(query[s:e])
            at_home, homes = home[local], np.array([home_cell[i] for i in local], object)
            step = max(16, min(512, (1 << 24) // len(local)))
            names = np.concatenate([known, ids[asks]])  # the nodes, and the queries once more: a visiting one is no node here
            total, away, ties = np.zeros(len(names), np.int64), {}, [np.zeros((2, 0), np.int64)]
            for lo in range(0, len(asks), step):
                q = asks[lo : lo + step]
                own = np.where((known[place(ids[q])] == ids[q]) & (kind[q] == 0), place(ids[q]), -1)
                entries = []
                for i in q:
                    some = np.array(starts[i] or [], np.int64)
                    hit = place(some)
                    entries.append(hit[known[hit] == some] if len(some) else some)
                a, b, _, _ = walk(unit_rows(vectors.take(pa.array(q))), own, entries, x, near, beam, slack)
                other = ids[q][a] != known[b]
                a, b = a[other], b[other]
                me = np.where(own >= 0, own, len(local) + lo + np.arange(len(q)))
                total[me] += np.bincount(a[at_home[b]], m[local][b[at_home[b]]], len(q)).astype(np.int64)
                for i, v in zip(a[~at_home[b]].tolist(), b[~at_home[b]].tolist(), strict=True):
                    if homes[v] not in cells[q[i]]:
                        away.setdefault(int(me[i]), {}).setdefault(homes[v], int(known[v]))
                label = components(len(names), me[a], b, np.arange(len(names)))
                moved = np.flatnonzero(label != np.arange(len(names)))
                ties.append(np.stack([moved, label[moved]]))
            label = components(len(names), *np.concatenate(ties, axis=1), names)
            linked = np.zeros(len(names), bool)
            linked[np.concatenate(ties, axis=1).ravel()] = True
            linked[list(away)] = True
            for i in np.flatnonzero(linked | (total > 0)).tolist():
                out["grp"].append(grp[s])
                out["id"].append(int(names[i]))
                out["n"].append(int(total[i]))
                out["root"].append(int(label[i]))
                out["go"].append([{"cell": c, "entry": v} for c, v in away.get(i, {}).items()])
        types = (("grp", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("go", pa.list_(pa.struct([("cell", pa.string()), ("entry", pa.int64())]))))
        return pa.table({k: pa.array(out[k], t) for k, t in types})

    return work


def links(nodes: DataFrame, near: DataFrame, margin: float, beam: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """``grp, id, n, root`` of every node with links, one row for each cell that found some, and the labels with a cell that is
    too large to search."""
    placed = stored(parts(nodes, SHARD, margin), "cells")
    sizes = stored(placed.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / QUERIES).cast("int").alias("slices")), "cell-sizes")
    whole = sizes.filter(F.col("n") > 4 * SHARD).select("grp").distinct()
    of = placed.groupBy("id").agg(F.collect_set("cell").alias("cells"), F.max(F.when(F.col("home"), F.col("cell"))).alias("home_cell"))
    rows = placed.join(of, "id").join(near, "id", "left").join(nodes.select("id", "m"), "id").join(whole, "grp", "left_anti")
    rows = stored(join_hot(rows, sizes, ["grp", "cell"]), "cell-rows")
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    none = F.lit(None).cast("array<bigint>")
    copies = rows.withColumn("own", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    columns = ["grp", "cell", "slice", "kind", "query", "home", "id", "m", "v", "near", "cells", "home_cell", "entries"]
    local = copies.select("grp", "cell", "slice", F.lit(0).alias("kind"), (F.col("slice") == F.col("own")).alias("query"), "home", "id", "m", "v", "near", "cells", "home_cell", none.alias("entries"))
    schema = FOUND + ", go array<struct<cell:string,entry:bigint>>"
    found = stored(map_groups(local.select(*columns), ["grp", "cell", "slice"], schema, searcher(beam, slack)), "found")
    every, last = found, found
    been = placed.select("grp", "cell", "id")
    while True:
        moves = last.select("grp", "id", F.explode("go").alias("g")).groupBy("grp", F.col("g.cell").alias("cell"), "id").agg(F.collect_set("g.entry").alias("entries"))
        moves = stored(moves.join(been, ["grp", "cell", "id"], "left_anti"), "moves")
        if moves.isEmpty():
            return every.select("grp", "id", "n", "root"), whole
        been = stored(been.union(moves.select("grp", "cell", "id")), "been")
        now = stored(been.groupBy("id").agg(F.collect_set("cell").alias("cells")), "been-cells")
        guests = moves.join(nodes.select("id", "v"), "id").join(now, "id").join(sizes.select("grp", "cell", "slices"), ["grp", "cell"])
        visits = guests.select("grp", "cell", own.alias("slice"), F.lit(1).alias("kind"), F.lit(True).alias("query"), F.lit(False).alias("home"), "id", F.lit(0).cast("long").alias("m"), "v", none.alias("near"), "cells", F.lit(None).cast("string").alias("home_cell"), "entries")
        hosts = local.withColumn("query", F.lit(False)).join(visits.select("grp", "cell", "slice").distinct(), ["grp", "cell", "slice"], "left_semi")
        last = stored(map_groups(hosts.select(*columns).union(visits.select(*columns)), ["grp", "cell", "slice"], schema, searcher(beam, slack)), "found")
        every = every.union(last)


def found_table(grp: list[str], *columns: list[np.ndarray]) -> pa.Table:
    whole = {k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in zip(("id", "n", "root"), columns, strict=True)}
    return pa.table({"grp": pa.array(grp, pa.string()), **whole})


def every_link(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
    """Links between two blocks, or inside one (then all rows are on side 0)."""
    ids, m, side, grp = (rows.column(c).to_numpy() for c in ("id", "m", "side", "grp"))
    lo, hi, vectors = rows.column("lo").to_numpy(), rows.column("hi").to_numpy(), rows.column("v").combine_chunks()
    found_grp, found_id, found_n, found_root = [], [], [], []
    for s, e in groups:
        x, q, r = unit_rows(vectors.slice(s, e - s)), np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
        if lo[s] == hi[s]:
            r = q
        near = (x[q] @ x[r].T >= LEAST) & (q[:, None] != r[None, :])
        count = np.zeros(e - s, np.int64)
        count[q] += near @ m[s:e][r]
        if lo[s] != hi[s]:
            count[r] += near.T @ m[s:e][q]
        i, j = np.nonzero(near)
        hit = np.flatnonzero(count)
        found_grp.extend([grp[s]] * len(hit))
        found_id.append(ids[s:e][hit])
        found_n.append(count[hit])
        found_root.append(components(e - s, q[i], r[j], ids[s:e])[hit])
    return found_table(found_grp, found_id, found_n, found_root)


def all_links(nodes: DataFrame) -> DataFrame:
    """``links`` by comparing all nodes of a label with each other, block against block."""
    dealt = blocks_of(nodes.select("grp", "id", "m", "v"), LAST_ROWS, "nb").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    keyed = dealt.select("grp", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).cast("int").alias("side"), "id", "m", "v")
    return map_groups(keyed, ["grp", "lo", "hi"], FOUND, every_link)


def blocks_of(nodes: DataFrame, rows: int, name: str) -> DataFrame:
    """The nodes with ``p``, their block of about ``rows`` in the label, and ``name``, the number of its blocks."""
    size = nodes.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias(name), F.count("*").alias("n"))
    return join_hot(nodes, stored(size, "label-blocks"), ["grp"]).withColumn("p", F.pmod(F.xxhash64("id"), F.col(name)).cast("int"))


def of_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of some labels (``grp``, and ``n``, how many nodes each has)."""
    return join_hot(nodes, labels.select("grp", "n"), ["grp"])


def true_links(nodes: DataFrame) -> DataFrame:
    """``grp, id, true_n`` of every node that is asked for and has links to other nodes, by brute force over all rows."""
    blocks = lambda n: F.ceil(n / AUDIT_ROWS).cast("int")
    counts = nodes.groupBy("grp").agg(F.count("*").alias("n"), blocks(F.count("*")).alias("nr"), blocks(F.count_if("asked")).alias("nq"))
    counts = stored(counts.filter("nq > 0"), "audit-sizes")
    place = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    every = join_hot(nodes.select("grp", "id", "m", "v", "asked"), counts, ["grp"])
    queries = every.filter("asked").select("grp", place("nq").alias("q"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("m"), "v")
    rows = every.select("grp", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), place("nr").alias("r"), F.lit(1).alias("side"), "id", "m", "v")

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        ids, m, side, grp = (rows.column(c).to_numpy() for c in ("id", "m", "side", "grp"))
        vectors, out_grp, out_id, out_n = rows.column("v").combine_chunks(), [], [], []
        for s, e in groups:
            x, q, r = unit_rows(vectors.slice(s, e - s)), np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
            n = ((x[q] @ x[r].T >= LEAST) & (ids[s:e][q][:, None] != ids[s:e][r][None, :])) @ m[s:e][r]
            hit = n > 0
            out_grp.extend([grp[s]] * int(hit.sum()))
            out_id.append(ids[s:e][q][hit])
            out_n.append(n[hit])
        whole = {k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in (("id", out_id), ("n", out_n))}
        return pa.table({"grp": pa.array(out_grp, pa.string()), **whole})

    return map_groups(queries.union(rows), ["grp", "q", "r"], "grp string, id bigint, n bigint", work).groupBy("grp", "id").agg(F.sum("n").alias("true_n"))


def recalls(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``grp, recall``: the mean over a label's queries with links of the share found. Labels without such queries are missing."""
    sums = truth.join(found.groupBy("grp", "id").agg(F.sum("n").alias("n")), ["grp", "id"], "left")
    return sums.groupBy("grp").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("true_n")).alias("recall"))


def audited(plain: DataFrame, sizes: DataFrame) -> DataFrame:
    """``true_links`` of the rows that the audit asks for, and of further nodes of labels where those have none."""
    truth = stored(true_links(plain), "truth")
    quiet = sizes.filter("n > 1").join(truth.select("grp").distinct(), "grp", "left_anti")
    chosen = F.pmod(F.xxhash64("id", F.lit("audit")), F.col("size")) < MORE
    some = join_hot(plain, stored(quiet.withColumn("size", F.col("n")), "quiet"), ["grp"]).withColumn("asked", chosen).drop("size")
    return stored(truth.union(true_links(some)), "truth")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` of every row (``recall``: of its label, as the audit measured it; null
    where it measured nothing)."""
    ship(vectors.sparkSession)
    with scratch() as result:
        return result(_near_vectors(vectors), "near-vectors")


def _near_vectors(vectors: DataFrame) -> DataFrame:
    rows, nodes = nodes_of(vectors)
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    plain = nodes.drop("embedding", "rep")
    sizes = stored(plain.groupBy("grp").agg(F.count("*").alias("n")), "label-sizes")
    truth = audited(plain, sizes)
    left, rest, near = stored(sizes.filter("n > 1"), "to-search"), sizes.filter("false"), None
    parts_found, scores = [], []
    for wide in WIDTHS:
        if left.isEmpty():
            break
        some = of_labels(plain, left)
        near = graph(some) if near is None else near
        got, whole = links(some, near, wide * MARGIN, wide * BEAM, wide * SLACK)
        got = stored(got, "links")
        whole = stored(whole, "not-split")
        score = recalls(got, truth.join(left.select("grp"), "grp", "left_semi"))
        score = stored(left.join(score, "grp", "left").join(whole, "grp", "left_anti"), "recalls")
        good = score.filter("recall IS NULL OR recall >= 1")
        parts_found.append(got.join(F.broadcast(good.select("grp")) if good.count() <= MOST_LABELS else good.select("grp"), "grp", "left_semi"))
        scores.append(good.select("grp", "recall"))
        rest = rest.union(left.join(whole, "grp", "left_semi"))
        left = stored(score.filter("recall < 1").select("grp", "n"), "to-widen")
    last = stored(all_links(of_labels(plain, stored(rest.union(left), "to-compare"))), "links")
    scores.append(recalls(last, truth))
    found = stored(reduce(DataFrame.union, [last, *parts_found]), "every-link")
    measured = reduce(DataFrame.union, scores).groupBy("grp").agg(F.max("recall").alias("recall"))
    scores = stored(sizes.join(measured, "grp", "left"), "scores")
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = nodes.select("grp", "embedding", "id", "rep", "m").join(total, "id", "left").join(comps.withColumnRenamed("component_id", "root"), "id", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "id")), "named")
    roots = stored(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("k")), "roots")
    done = join_hot(join_hot(named, roots, ["root"], "k"), scores, ["grp"])
    done = stored(done.select("grp", "embedding", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id", "recall"), "classes")
    linked = join_hot(rows, done, ["grp", "embedding"], "m").select("vec_id", "n_links", "component_id", "recall")
    loose = other_rows(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    every = linked.union(loose)
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "recall")


def other_rows(vectors: DataFrame) -> DataFrame:
    """The ids of the rows that ``nodes_of`` leaves out."""
    sound = F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    most = F.coalesce(F.array_max(F.transform("embedding", F.abs)), F.lit(0.0))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound & (most > 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(~good)


def op6_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


ORACLE = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= {LEAST}),
r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""
