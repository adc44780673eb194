import zlib

import numpy as np
from batchloom.llm import sharding
from batchloom.llm.sharding import difference, shard_documents


def test_difference_balances_better_than_dealing():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.pareto(3, 400) * 1000).astype(np.int64)[::-1]
    vectors = np.zeros((len(sizes), 8), np.int64)
    vectors[:, 0] = sizes
    place = difference(vectors)
    totals = np.bincount(place[:, 0], sizes, 8)
    assert totals.sum() == sizes.sum() and totals.max() - totals.min() <= 3, totals
    assert all(sorted(p) == list(range(8)) for p in place.tolist())
    assert difference(np.zeros((0, 4), np.int64)).shape == (0, 4)


def test_levels_keep_groups_and_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, "é" * int(n)) for i, n in enumerate(rng.integers(1, 4000, 300))] + [(1000 + i, "same") for i in range(150)]
    rows += [(2000, None), (2001, ""), (None, "x"), (7, "again"), (7, "again")]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 6).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"}
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    totals = got.groupby("shard")["size"].sum()
    assert len(totals) == 6 and totals.max() - totals.min() < 0.02 * totals.mean()
    again = shard_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string"), 6).toPandas()
    assert sorted(zip(got["text_crc32"], got["shard"], strict=True)) == sorted(zip(again["text_crc32"], again["shard"], strict=True))
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def tree_of_pairs(sizes, k):
    """Karmarkar-Karp by hand: partial partitions as sorted lists of (total, members), the two widest joined in turn."""
    parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1][0] - p[0][0])
        a, b = parts.pop(0), parts.pop(0)
        both = [(x + y, m + o) for (x, m), (y, o) in zip(a, b[::-1], strict=True)]
        parts.append(sorted(both, key=lambda p: -p[0]))
    return sorted(t for t, _ in parts[0])


def test_totals_equal_differencing_by_hand():
    rng = np.random.default_rng(5)
    for k in (2, 3, 5):
        sizes = sorted({int(x) for x in rng.integers(1, 10**9, 40)}, reverse=True)  # no ties, which may be broken either way
        vectors = np.zeros((len(sizes), k), np.int64)
        vectors[:, 0] = sizes
        totals = np.bincount(difference(vectors)[:, 0], sizes, k)
        assert sorted(totals.astype(int)) == tree_of_pairs(sizes, k)


def test_equal_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = [(None, "same", 1, 2)] * 200 + [(1, "same", 3, 4)] * 150 + [(i, f"t{i}", 5, 6) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int").selectExpr("*", "'x' AS gid", "7 AS n", "8 AS bucket", "9 AS size")
    got = shard_documents(df, 4).toPandas()
    assert len(got) == 400 and (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "x" * 3_000_000), (2, "y"), (3, None), (None, "y"), (2, "y")]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, gid int, shard string, slot int")
    got = shard_documents(df, 2).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t or "") + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
