from batchloom.llm import mixing
from batchloom.llm.mixing import decisions, key_limits, keyed, mix_documents, mixed_copies, place_in, source_targets
from batchloom.llm.queries import ORACLES, QUERIES
from tests.helpers import same_as_oracle


def filled(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        total = sum(w[s] for s in order if s not in full)
        for s in [s for s in order if s not in full]:
            target[s] += left * w[s] / total
        left = 0.0
        for s in order:
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def test_targets_equal_resharing(spark):
    sizes = {"b": 10, "a": 500, "é": 40, None: 300, "z": 0, "c": 77}
    df = spark.createDataFrame([("s" + k if k is not None else "n", v) for k, v in sizes.items()], "src string, source_size long")
    got = {r.src: r.target for r in source_targets(df).collect()}
    for k, v in filled(sizes).items():
        assert abs(got["s" + k if k is not None else "n"] - v) < 1e-6


def test_mix_laws(spark):
    rows = [(i, " ".join(["wort"] * (1 + i % 37)), ("a", "b", None, "n")[min(i % 7, 3)]) for i in range(600)]
    rows += [(9001, None, "a"), (9002, " \t", "b"), (None, "x y", "a"), (5, "x", "b"), (5, "x", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS taken")
    got = mix_documents(df).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for _, part in got.groupby("target"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2
        assert part.loc[part["size"] > 0, "times"].max() - part.loc[part["size"] > 0, "times"].min() <= 1
    assert mix_documents(df.filter("false")).count() == 0
    same_as_oracle(spark, QUERIES["op7_mix_sources"], ORACLES["op7_mix_sources"])


def mixed_rows(spark, n=3000):
    """A source of prose, one of code-like texts (weights about 0.1), one of both, and rows that repeat without end."""
    prose, code = "several ordinary words of prose ", "x=#$&|y; {[<>]} "
    rows = [(i, prose * (1 + i % 3) if i % 3 else code * (1 + i % 5), ("prose", "code", "both")[1 if i % 3 == 0 else 2 * (i % 2)]) for i in range(n)]
    rows += [(n + 7, prose, "both")] * (n // 3) + [(n + 8, "w " * 70_000, "code")]
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, range int, n double")


def test_ranges_hold_about_as_many_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    docs = mixed_rows(spark)
    rows = keyed(docs.select("doc_id", "text", "source"), "s", {"src": "src", "size": "size", "key": "key"}).dropDuplicates(["doc_id"])
    placed = rows.join(key_limits(rows), "src").withColumn("at", place_in("limits", "key")).toPandas()
    assert placed.groupby("src")["at"].max().min() >= 5
    for _, part in placed.groupby("src"):
        sizes = part.groupby("at").size()
        assert sizes.max() <= 4 * sizes.mean()
        edges = part.groupby("at")["key"].agg(["min", "max"]).sort_index()
        assert (edges["max"].to_numpy()[:-1] < edges["min"].to_numpy()[1:]).all()
        limits = sorted(part["limits"].iloc[0])
        assert all(at == sum(x < key for x in limits) for at, key in zip(part["at"], part["key"], strict=True))


def test_ranges_and_partitions_change_nothing(spark, monkeypatch):
    docs = mixed_rows(spark, 900)
    want = sorted(tuple(r) for r in mix_documents(docs).collect())
    copies = sorted((r.doc_id, r["count"]) for r in mixed_copies(docs).groupBy("doc_id").count().collect())
    assert len(want) == docs.count()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    for parts in (1, 4, 7):
        dealt = docs.repartition(parts)
        assert sorted(tuple(r) for r in mix_documents(dealt).collect()) == want
        assert sorted((r.doc_id, r["count"]) for r in mixed_copies(dealt).groupBy("doc_id").count().collect()) == copies
    firm = {i: t for i, *_, t in want if i != 907}
    assert {i: n for i, n in copies if i != 907} == {i: t for i, t in firm.items() if t}
    assert decisions(docs.filter("false")).count() == 0
