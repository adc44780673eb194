import math
from collections import Counter

import numpy as np
import pyarrow as pa
from batchloom.llm.common import table
from batchloom.llm import toxicity
from batchloom.llm.toxicity import FOLDS, classify, fit_chain, fold_of, op2_toxicity_chain, sample_rows, select_words, text_words, train, without_toxic, word_counts

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = train(docs, labels.filter("doc_id % 2 = 0"))
    got = classify(docs, chain).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    english = docs.filter("lang = 'en'").select("doc_id").toPandas()["doc_id"]
    assert got[got.toxic == 0].is_toxic.mean() < 0.005
    assert got[got.toxic == 1].is_toxic.mean() > 0.8  # a few dozen training rows in each language but English
    assert got[(got.toxic == 1) & got.doc_id.isin(english)].is_toxic.mean() > 0.94
    assert (got.kept == ~got.is_toxic).all()


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 6)) < 0.4).astype(np.float32)
    first = (x[:, 0] > 0).astype(int)
    labels = np.stack([first, first * (x[:, 1] > 0), first], axis=1)
    chain = fit_chain(x, labels, np.arange(6, dtype=np.uint64) << np.uint64(50), ["a", "b", "c"], np.arange(400) % 5)
    assert [len(m.weights) for m in chain.models] == [6, 7, 8] and chain.models[2].weights[6] > 0.5
    hashes = np.array([0, 1 << 50, 3 << 50], np.uint64)
    p = chain.probabilities(hashes, np.array([0, 2, 3, 3]))
    assert p.shape == (3, 3) and p[0, 2] > 0.9 and p[1, 2] < 0.1


def test_edges(spark, tmp_path):
    rows = [(1, None, 0, "s"), (2, "", 0, None), (3, "clean words here", 0, "s"), (None, "x", 1, "s"), (3, "clean words here", 0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, p_toxic string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op2_toxicity_chain(spark, str(tmp_path)).toPandas()
    assert len(got) == 5 and not got.is_toxic.any()
    chain = train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(map(str, without_toxic(docs, chain).collect())) == sorted(map(str, docs.collect()))
    assert classify(docs.filter("false"), chain).count() == 0


def test_words_are_selected_without_the_fold_by_hand(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_GAIN", 1.0)
    monkeypatch.setattr(toxicity, "FEATURES", 12)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["vile", "nasty", "grim", "mild", "calm", "kind"], 3, p=[0.4, 0.25, 0.2, 0.05, 0.05, 0.05] if i % 4 == 0 else [0.02, 0.03, 0.15, 0.3, 0.25, 0.25])), int(i % 4 == 0)) for i in range(240)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, y2 int")
    fold = fold_of(np.arange(240))
    sizes = {f: (int((fold == f).sum()), sum(r[2] for r in rows if fold[r[0]] == f)) for f in range(FOLDS)}
    got = select_words(word_counts(texts, "y2"), sizes)
    for left in [*range(FOLDS), None]:
        use = [r for r in rows if fold[r[0]] != left]
        n, n1, has, has1 = len(use), sum(r[2] for r in use), Counter(), Counter()
        for _, text, y in use:
            for w in set(text_words(pa.array([text]))[0].tolist()):
                has[w] += 1
                has1[w] += y
        term = lambda seen, of, all_: seen * math.log(seen * n / (of * all_)) if seen else 0.0  # noqa: B023, E731
        gain = {w: term(has1[w], has[w], n1) + term(has[w] - has1[w], has[w], n - n1) + term(n1 - has1[w], n - has[w], n1) + term(n - n1 - has[w] + has1[w], n - has[w], n - n1) for w in has if n > has[w] >= 3 and has1[w] >= 0.6 * (has[w] + 2)}
        want = sorted((w for w in gain if gain[w] >= 1.0), key=lambda w: (-round(gain[w], 9), np.uint64(w).view(np.int64)))[:12]
        assert set(got[FOLDS if left is None else left].tolist()) == set(want)
    assert any(set(got[f].tolist()) != set(got[-1].tolist()) for f in range(FOLDS)) or len(got[-1]) > 0


def test_out_of_fold_probabilities_by_hand():
    rng = np.random.default_rng(7)
    x = (rng.random((300, 5)) < 0.3).astype(np.float32)
    labels = np.stack([x[:, 0] > 0, (x[:, 0] > 0) & (x[:, 1] > 0), x[:, 1] > 0], axis=1).astype(int)
    folds, selected = np.arange(300) % 3, np.ones((4, 5), bool)
    selected[1, 4] = selected[3, 3] = False
    chain = fit_chain(x, labels, np.arange(5, dtype=np.uint64), ["a", "b", "c"], folds, selected)
    known = np.zeros((300, 0))
    for k in range(3):
        p = np.zeros(300)
        for f in range(3):
            z = np.hstack([x[:, selected[f]], known])
            p[folds == f] = toxicity.fit_linear(z[folds != f], labels[folds != f, k].astype(float), int(selected[f].sum()))(z[folds == f])
        want = toxicity.fit_linear(np.hstack([x[:, selected[3]], known]), labels[:, k].astype(float), 4)
        assert np.allclose(chain.models[k].weights, want.weights) and chain.models[k].bias == want.bias
        clean = np.sort(p[labels[:, k] == 0])[-1 - int(toxicity.FALSE_RATE * (labels[:, k] == 0).sum())]
        assert math.isclose(chain.thresholds[k], np.nextafter(clean, 2.0) if clean >= 0.5 else max(0.1, math.sqrt(clean / 2)))
        known = np.hstack([known, p[:, None]])
    assert chain.words.tolist() == [0, 1, 2, 4]


def test_contradicting_labels_and_long_texts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (2, 0, 1), (3, None, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, sample_rows(labels).collect())) == [(2, 1, 1, 1), (3, 0, 0, 1)]
    long = "word " * 400_000
    docs = spark.createDataFrame([(i, ("vile filth " if i % 2 else "calm prose ") * 5 + (f"x{i} " * 40)) for i in range(80)], "doc_id long, text string")
    chain = train(docs, docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 2 AS int) AS toxic"))
    got = {r.doc_id: r.is_toxic for r in classify(spark.createDataFrame([(1, long), (2, long + "vile filth"), (2, "vile filth"), (3, "y" * 1_000_000)], "doc_id long, text string"), chain).collect()}
    assert got == {1: False, 2: True, 3: False}
