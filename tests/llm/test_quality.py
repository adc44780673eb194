import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from batchloom.llm.common import table
from batchloom.llm.quality import COUNTS, FALSE_RATE, calibrated, features, fit_quality, labelled_sample, op10_quality_rules, quality_rules, statistics
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


ODD = ["", " ", "a", "a b c d e a b c d e", "x x x x x x x", "l1 a\nl1 a\n\n \n \nl1 a \n", "é😀 #*|\r\n<>&$%", "\x1c\x85 a b", "a b c d e f " * 9]


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = ODD + ["\n".join(" ".join(rng.choice("a b cc é # |x").strip() or "a" for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(200)]
    texts.append("\n".join(f"line {i % 40000} ü" for i in range(90_000)))  # longer than a block
    stats = statistics(pa.array(texts[:-1]))
    long = statistics(pa.array(texts[-1:]))
    for i, t in enumerate(texts):
        part = (long, 0) if i == len(texts) - 1 else (stats, i)
        assert tuple(int(part[0][c][part[1]]) for c in COUNTS[:5]) == brute(t), t[:80]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#😀\r", max_size=60), min_size=1, max_size=6))
def test_statistics_equal_brute_force_on_any_text(texts):
    stats = statistics(pa.array(texts))
    assert [tuple(int(stats[c][i]) for c in COUNTS[:5]) for i in range(len(texts))] == [brute(t) for t in texts]


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    forest = fit_quality(docs, labels.filter("doc_id % 2 = 0"))
    got = quality_rules(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    usual, poor = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert usual.kept.mean() > 0.99 and poor.kept.mean() < 0.05


def test_edges(spark, tmp_path):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 12, 0), (None, "a b c d e f g h i j k", 0), (3, "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, kept int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op10_quality_rules(spark, str(tmp_path)).toPandas()
    assert len(got) == 5 and sorted(got.kept) == [False] * 4 + [True]
    empty = quality_rules(spark.createDataFrame([], "doc_id long, text string"), None)
    assert empty.count() == 0
    zeros = {c: np.zeros(0, np.int64) for c in COUNTS}
    assert calibrated(zeros, np.zeros(0, bool)) is None


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


def test_regular_words_and_lines_are_told_apart():
    for n in (1024, 2048, 4096, 8192):
        for a, b in ("ab", "th", "01"):
            x, y = thue_morse(n, a, b)
            texts = [f"{x}\n{y}", f"{x}\n{y}\n{x}", " ".join([x, y, "c", "d", "e", y, x, "c", "d", "e"])]
            stats = statistics(pa.array(texts))
            assert [tuple(int(stats[c][i]) for c in COUNTS[:5]) for i in range(3)] == [brute(t) for t in texts]


def test_statistics_do_not_rest_on_fingerprints(monkeypatch):
    from batchloom.llm import textkernel

    monkeypatch.setattr(textkernel, "span_hashes", lambda data, s, e: (e - s).astype(np.uint64))  # spans of one length collide
    monkeypatch.setattr(textkernel, "mix", lambda h: h & np.uint64(1))
    stats = statistics(pa.array(ODD))
    assert [tuple(int(stats[c][i]) for c in COUNTS[:5]) for i in range(len(ODD))] == [brute(t) for t in ODD]


def brute_path(x, trees, norm):
    """Score of one row by walking each tree by hand."""
    total = 0.0
    for feature, value, left, length in zip(*trees, strict=True):
        node = 0
        while left[node]:
            node = left[node] + int(x[feature[node]] >= value[node])
        total += length[node]
    return 2 ** (-total / len(trees[0]) / norm)


def test_forest_scores_and_threshold_equal_brute_force():
    rng = np.random.default_rng(4)
    n = 600
    words = rng.integers(20, 400, n)
    stats = {c: np.zeros(n, np.int64) for c in COUNTS}
    stats |= {"n_words": words, "word_chars": words * 5 + rng.integers(0, 50, n), "n_upper": rng.integers(0, 30, n), "n_symbols": np.zeros(n, np.int64)}
    good = np.arange(n) % 10 > 0
    stats["n_symbols"][~good] = words[~good] // 2
    grow = rng.random(n) < 0.5
    forest = calibrated(stats, good, grow)
    x = features(stats)
    scores = forest.scores(x)
    trees = (forest.feature, forest.value, forest.left, forest.length)
    assert np.allclose(scores[:20], [brute_path(row, trees, forest.norm) for row in x[:20]])
    clean, poor = np.sort(scores[good & ~grow]), np.sort(scores[~good & ~grow])
    highest = clean[len(clean) - 1 - int(FALSE_RATE * len(clean))]
    assert np.isclose(forest.threshold, (highest + np.quantile(poor, 0.1)) / 2) and (scores[~good] >= forest.threshold).all() and (scores[good] < forest.threshold).mean() > 0.99
    again = calibrated(stats, good, grow)
    assert (again.scores(x) == scores).all()


def test_contradicting_labels_and_repeated_ids(spark):

    rows = [(i, i % 2) for i in range(40)] + [(3, 0), (3, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r.doc_id: r.label for r in labelled_sample(labels, "quality").collect()}
    assert got == {i: i % 2 for i in range(40) if i != 3}
