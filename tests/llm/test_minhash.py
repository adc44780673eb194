import random
import re

import numpy as np
import pyarrow as pa
import pytest
from batchloom.llm import minhash, textkernel
from batchloom.llm.minhash import BANDS, ROWS, elements, near_duplicates, one_of_each_group, shingle_keys, shingle_numbers, sketches
from batchloom.llm.textkernel import BLOCK
from tests.llm.test_token_counts import regular


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}é" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = text(60), []
    base = text(120)
    for i in range(60):  # copies near the threshold, so that the leader misses some
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append(" ".join(words))
    rows += [" ".join(text(10) + passage + text(10)) for _ in range(30)]
    rows += [" ".join(base)] * 25 + ["A b", "a  B\t", "a b c", "", None, " \n ", "a b c d e", "A B C D E ", "x"]
    rows += [" ".join(text(n)) for n in (1, 3, 5, 6, 40, 3000)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("block", [8, 512])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)  # small blocks: pairs of blocks of one bucket
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(rows).collect()) == [(0, 0, True), (3, 3, True), (3, 3, True)]


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.85):
        common, own = int(1000 * share), (1000 - int(1000 * share)) // 2
        pool = rng.integers(1, 1 << 47, 1000).astype(np.uint64)
        a, b = pool[: common + own], np.concatenate([pool[:common], pool[common + own :]])
        s = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert s.shape == (2, BANDS * ROWS) and (s != 0xFFFFFFFFFFFFFFFF).all()
        assert abs((s[0] == s[1]).mean() - share) < 0.12
    one = sketches(np.array([5], np.uint64), np.array([0, 1, 1]))
    assert (one[0] != 0xFFFFFFFFFFFFFFFF).all() and (one[1] == 0xFFFFFFFFFFFFFFFF).all()


def test_blocks_do_not_change_shingles():
    text = "Wort " * 9 + " ".join(f"w{i}" for i in range(300_000))
    assert len(text) > BLOCK
    keys, firsts = shingle_keys(pa.array([text, "a b c d e f"]))
    assert np.diff(firsts).tolist() == [len(shingles(text)), 2]
    alone, _ = shingle_keys(pa.array(["a b c d e f"]))
    assert set(elements(keys, 2)[firsts[1] :].tolist()) == set(elements(alone, 1).tolist())


def test_regular_words_are_told_apart(spark):
    rows, i = [], 0
    for n in (1024, 2048, 4096, 8192):
        for a, b in ("ab", "th"):
            x, y = regular(n, a, b)
            for text in (x, y, f"{x} {y}", f"{y} {x}", f"{x} {x} {x} {x} {x} {y}", f"{x} {x} {x} {x} {x} {x}"):
                rows.append((i, text))
                i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_links_do_not_rest_on_fingerprints(monkeypatch):
    monkeypatch.setattr(minhash, "span_hashes", lambda data, s, e: np.ones(len(s), np.uint64))
    monkeypatch.setattr(textkernel, "span_hashes", lambda data, s, e: np.ones(len(s), np.uint64))
    texts = pa.array(["a b c d e f g", "a b c d e f h", "x y z", "x y z", "q r s", "", "p q r s t u v"])
    found = minhash.Shingles(texts)
    assert found.counts.tolist() == [len(shingles(t)) for t in texts.to_pylist()]
    numbers, firsts = shingle_numbers(texts)
    sets = [set(numbers[a:b].tolist()) for a, b in zip(firsts, firsts[1:])]
    want = [shingles(t) for t in texts.to_pylist()]
    assert [[len(x & y) for x in sets] for y in sets] == [[len(x & y) for x in want] for y in want]


@pytest.mark.parametrize("copies", ["exact", "near"])
def test_one_group_of_half_the_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(minhash, "PART_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(90)]
    rows = []
    for i in range(300):
        words = list(base) if i % 2 else [rng.choice(vocab) for _ in range(60)]
        if i % 2 and copies == "near":
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(90)] = rng.choice(vocab)
        rows.append((1000 - i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == brute(rows)


def test_an_id_with_several_texts(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "one two  three four five six seven")
    rows = [(3, a, {"k": "v"}), (3, b, {"k": "w"}), (4, c, None), (3, a, {"k": "v"}), (None, a, None), (5, None, None), (6, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,string>")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df.filter("doc_id IS NOT NULL")).collect())
    assert got == [(3, 3, True)] * 3 + [(4, 3, False), (5, 5, True), (6, 6, True)]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in one_of_each_group(df).collect()))
    assert kept == sorted([(3, a), (3, b), (0, a), (5, ""), (6, " ")])
