import math
import random
import string
import time
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from batchloom.llm import segment as module
from batchloom.llm.segment import Pieces, decode, decode_rows, encode, segment
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.test_token_counts import ODD, PATH, regular

with open(PATH, "rb") as f:
    PIECES = Pieces(f.read())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
def test_round_trip_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, limits = encode(texts, np.arange(len(texts), dtype=np.uint64), PIECES)
    assert decode(ids, limits, PIECES) == [t.encode() for t in texts]


def test_samples_follow_the_lattice():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "token"
    logs = {sp.id_to_piece(int(i)): p for i, p in zip(PIECES.ids, PIECES.logs, strict=True)}

    def paths(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in logs:
                for tail, p in paths(rest[n:]):
                    yield (rest[:n], *tail), p + logs[rest[:n]]

    weight = {k: math.exp(p) for k, p in paths("▁" + text)}
    total, n = sum(weight.values()), 20_000
    ids, limits = encode([text] * n, np.arange(n, dtype=np.uint64), PIECES)
    seen = Counter(tuple(sp.id_to_piece(int(i)) for i in ids[a:b]) for a, b in zip(limits, limits[1:], strict=False))
    assert len(seen) > 3
    for k, w in weight.items():
        p = w / total
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4, k


def test_rows_do_not_depend_on_partitions(spark):
    rows = [(i, t, 5) for i, t in enumerate([*ODD, None, "Ein Satz für die Probe " * 40])] + [(None, "x y", 5), (3, ODD[3], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    a, b = (sorted((tuple(r) for r in segment(x).collect()), key=repr) for x in (df.coalesce(1), df.repartition(7)))
    assert a == b and all(r[3] for r in a) and len(a) == len(rows)
    back = {r.doc_id: r.text for r in decode_rows(segment(df)).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert decode_rows(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""
    assert segment(df.filter("false")).count() == 0


def words(n, letters, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_segments_of_long_runs_do_not_change_samples(monkeypatch):
    runs = [words(n, letters) for n in (513, 700, 5000) for letters in (string.ascii_letters + string.digits, "ab", "é漢字a")]
    texts = [*runs, f"{runs[1]} x {runs[1]} y {runs[2]}"]
    keys = np.arange(len(texts), dtype=np.uint64)
    monkeypatch.setattr(module, "LONG", 10**9)
    whole = encode(texts, keys, PIECES)
    monkeypatch.setattr(module, "LONG", 64)
    for stretch in (256, 1024, 1 << 16):
        monkeypatch.setattr(module, "STRETCH", stretch)
        ids, limits = encode(texts, keys, PIECES)
        assert (limits == whole[1]).all() and (ids == whole[0]).all()


def test_long_texts_are_walked_in_parts(monkeypatch):
    text = " ".join(words(1 + i % 9, "etaoin", i) for i in range(5000))
    whole = encode([text], np.array([5], np.uint64), PIECES)[0]
    monkeypatch.setattr(module, "BLOCK", 1000)
    ids, limits = encode([text], np.array([5], np.uint64), PIECES)
    assert (ids == whole).all() and decode(ids, limits, PIECES) == [text.encode()]


def test_time_follows_the_length_of_a_run():
    for letters in (string.ascii_lowercase, "a"):
        text = words(1 << 19, letters)
        begin = time.monotonic()
        ids, limits = encode([text], np.zeros(1, np.uint64), PIECES)
        assert time.monotonic() - begin < 30 and decode(ids, limits, PIECES) == [text.encode()]


def test_regular_words_come_back():
    for n in (1024, 8192):
        for a, b in ("ab", "th"):
            texts = [" ".join(regular(n, a, b)), regular(n, a, b)[1]]
            ids, limits = encode(texts, np.arange(2, dtype=np.uint64), PIECES)
            assert decode(ids, limits, PIECES) == [t.encode() for t in texts]


def test_copies_are_sampled_anew_wherever_they_lie(spark, monkeypatch):
    text = "reproducible sampled segmentations of one document " * 3
    rows = [(1, text)] * 4 + [(2, text), (None, text), (None, text), (1, text + "."), (3, None), (3, None), (3, "")] + [(4, text)] * 9
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, copy int")
    plain = {(r.doc_id, tuple(r.ids)) for r in segment(df).collect()}
    want = sorted((tuple(r) for r in segment(df.repartition(1), copies=True).collect()), key=repr)
    assert len(want) == len(rows) and all(r[-1] for r in want)
    monkeypatch.setattr(module, "COPIES", 2)
    for parts in (1, 4, 7):
        assert sorted((tuple(r) for r in segment(df.repartition(parts), copies=True).collect()), key=repr) == want
    for i, n in ((1, 5), (4, 9), (None, 2)):
        some = [r for r in want if r[0] == i]
        assert len({tuple(r[3]) for r in some}) == n and sorted(r[1] for r in some) == sorted([*range(n)] if i != 1 else [0, 0, 1, 2, 3])
    assert {(i, tuple(ids)) for i, k, _, ids, _ in want if k == 0} == plain
    assert segment(df.filter("false"), copies=True).count() == 0
