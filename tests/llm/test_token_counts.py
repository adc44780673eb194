import random
import string

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from batchloom.llm.token_counts import CUT, PieceCounter, count_tokens, crosses_spaces, leaves_texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "x▁y", "▁", " ▁", "<s>hi</s> <unk>", "<0x0A>", "a\nb\n\n c\t", "\0a", "é", "﻿x y", "\U0001f600 \U0001f600", "a　b\xa0c", "word " * 3000, "x" * 5000, "漢字かな " * 50]


def test_equals_library_on_odd_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, None, ODD[6]])]
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()}
    for i, t, _ in rows:
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(model.encode(t or ""))), t
    assert len(got) == len(rows)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_equals_library_on_any_text(texts):
    with open(PATH, "rb") as f:
        counter = PieceCounter(f.read())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert counter.counts(pa.array(texts))[1].tolist() == [len(x) for x in counter.model.encode(texts)]


def test_vocabulary_check():
    assert crosses_spaces(["a▁b"]) and not crosses_spaces(["▁▁", "▁ab"])


def regular(n, a, b):
    """A Thue-Morse word of n letters and its complement: linear fingerprints take them for one."""
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word[:n], word[:n].translate(str.maketrans(a + b, b + a))


def counter():
    with open(PATH, "rb") as f:
        return PieceCounter(f.read())


def test_regular_words_equal_library():
    c = counter()
    for n in (1024, 2048, 4096, 8192):
        for a, b in ("ab", "th", "01", "xy"):
            texts = [" ".join(regular(n, a, b)), "".join(regular(n, a, b)), regular(n, a, b)[1]]
            assert c.counts(pa.array(texts))[1].tolist() == [len(x) for x in c.model.encode(texts)]


def test_long_texts_and_long_runs_equal_library():
    rng, c = random.Random(3), counter()
    runs = ["".join(rng.choice(letters) for _ in range(n)) for letters in (string.ascii_letters + string.digits + "+/=", "abcdefgh", "é漢\x01a") for n in (511, 512, 513, 40_000)]
    texts = [*runs, "x" + " " * 900 + "y", "▁" * 700, "x▁" * 500, "\n" * 900]
    assert c.counts(pa.array(texts))[1].tolist() == [len(x) for x in c.model.encode(texts)]
    long = "  ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(500_000))
    assert len(long) > 2 * CUT and c.counts(pa.array([long]))[1].tolist() == [len(c.model.encode(long))]


def test_counts_do_not_rest_on_fingerprints(monkeypatch):
    from batchloom.llm import textkernel

    monkeypatch.setattr(textkernel, "span_hashes", lambda data, s, e: (e - s).astype("uint64"))
    c = counter()
    texts = ["one two six ten", "two one ten six two", "aaa bbb"]
    assert c.counts(pa.array(texts))[1].tolist() == [len(x) for x in c.model.encode(texts)]


def test_other_normalisers_are_noticed():
    class Folding:
        def normalize(self, text):
            return "▁" + " ".join(text.split()).replace(" ", "▁")

        def encode(self, text):
            return text

        decode = encode

    assert leaves_texts(counter().model) and not leaves_texts(Folding())
