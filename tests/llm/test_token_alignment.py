import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from batchloom.llm import token_alignment
from batchloom.llm.token_alignment import Alignment, Rank, Tokenizers, align_documents, byte_level_bytes, end_bits, op13_align_tokens, places
from tokenizers import Tokenizer

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows):
    """Whole texts by the libraries; every pair of tokens compared by their ranges, links counted in one table."""
    a, b = libraries()
    level = byte_level_bytes()
    done, table = [], Counter()
    for i, text in rows:
        links, groups, ta, tb = [], [], [], []
        if text:
            ta = [(k, bytes(level[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
            if not b"".join(x for _, x in ta) == b"".join(x for _, x in tb) == (" " + text).encode():
                ta, tb = [], []
        spans = []
        for tokens in (ta, tb):
            at, mine = 0, []
            for k, x in tokens:
                mine.append((k, at, at + len(x)))
                at += len(x)
            spans.append(mine)
        low = 0
        for k, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            j = low
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((k, spans[1][j][0]))
                j += 1
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        before = 0
        for c in shared:
            groups.append("|".join(",".join(str(k) for k, s, e in x if before <= s and e <= c) for x in spans) if len(text) < 5000 else "")
            before = c
        table.update(links)
        done.append((i, len(ta), len(tb), len(shared), links, ";".join(groups) if shared else None, text))
    best = Counter()
    for (_, y), n in table.items():
        best[y] = max(best[y], n)
    return [
        (i, na, nb, ng, len(links), sum(table[x] == best[x[1]] for x in links), sum(table[x] for x in links), "" if text is None else hashlib.sha256(text.encode()).hexdigest() if len(whole) < 5000 else None)
        for i, na, nb, ng, links, text, whole in ((*d[:6], d[6] or "") for d in done)
    ]


SPACES = [" ", "  ", "   ", "\n", "\n ", " \n", "\t", "\xa0", "\xa0 ", " ", "  ", "　", "　 ", "\x85 ", "\x1c ", " \r\n ", "  "]
WORDS = ["the", "Bäume", "l'été", "don't", "1234567", "naïve", "日本語", "😀", "<|endoftext|>", "</s>", "<0x41>", "x_y", "--", "#", "é", "ß", "aaaaaaaaaaaaaaaa", "\x00", "ﬁ", "I'll", "한국", "​", "0"]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) + r.choice(SPACES if r.random() < 0.6 else ["", " "]) for _ in range(r.randrange(1, 40))) for _ in range(n)]


TEXTS = [None, "", " ", "  ", "a", "a ", " a", "a▁b and more", "▁", "hello world", "hello world", "\n", "é" * 50, "word " * 700, "x" * 3000, "<|endoftext|> <s> hi", "\U0010ffff", "tail  ", "\r\n\r\n a", "<unk>"]


def test_equal_to_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + odd_texts(300))] + [(None, "null id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, block int, kind string, n_a long")
    got = align_documents(df.repartition(5))
    assert got.columns == NAMES and [f.dataType.simpleString() for f in got.schema] == [*["bigint"] * 7, "string"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[5] < w[4] for w in want)
    assert align_documents(df.coalesce(1)).exceptAll(got).isEmpty()
    assert align_documents(df.filter("false")).count() == 0
    assert align_documents(df.filter("text IS NULL OR text = ''")).filter("n_a + n_b + n_links + count_sum > 0 OR groups_sha256 <> ''").isEmpty()


def test_small_blocks_and_tables_change_nothing(spark, monkeypatch):
    texts = [*odd_texts(60, 7), "  ".join(odd_texts(80, 8)), "y" * 9000, "z ▁ " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(tuple(r) for r in align_documents(df).collect())
    models = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    import pyarrow as pa

    both = Tokenizers(*models)
    one = {}
    for block, table in ((1 << 21, 300_000), (700, 40)):
        monkeypatch.setattr(token_alignment, "BLOCK", block)
        monkeypatch.setattr(token_alignment, "TABLE", table)
        for i, t in enumerate(texts):
            rows = token_alignment.block_rows(both, pa.array([i]), pa.array([t]), 1)
            one.setdefault(i, []).append([list(rows["groups_sha256"]), rows["n_a"].to_pylist(), rows["n_links"].to_pylist(), sorted(zip(rows["pairs"].to_pylist()[1], rows["often"].to_pylist()[1], strict=True))])
    for i, (a, b) in one.items():
        assert a == b and (a[0][0], a[1][0]) == (want[i][7], want[i][1])


def test_whole_texts_where_parts_do_not_stand_alone():
    models = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    both = Tokenizers(*models)
    assert not both.whole
    text = (" " + " ".join(odd_texts(5, 3))).encode()
    data = np.frombuffer(text, np.uint8)
    parts = both.align(data, np.zeros(1, np.int64))
    both.forget()
    both.whole = True
    for k, v in both.align(data, np.zeros(1, np.int64)).items():
        assert np.array_equal(v, parts[k])
    assert Tokenizers(models[0].replace(b'"normalizer":null', b'"normalizer":{"type":"Lowercase"}'), models[1]).whole or b'"normalizer":null' not in models[0]


def test_bitsets():
    r = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(r.integers(1, n + 1, n // 3), n)) for _ in range(2))
        bits = end_bits(a, n)
        assert places(bits).tolist() == (a - 1).tolist()
        assert Rank(bits)(np.arange(n + 1)).tolist() == [int((a <= k).sum()) for k in range(n + 1)]
        found = Alignment(a, b, n)
        assert found.cuts.tolist() == sorted(set((a - 1).tolist()) & set((b - 1).tolist()))
        starts = [np.concatenate([[0], x[:-1]]) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == sorted(want)


def test_query(spark):
    got = op13_align_tokens(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {w[0]: w for w in brute(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[:7] == want[r.doc_id][:7] and want[r.doc_id][7] in (None, r.groups_sha256)


def test_a_very_long_text(spark):
    text = "\n".join(odd_texts(36_000, 11)) + " " + "q" * 20_000
    assert len(text.encode()) > 2 * token_alignment.BLOCK
    (r,) = align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = brute([(1, text)])[0]
    assert tuple(r)[:7] == want[:7]


@pytest.mark.parametrize("text", ["a b", "a  b", "a\n b", "a\n  b", "a\xa0 b", "a　 b", "à b", "日 本", "a \n b"])
def test_parts_join_to_whole_texts(text):
    a, b = libraries()
    models = [open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    both = Tokenizers(*models)
    data = np.frombuffer((" " + text).encode(), np.uint8)
    _, which, at, good = both.parts_of(data, np.zeros(1, np.int64))
    assert good.all()
    assert both.ids[0].joined(at[which])[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
    assert both.ids[1].joined(at[which])[0].tolist() == b.encode(text)
