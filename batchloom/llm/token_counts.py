"""Operator 1: token counts of whole texts, counting the pieces of each distinct pre-token once.

A pre-token is a run of spaces with the characters up to the next space. The model is probed: where its normaliser leaves
texts as they are and no piece has a space after another character (merges then never cross a pre-token's limit), a text's
count is the sum over its pre-tokens; other models count whole texts. In a task, the texts' pre-tokens become fingerprints
that are confirmed by bytes, the distinct ones are joined to a table of piece counts keyed by their bytes (only new ones go
to the tokenizer), and the counts are weighted by frequency and summed for each document.

The join stays inside the task: a shuffled table of distinct pre-tokens and per-document frequencies would move 2.7 times the
input here (9.1 million distinct ones of a block for 26.6 million pre-tokens). A task's table is bounded by ``TABLE`` entries
(it starts anew beyond them), so a pre-token is counted once a task and table. The library has no count without ids: the ids
of one new pre-token at a time exist inside its call and are dropped there; no document's ids ever exist.

Texts longer than ``CUT`` bytes are walked in parts that end before a pre-token. Pre-tokens longer than ``LONG`` bytes are
cut between characters that stand side by side in no piece, which no merge crosses. A run that cannot be cut even so goes to
the library whole, and takes memory in proportion there.

Edge cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; a null id stays
null; repeated rows give repeated results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import map_texts, table

TABLE = 400_000
LIMIT = 4096
CUT, LONG = 1 << 20, 512
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"
#: Texts that show whether a model's normaliser changes anything.
PROBES = ("a", " a ", "  a  b ", "\t\n\r", "Ａﬁ①", "é é", "　x\xa0y", "\0\x01\x7f", "A a", "한 국", "\U0001f600")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def crosses_spaces(pieces: list[str]) -> bool:
    return any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:], strict=False))


def leaves_texts(model) -> bool:
    """The model takes texts as they are: one space in front, spaces as the piece separator, nothing else changed."""
    return all(model.normalize(p) == "▁" + p.replace(" ", "▁") and model.decode(model.encode(p)) == p for p in PROBES)


class PieceCounter:
    """Counts of pieces for blocks of texts, for one worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = crosses_spaces(names) or not leaves_texts(self.model)
        self.neighbours = {p[k : k + 2] for p in names for k in range(len(p) - 1)}
        self.known: dict[bytes, int] = {}

    def counts(self, texts) -> tuple:
        """Bytes and tokens of each text of a string array without nulls."""
        import numpy as np
        import pyarrow.compute as pc

        from batchloom.llm.textkernel import buffers

        n_bytes = pc.binary_length(texts).cast("int64")
        if self.whole:
            return n_bytes, np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)
        texts = pc.replace_substring(texts, "▁", " ")  # the model takes both for a space
        if len(texts) == 1 and n_bytes[0].as_py() > 2 * CUT:
            data, _ = buffers(texts)
            parts = (self.spans(np.concatenate([np.full(int(lo == 0), 0x20, np.uint8), data[lo:hi]]), None) for lo, hi in text_parts(data))
            return n_bytes, np.array([sum(int(x[0]) for x in parts)], np.int64)
        data, offsets = buffers(pc.if_else(pc.equal(n_bytes, 0), texts, pc.binary_join_element_wise(" ", texts, "")))
        return n_bytes, self.spans(data, offsets) if len(data) else np.zeros(len(texts), np.int64)

    def spans(self, data, offsets):
        """Tokens of texts that each begin with a space."""
        import numpy as np

        from batchloom.llm.textkernel import distinct_spans

        offsets = np.array([0, len(data)]) if offsets is None else offsets
        space = data == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        one, number = distinct_spans(data, starts, ends)
        each = np.zeros(len(one), np.int64)
        if len(self.known) > TABLE:
            self.known.clear()
        raw, new = data.tobytes(), []
        for i, (s, e) in enumerate(zip(starts[one].tolist(), ends[one].tolist(), strict=True)):
            if e - s > LONG:
                each[i] = sum(self.pieces([raw[s + 1 : e].decode()], True))
            elif (n := self.known.get(raw[s:e])) is None:
                new.append((i, raw[s:e]))
            else:
                each[i] = n
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            for (i, key), n in zip(some, self.pieces([key[1:].decode() for _, key in some], False), strict=True):
                each[i] = self.known[key] = n
        total = np.concatenate([[0], np.cumsum(each[number])])
        firsts = np.searchsorted(starts, offsets)
        return total[firsts[1:]] - total[firsts[:-1]]

    def pieces(self, tokens: list[str], cut: bool) -> Iterator[int]:
        """Pieces of pre-tokens without the space in front; ``cut``: in runs that no merge crosses."""
        if not cut:
            for ids, text in zip(self.model.encode(tokens, num_threads=1), tokens, strict=True):
                yield len(ids) if text else 1  # a single last space is one piece
            return
        for token in tokens:
            marked = " " + token
            bounds = [k + 1 for k, (a, b) in enumerate(zip(marked.replace(" ", "▁"), token.replace(" ", "▁"), strict=False)) if a + b not in self.neighbours]
            yield from self.runs(marked, [0, *bounds, len(marked)])

    def runs(self, marked: str, limits: list[int]) -> Iterator[int]:
        lone = len(self.model.encode("\n"))
        for lo in range(0, len(limits) - 1, 256):
            some = [marked[a:b] for a, b in zip(limits[lo : lo + 256], limits[lo + 1 : lo + 257], strict=False)]
            # a line break before a run keeps the library's own space away from it
            for run, ids in zip(some, self.model.encode(["\n" + x for x in some], num_threads=1), strict=True):
                yield len(ids) - lone


def text_parts(data, most: int = CUT) -> Iterator[tuple[int, int]]:
    """Limits of parts of a text's bytes of about ``most`` bytes; each part but the first begins with a run of spaces."""
    raw, lo = memoryview(data), 0
    edge = re.compile(rb"[^ ] ")
    while lo < len(data):
        found = edge.search(raw, lo + most) if lo + most < len(data) else None
        hi = found.end() - 1 if found else len(data)
        yield lo, hi
        lo = hi


def count_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the library gives them without begin and end tokens."""
    with open(model_path or default_model(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def start():
        counter = PieceCounter(model.value)

        def work(batch):
            n_bytes, n_tokens = counter.counts(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n_tokens}

        return work

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), SCHEMA, start)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
