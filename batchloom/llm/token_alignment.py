"""Operator 13: tokens of two tokenizers aligned by packed bitsets of their ends, and links counted over the corpus.

Both tokenizers read a space and the text: A (byte-level BPE) gets it in front, B (pieces) adds it. A block of texts is one
run of bytes; A's and B's token ends are two bitsets over it. Their AND holds the shared cuts. Rank, from popcounts of
64-bit words, turns a cut into how many tokens end up to there, which gives each group its token ranges. Links expand from
the OR: between two neighbouring ends of either tokenizer lies one stretch of bytes that one A token and one B token cover,
and each overlapping pair has exactly one such stretch, so ranks before the ends name all linked pairs.

Neither tokenizer merges across the limit between a character that is no white space and a space after it, so texts are cut
there, and each distinct part of a block goes to the libraries once (``TABLE`` bounds what a task remembers). Where a model
does not allow that, whole texts are encoded. Parts whose tokens do not give back their bytes make their text count as
without tokens.

Link counts need the whole corpus. A block is stored as one row a text, with its distinct linked pairs by number and how
often it has them, and one row a pair of the block. Pairs are summed over blocks (at most A's times B's entries, and one row
a pair and block before, whatever the texts repeat); the sums, with the mark of the highest for each B id, go back to the
blocks by a shuffle, and each block adds up its texts. So neither texts nor occurrences are shuffled and nothing is broadcast.

Edge cases: a null or empty text, and one whose tokens are not its bytes, has no tokens, zeros and an empty column for the
groups; such texts add nothing to the counts; a null id stays null; repeated rows count each; a text longer than ``BLOCK`` is
walked in stretches that end where it may be cut, so memory follows a stretch and the text's distinct pairs; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import map_groups, map_texts, scratch, stored, table
from batchloom.llm.textkernel import buffers, distinct_spans
from batchloom.llm.token_counts import crosses_spaces, default_model, leaves_texts

#: Bytes of a block, and of a stretch of a longer text.
BLOCK = 1 << 21
#: Distinct parts whose tokens a task remembers, and their bytes.
TABLE, TABLE_BYTES = 800_000, 1 << 25
PAIR_SHIFT = 32
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True

_TEXT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_NAMES = [x.split()[0] for x in _TEXT.split(", ")]
SCHEMA = f"block bigint, kind int, {_TEXT}, pairs array<bigint>, often array<bigint>"


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in
    order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[1:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()


def end_bits(ends: np.ndarray, n: int) -> np.ndarray:
    """A bitset of ``n`` bytes as 64-bit words: bit k is set if a token ends after byte k."""
    marks = np.zeros(-(-n // 64) * 64, bool)
    marks[ends - 1] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def places(bits: np.ndarray) -> np.ndarray:
    """Select: the numbers of all set bits, in order."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


class Rank:
    """How many bits of a bitset are set before a place."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.append(bits, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    def __call__(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Alignment:
    """Groups and links of the tokens over one run of bytes (``a_ends``, ``b_ends``: ends of tokens that cover it)."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray, n: int):
        a, b = end_bits(a_ends, n), end_bits(b_ends, n)
        rank_a, rank_b = Rank(a), Rank(b)
        self.cuts = places(a & b)
        self.group_a, self.group_b = (np.concatenate([[0], rank(self.cuts + 1)]) for rank in (rank_a, rank_b))
        stretch = places(a | b)
        self.link_ends, self.link_a, self.link_b = stretch, rank_a(stretch), rank_b(stretch)


class Entries:
    """Byte strings by number, to be gathered many at a time."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All strings in a row, and where each begins (one more at the end)."""
        sizes = self.sizes[numbers]
        limits = np.concatenate([[0], np.cumsum(sizes)])
        return self.bytes[np.repeat(self.firsts[numbers] - limits[:-1], sizes) + np.arange(limits[-1])], limits


class Lists:
    """Lists of integers by number, one after the other in an array that grows."""

    def __init__(self):
        self.flat, self.used, self.counts, self.firsts, self.n = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Add lists; returns their integers in a row, and how many each has."""
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(counts) > len(self.counts):
            self.counts, self.firsts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.firsts))
        self.flat[self.used : self.used + len(flat)] = flat
        self.counts[self.n : self.n + len(counts)] = counts
        self.firsts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.used, self.n = self.used + len(flat), self.n + len(counts)
        return flat, counts

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of lists one after the other, and how many each list has."""
        counts = self.counts[numbers]
        before = np.cumsum(counts) - counts
        return self.flat[np.repeat(self.firsts[numbers] - before, counts) + np.arange(counts.sum())], counts


def part_limits(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """First bytes of the parts of texts (``texts``: their first bytes) that both tokenizers encode on their own: a part ends
    before a space that follows a character that is no white space."""
    begin = data == 0x20
    if len(data) > 1:
        last = data[:-1]
        begin[1:] &= ~_SPACES[last]
    if len(data) > 2:  # the last two bytes of white space beyond ASCII, and of some other characters, do not end a part
        two, one = data[:-2], data[1:-1]
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (two == 0x80) & (one >= 0x80) & (one <= 0xAF) | (two == 0x9A) & (one == 0x80) | (two == 0x81) & (one == 0x9F)
        begin[2:] &= ~wide
    begin[texts] = True
    return np.flatnonzero(begin)


class Tokenizers:
    """Tokens of texts by both libraries, and their alignment, for one task."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        kind = json.loads(a_json)
        split = kind.get("pre_tokenizer") or {}
        self.whole = crosses_spaces(names) or not leaves_texts(self.b) or kind.get("normalizer") is not None or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space", False)
        level = byte_level_bytes()
        size = self.a.get_vocab_size()
        a_bytes = [bytes(level[c] for c in x) if (x := self.a.id_to_token(i)) and all(c in level for c in x) else (x or "").encode() for i in range(size)]
        b_bytes = [piece_bytes(x, self.b.is_byte(i)) for i, x in enumerate(names)]
        self.entries = (Entries(a_bytes), Entries(b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.decimals = Entries([b"%d," % k for k in range(max(size, len(names)))])
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        """Begin the table of encoded parts anew."""
        self.known.clear()
        self.good, self.ids, self.held = np.zeros(0, bool), (Lists(), Lists()), 0

    def encode(self, parts: list[bytes]) -> None:
        """Add parts, each with its space in front, to the table."""
        texts = [x.decode() for x in parts]
        a_ids = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b_ids = self.b.encode([x[1:] for x in texts], num_threads=1)
        b_ids = [b or [self.space] for b in b_ids]  # the library gives nothing for an empty text
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        good = np.ones(len(parts), bool)
        for entries, lists, ids in zip(self.entries, self.ids, (a_ids, b_ids), strict=True):
            flat, counts = lists.extend(ids)
            good &= same_bytes(entries, flat, counts, parts, sizes)
        self.known.update(zip(parts, range(len(self.good), len(self.good) + len(parts)), strict=True))
        self.good = np.concatenate([self.good, good])
        self.held += int(sizes.sum())

    def parts_of(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First bytes of all parts, each part's number among the distinct ones, and the table's places of these; and which
        of these are good."""
        starts = texts if self.whole else part_limits(data, texts)
        ends = np.append(starts[1:], len(data))
        one, which = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        keys = [raw[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if len(self.good) + len(keys) > TABLE or self.held > TABLE_BYTES:
            self.forget()
        new = [k for k in keys if k not in self.known]
        for lo in range(0, len(new), 4096):
            self.encode(new[lo : lo + 4096])
        at = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        return starts, which, at, self.good[at]

    def align(self, data: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
        """Per text of a run of bytes (``texts``: first bytes, each a space): counts, whether it is good, the bytes of its
        groups, and its linked id pairs with how often it has them."""
        starts, which, at, good = self.parts_of(data, texts)
        text_of = np.searchsorted(texts, starts, "right") - 1
        fine = np.ones(len(texts), bool)
        fine[text_of[~good[which]]] = False
        keep = fine[text_of]
        sizes = np.diff(np.append(starts, len(data)))[keep]
        which, owner = which[keep], text_of[keep]
        out = {"fine": fine, "doc": np.zeros(0, np.int64), "pair": np.zeros(0, np.int64), "often": np.zeros(0, np.int64), "bytes": np.zeros(0, np.uint8), "limits": np.zeros(len(texts) + 1, np.int64)}
        out |= {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        if not len(which):
            return out
        (a, in_a), (b, in_b) = (lists.joined(at[which]) for lists in self.ids)
        n = int(sizes.sum())
        found = Alignment(np.cumsum(self.entries[0].sizes[a]), np.cumsum(self.entries[1].sizes[b]), n)
        # the good texts' bytes lie one after the other here; a text's last byte is a shared cut
        length = np.bincount(owner, sizes, len(texts)).astype(np.int64)
        limits = np.concatenate([[0], np.cumsum(length)])
        doc_of = lambda place: np.searchsorted(limits, place, "right") - 1  # noqa: E731  texts without bytes are skipped
        group_doc, link_doc = doc_of(found.cuts), doc_of(found.link_ends)
        count = lambda docs: np.bincount(docs, minlength=len(texts))
        out |= {"n_a": np.bincount(owner, in_a, len(texts)).astype(np.int64), "n_b": np.bincount(owner, in_b, len(texts)).astype(np.int64), "n_groups": count(group_doc), "n_links": count(link_doc)}
        pair = a[found.link_a].astype(np.int64) << PAIR_SHIFT | b[found.link_b].astype(np.int64)
        distinct, number = np.unique(pair, return_inverse=True)
        both, often = np.unique(link_doc * len(distinct) + number, return_counts=True)
        out |= {"doc": both // len(distinct), "pair": distinct[both % len(distinct)], "often": often}
        # groups as text: A's ids, a bar, B's ids, a semicolon; in the order of groups, A before B
        order, last_a, last_b = group_order(found.group_a, found.group_b)
        text, where = self.decimals.joined(np.concatenate([a, b])[order])
        text[where[last_a + 1] - 1] = ord("|")
        text[where[last_b + 1] - 1] = ord(";")
        ends = np.concatenate([[0], where[last_b + 1]])[np.concatenate([[0], np.cumsum(out["n_groups"])])]
        return out | {"bytes": text, "limits": ends}


def same_bytes(entries: Entries, ids: np.ndarray, counts: np.ndarray, parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Which parts their tokens give back, byte for byte."""
    total = np.concatenate([[0], np.cumsum(entries.sizes[ids])])
    ends = np.cumsum(counts)
    good = total[ends] - total[ends - counts] == sizes
    data, _ = entries.joined(ids[np.repeat(good, counts)])
    odd = np.flatnonzero(data != np.frombuffer(b"".join([x for x, g in zip(parts, good.tolist(), strict=True) if g]), np.uint8))
    good[np.flatnonzero(good)[np.searchsorted(np.cumsum(sizes[good]), odd, "right")]] = False
    return good


def group_order(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of all tokens (B's after A's) in the order groups are written, and the places in that order of each group's
    last A and last B token."""
    n_a, n_b = np.diff(group_a), np.diff(group_b)
    runs = np.stack([n_a, n_b], axis=1).ravel()
    firsts = np.stack([group_a[:-1], group_a[-1] + group_b[:-1]], axis=1).ravel()
    ends = np.cumsum(runs)
    order = np.repeat(firsts - (ends - runs), runs) + np.arange(ends[-1] if len(ends) else 0)
    return order, ends[0::2] - 1, ends[1::2] - 1


def stretches(data: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
    """A long text's bytes in stretches of about ``BLOCK`` bytes that begin with a part."""
    lo = 0
    while lo < len(data):
        hi = len(data)
        if not whole and lo + BLOCK < hi:
            for at in range(lo + BLOCK, len(data), BLOCK):
                back = at - 2  # two bytes of context
                found = part_limits(data[back : at + BLOCK], np.zeros(0, np.int64)) + back
                found = found[found >= at]
                if len(found):
                    hi = int(found[0])
                    break
        yield data[lo:hi]
        lo = hi


def align_long(both: Tokenizers, data: np.ndarray) -> dict[str, np.ndarray] | None:
    """``align`` of one text in stretches; None if it has no tokens. ``sha`` holds the digest of its groups."""
    total, sha, pairs = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0), hashlib.sha256(), np.zeros(0, np.int64)
    often = np.zeros(0, np.int64)
    for k, part in enumerate(stretches(data, both.whole)):
        got = both.align(part, np.zeros(1, np.int64))
        if not got["fine"][0]:
            return None
        for name in total:
            total[name] += int(got[name][0])
        sha.update((b";" if k else b"") + got["bytes"][:-1].tobytes())
        pairs, number = np.unique(np.concatenate([pairs, got["pair"]]), return_inverse=True)
        often = np.bincount(number, np.concatenate([often, got["often"]])).astype(np.int64)
    return total | {"pair": pairs, "often": often, "sha": sha.hexdigest()}


def block_rows(both: Tokenizers, ids: pa.Array, texts: pa.Array, block: int) -> dict:
    """Rows of a block: kind 1, one a text, with the numbers of its pairs; kind 0, one row with the pairs and their sums."""
    import pyarrow.compute as pc

    n = len(texts)
    data, offsets = buffers(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, "")))
    has = np.flatnonzero(np.diff(offsets))
    counts = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    sha, number, often, doc, pairs, sums = [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(has) == 1 and len(data) > 2 * BLOCK:
        if got := align_long(both, data):
            for k in counts:
                counts[k][has] = got[k]
            sha[has[0]], pairs, sums = got["sha"], got["pair"], got["often"]
            number, often, doc = np.arange(len(pairs)), sums, np.full(len(pairs), has[0])
    elif len(has):
        got = both.align(data, offsets[:-1][has])
        for k in counts:
            counts[k][has] = got[k]
        raw, limits = got["bytes"].tobytes(), got["limits"].tolist()
        for i, fine, s, e in zip(has.tolist(), got["fine"].tolist(), limits, limits[1:], strict=False):
            if fine:
                sha[i] = hashlib.sha256(raw[s : e - 1]).hexdigest()
        pairs, number = np.unique(got["pair"], return_inverse=True)
        often, doc = got["often"], has[got["doc"]]
        sums = np.bincount(number, often, len(pairs)).astype(np.int64)
    cuts = np.concatenate([np.searchsorted(doc, np.arange(n + 1)), [len(doc) + len(pairs)]]).astype(np.int32)
    lists = lambda x, y: pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([x, y])))
    out = {k: pa.array([*v.tolist(), None], pa.int64()) for k, v in counts.items()}
    return out | {
        "block": np.full(n + 1, block), "kind": pa.array([*[1] * n, 0], pa.int32()), "doc_id": pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(1, pa.int64())]),
        "groups_sha256": [*sha, None], "pairs": lists(number, pairs), "often": lists(often, sums),
    }


def summed(rows: pa.Table, limits: list[tuple[int, int]]) -> pa.Table:
    """Texts of whole blocks with ``n_best`` and ``count_sum``, from their rows and the corpus-wide counts of their pairs."""
    kept = []
    for lo, hi in limits:
        part = rows.slice(lo, hi - lo)
        kind = part.column("kind").to_numpy()
        sums, docs = part.filter(pa.array(kind == 0)), part.filter(pa.array(kind == 1)).combine_chunks()
        number = sums.column("number").to_numpy()
        total, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        total[number], best[number] = sums.column("total").to_numpy(), sums.column("best").to_numpy()
        lists = docs.column("pairs").combine_chunks()
        has = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        which, often = lists.flatten().to_numpy(), docs.column("often").combine_chunks().flatten().to_numpy()
        add = lambda v: pa.array(added(has, v, len(lists)))
        kept.append(docs.append_column("n_best", add(often * best[which])).append_column("count_sum", add(often * total[which])))
    return pa.concat_tables(kept).select([*_NAMES, "n_best", "count_sum"])


def added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by place, exact."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def default_bytes_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``doc_id, text``."""
    spark = docs.sparkSession
    models = []
    for path in (a_path or default_bytes_model(), b_path or default_model()):
        with open(path, "rb") as f:
            models.append(spark.sparkContext.broadcast(f.read()))

    def start():
        from pyspark import TaskContext

        both, n = Tokenizers(*(m.value for m in models)), TaskContext.get().partitionId() << 32

        def work(batch: pa.RecordBatch) -> dict:
            nonlocal n
            n += 1
            return block_rows(both, batch.column("doc_id"), batch.column("text"), n)

        return work

    with scratch() as result:
        rows = stored(map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCHEMA, start, limit=BLOCK), "align-blocks")
        each = rows.filter("kind = 0").select("block", F.posexplode(F.arrays_zip("pairs", "often")).alias("number", "x")).select("block", "number", F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
        totals = stored(each.groupBy("pair").agg(F.sum("often").alias("total")), "align-totals")
        by_b = totals.groupBy(F.expr(f"pair & {(1 << PAIR_SHIFT) - 1}").alias("b")).agg(F.max("total").alias("most"))
        marked = totals.withColumn("b", F.expr(f"pair & {(1 << PAIR_SHIFT) - 1}")).join(by_b, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
        back = each.join(marked, "pair").select("block", F.lit(0).alias("kind"), F.col("number").cast("long").alias("number"), "total", "best")
        both = rows.filter("kind = 1").unionByName(back, allowMissingColumns=True)
        out = map_groups(both, ["block"], f"{_TEXT}, n_best bigint, count_sum bigint", summed)
        return result(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "aligned")


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
