"""Operator 5: sampled segmentation into pieces by forward filtering and backward sampling, and lossless decoding.

A text's lattice has a node after every character and an edge for every piece of the vocabulary that matches there; a
character that no piece covers has an edge of its byte pieces. The model file has merge ranks instead of probabilities, so
pieces get the probabilities of a Zipf law over their ranks, raised to ``ALPHA`` (below 1: flatter). Forward filtering
gives each node the total weight of the paths that reach it; backward sampling walks from the end, choosing each last piece
with its exact conditional probability. Uniform numbers are hashed from the row's key and the place in the text: the same
row gets the same pieces wherever and whenever it is processed.

No piece spans a space after another character, nor a character that occurs in no longer piece, so the lattice falls apart
into pre-tokens there. Forward filtering runs once for each distinct pre-token of a block, all in step by numpy; sampling
runs for every occurrence, all in step as well. Pre-tokens longer than ``LONG`` characters are cut into segments of ``STEPS``
nodes: the weights at a segment's end are a linear function of those before it, so all segments find that function in step,
a short chain of small matrix products gives the weights at every limit, and the segments are filtered in step again, from
the last stretch of ``STRETCH`` characters to the first, while sampling walks back through them. The result is exact; time
follows the length, and memory a stretch. Texts longer than ``BLOCK`` characters are walked in parts that end before a
pre-token.

Decoding joins the pieces' bytes and takes off the space that encoding put before the text: white space, control
characters and the piece separator itself (U+2581, encoded by its bytes) come back as they were.

Edge cases: a null or empty text has no pieces and decodes to an empty text; a null key is a key like any other; repeated
rows get the same pieces; texts of any length are processed whole; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import map_texts, table
from batchloom.llm.textkernel import distinct_spans, mix
from batchloom.llm.token_counts import crosses_spaces, default_model

ALPHA = 0.5
SEED = 17
#: Bytes of texts in a block (larger blocks repeat more pre-tokens, and take more memory), and characters of a long text's parts.
TEXTS, BLOCK = 1 << 21, 1 << 20
#: Characters of a pre-token that is filtered in segments, nodes of a segment, and characters of a stretch of segments.
LONG, STEPS, STRETCH = 512, 256, 1 << 16
_MARK = 0x2581
#: Stands for a separator that was in the text; no piece has it.
_LITERAL = 0x110000
_ZIPF_SHIFT = 10.0
_BYTE_LOG = -15.0
_SIEVE = np.uint64(44)


def longer(prints: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Fingerprints of spans with one character more."""
    h = (prints ^ (chars + np.uint64(1))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """The vocabulary as lookup tables."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in ids]
        if crosses_spaces(names):
            raise ValueError("the vocabulary has pieces with a space after another character")
        ranks = np.arange(len(ids)) + _ZIPF_SHIFT
        logs = alpha * (-np.log(ranks) - np.log((1 / ranks).sum()))
        prints = np.zeros(len(names), np.uint64)
        for size in range(max(map(len, names))):
            some = [i for i, x in enumerate(names) if len(x) > size]
            prints[some] = longer(prints[some], np.array([ord(names[i][size]) for i in some], np.uint32))
        if len(np.unique(prints)) < len(prints):
            raise ValueError("two pieces have one fingerprint")
        order = np.argsort(prints)
        self.prints, self.ids, self.logs = prints[order], np.array(ids, np.int32)[order], logs[order].astype(np.float32)
        top = (self.prints >> _SIEVE).astype(np.int64)
        self.bucket = np.searchsorted(top, np.arange(1 << 20)).astype(np.int32)  # first place with these upper bits
        self.bucket[np.setdiff1d(np.arange(1 << 20), top)] = -1
        self.deepest = int(np.unique(top, return_counts=True)[1].max())
        self.prints = np.append(self.prints, np.zeros(self.deepest, np.uint64))
        self.longest = max(map(len, names))
        self.lone = np.ones(_LITERAL + 1, bool)  # characters of no longer piece
        self.lone[np.unique(np.frombuffer("".join(x for x in names if len(x) > 1).encode("utf-32-le"), np.uint32))] = False
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log = alpha * _BYTE_LOG
        texts = [b""] * sp.get_piece_size()
        for i, x in zip(ids, names, strict=True):
            texts[i] = x.replace("▁", " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([b])
        self.lengths = np.array([len(x) for x in texts])
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are pieces, and their places in the tables."""
        first = self.bucket[(prints >> _SIEVE).view(np.int64)]
        maybe = np.flatnonzero(first >= 0)
        keys, at = prints[maybe], first[maybe]
        place = np.full(len(maybe), -1, np.int32)
        for k in range(self.deepest):
            hit = self.prints[at + k] == keys
            place[hit] = at[hit] + k
        found = place >= 0
        return maybe[found], place[found]

    def joined_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces one after the other, and where each piece's begin (one more at the end)."""
        lengths = self.lengths[ids]
        limits = np.concatenate([[0], np.cumsum(lengths)])
        return self.bytes[np.repeat(self.firsts[ids] - limits[:-1], lengths) + np.arange(limits[-1])], limits


def utf8_bytes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, in a matrix of four columns, and how many each has."""
    c = np.where(codes == _LITERAL, _MARK, codes).astype(np.int64)
    n = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    lead = np.choose(n - 1, [c, 0xC0 | c >> 6, 0xE0 | c >> 12, 0xF0 | c >> 18])
    out = np.zeros((len(c), 4), np.int64)
    out[:, 0] = lead
    for k in range(1, 4):
        shift = 6 * (n - 1 - k)
        out[:, k] = np.where(k < n, 0x80 | (c >> np.maximum(shift, 0)) & 0x3F, 0)
    return out, n


def matches(chars: np.ndarray, place: np.ndarray, widest: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each character, by length of a piece that ends there: the piece's log weight (-inf: none) and id (-1: byte pieces,
    or none). ``place``: the character's number in its pre-token."""
    n = len(chars)
    logs = np.full((n, widest), -np.inf, np.float32)
    ids = np.full((n, widest), -1, np.int32)
    start, prints = np.arange(n), np.zeros(n, np.uint64)
    for size in range(1, widest + 1):
        if size > 1:
            end = start + size - 1
            stay = end < n
            stay[stay] = place[end[stay]] == place[start[stay]] + size - 1
            start, prints = start[stay], prints[stay]
        prints = longer(prints, chars[start + size - 1])
        at, found = pieces.find(prints)
        logs[start[at] + size - 1, size - 1] = pieces.logs[found]
        ids[start[at] + size - 1, size - 1] = pieces.ids[found]
    bare = ids[:, 0] < 0
    logs[bare, 0] = pieces.byte_log * utf8_bytes(chars[bare])[1]
    return logs, ids


def lattices(chars: np.ndarray, ptr: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each node of all pre-tokens (one after the other), by length of the last piece: cumulative conditional
    probability and the piece's id (-1: byte pieces). ``ptr``: first characters, one more at the end."""
    n, lengths = len(chars), np.diff(ptr)
    widest = min(pieces.longest, int(lengths.max()))
    logs, ids = matches(chars, np.arange(n) - np.repeat(ptr[:-1], lengths), widest, pieces)
    alpha = np.zeros(n)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = ptr[:-1][order], lengths[order]
    for p in range(int(lengths[0])):
        node = first[: np.searchsorted(-lengths, -p, "left")] + p
        k = min(p + 1, widest)
        total = logs[node, :k]
        for size in range(1, min(p, widest) + 1):
            total[:, size - 1] += alpha[node - size]
        top = total.max(axis=1)
        total -= top[:, None]
        weight = np.cumsum(np.exp(total, out=total), axis=1, out=total)
        alpha[node] = top + np.log(weight[:, -1])
        weight /= weight[:, -1:]
        logs[node, :k] = weight
        logs[node, k - 1 :] = 2.0  # above any uniform number
    return logs, ids


def stretch_weights(chars: np.ndarray, lo: int, hi: int, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ids of the pieces that end at characters ``lo`` to ``hi`` of one pre-token, in rows of ``STEPS`` characters
    (the last one filled up with nodes that only lead on)."""
    back = max(0, lo - pieces.longest + 1)
    logs, ids = matches(chars[back:hi], np.arange(back, hi), pieces.longest, pieces)
    weight, ids = np.exp(logs[lo - back :].astype(float)), ids[lo - back :]
    more = -(hi - lo) % STEPS
    weight = np.concatenate([weight, np.zeros((more, pieces.longest))])
    weight[hi - lo :, 0] = 1.0
    return weight.reshape(-1, STEPS, pieces.longest), ids


def limits_of(chars: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The weights of the last ``longest`` nodes before each segment of one pre-token, each up to a factor of its own."""
    w, state, out = pieces.longest, np.zeros(pieces.longest), []
    state[0] = 1.0
    for lo in range(0, len(chars), STRETCH):
        weight, _ = stretch_weights(chars, lo, min(lo + STRETCH, len(chars)), pieces)
        past = np.broadcast_to(np.eye(w), (len(weight), w, w)).copy()  # segment, node back, weight before the segment
        for k in range(STEPS):
            new = (weight[:, k, None, :] @ past)[:, 0]
            past = np.concatenate([new[:, None], past[:, :-1]], axis=1)
            past /= past.max(axis=(1, 2), keepdims=True)
        for step in past:
            out.append(state)
            state = step @ state
            state = state / state.max()
    return np.array(out)


def sample_long(chars: np.ndarray, draws: np.ndarray, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled pieces of one long pre-token for each of its occurrences: ids (-1: byte pieces) and last characters, in order."""
    state, node = limits_of(chars, pieces), [len(chars) - 1] * len(draws)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in draws]
    for lo in range((len(chars) - 1) // STRETCH * STRETCH, -1, -STRETCH):
        hi = min(lo + STRETCH, len(chars))
        weight, ids = stretch_weights(chars, lo, hi, pieces)
        past = state[lo // STEPS : lo // STEPS + len(weight)]
        chance = np.empty_like(weight)
        for k in range(STEPS):
            chance[:, k] = np.cumsum(weight[:, k] * past, axis=1)
            new = chance[:, k, -1:].copy()
            chance[:, k] /= new
            past = np.concatenate([new, past[:, :-1]], axis=1)
            past = past / past.max(axis=1, keepdims=True)
        chance = chance.reshape(-1, pieces.longest)[: hi - lo]
        chance[:, -1] = 2.0
        for i, draw in enumerate(draws):
            u = uniform(draw, np.arange(lo, hi))
            size = (chance <= u[:, None]).sum(axis=1)
            jumps, at, path = size.tolist(), node[i], []
            while at >= lo:
                path.append(at)
                at -= jumps[at - lo] + 1
            node[i] = at
            path = np.array(path[::-1], np.int64)
            found[i].append((ids[path - lo, size[path - lo]], chars[path]))
    return [(np.concatenate([x for x, _ in part[::-1]]), np.concatenate([c for _, c in part[::-1]])) for part in found]


def uniform(draw: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for a node of a pre-token's occurrence."""
    return (mix(draw + node.astype(np.uint64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def sample_short(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, draws: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled pieces of pre-tokens: ids (-1: byte pieces) and last characters, all in order, and the number of each."""
    one, which = distinct_spans(chars.view(np.uint8), 4 * starts, 4 * ends)
    lengths = (ends - starts)[one]
    ptr = np.concatenate([[0], np.cumsum(lengths)])
    own = chars[np.repeat(starts[one] - ptr[:-1], lengths) + np.arange(ptr[-1])]
    chance, ids = lattices(own, ptr, pieces)
    alive, node, floor = np.arange(len(starts)), ptr[which + 1] - 1, ptr[which]
    taken, count = [], np.zeros(len(starts), np.int64)
    while len(alive):
        u = uniform(draws[alive], node - floor[alive])
        size = (chance[node] <= u[:, None]).sum(axis=1)
        taken.append((alive, ids[node, size], own[node]))
        count[alive] += 1
        node = node - size - 1
        stay = node >= floor[alive]
        alive, node = alive[stay], node[stay]
    first = np.concatenate([[0], np.cumsum(count)])
    out, codes = np.empty(first[-1], np.int32), np.empty(first[-1], np.uint32)
    for k, (at, piece, code) in enumerate(taken):  # the last pieces were drawn first
        out[first[at + 1] - 1 - k] = piece
        codes[first[at + 1] - 1 - k] = code
    return out, codes, count


def sample(chars: np.ndarray, starts: np.ndarray, draws: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sample_short`` of all pre-tokens, the long ones filtered in segments."""
    ends = np.append(starts[1:], len(chars))
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return sample_short(chars, starts, ends, draws, pieces)
    short = np.flatnonzero(ends - starts <= LONG)
    count = np.zeros(len(starts), np.int64)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    one, which = distinct_spans(chars.view(np.uint8), 4 * starts[long], 4 * ends[long])
    for k, i in enumerate(long[one].tolist()):
        same = long[which == k]
        for j, found in zip(same.tolist(), sample_long(chars[starts[i] : ends[i]], draws[same], pieces), strict=True):
            parts[j], count[j] = found, len(found[0])
    out, codes, few = sample_short(chars, starts[short], ends[short], draws[short], pieces) if len(short) else (np.zeros(0, np.int32), np.zeros(0, np.uint32), count[short])
    count[short] = few
    first = np.concatenate([[0], np.cumsum(count)])
    every, last = np.empty(first[-1], np.int32), np.empty(first[-1], np.uint32)
    at = np.repeat(first[short] - (np.cumsum(few) - few), few) + np.arange(len(out))
    every[at], last[at] = out, codes
    for j, (ids, code) in parts.items():
        every[first[j] : first[j + 1]], last[first[j] : first[j + 1]] = ids, code
    return every, last, count


def encode_part(texts: list[str], keys: np.ndarray, base: int, pieces: Pieces, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` of texts that each begin with a space; ``base``: the place of that space in a longer text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[chars == _MARK] = _LITERAL
    chars[chars == 0x20] = _MARK
    text_first = np.concatenate([[0], np.cumsum(sizes)])
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    begin = pieces.lone[chars]
    begin[1:] |= pieces.lone[chars[:-1]] | ((chars[1:] == _MARK) & (chars[:-1] != _MARK))
    begin[text_first[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begin)
    row = np.searchsorted(text_first, starts, "right") - 1
    draws = mix(mix(keys[row] ^ np.uint64(seed)) + (starts - text_first[row] + base).astype(np.uint64))
    out, codes, count = sample(chars, starts, draws, pieces)
    limits = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, text_first)]
    bare = np.flatnonzero(out < 0)
    if len(bare):
        raw, n = utf8_bytes(codes[bare])
        width = np.ones(len(out), np.int64)
        width[bare] = n
        place = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(out, width)
        for k in range(4):
            has = n > k
            out[place[bare[has]] + k] = pieces.byte_ids[raw[has, k]]
        limits = place[limits]
    return out, limits


def encode(texts: list[str], keys: np.ndarray, pieces: Pieces, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' sampled pieces, and each text's first place among them (one more at the end)."""
    if len(texts) > 1 or not texts or len(texts[0]) <= BLOCK:
        return encode_part([f" {x}" if x else "" for x in texts], keys, 0, pieces, seed)
    text, parts, lo = texts[0], [], 0
    edge = re.compile("[^ ] ")
    while lo < len(text):
        found = edge.search(text, lo + BLOCK) if lo + BLOCK < len(text) else None
        hi = found.end() - 1 if found else len(text)
        parts.append(encode_part([text[lo:hi] if lo else " " + text[:hi]], keys, lo + 1 if lo else 0, pieces, seed)[0])
        lo = hi
    ids = np.concatenate(parts)
    return ids, np.array([0, len(ids)])


def decode(ids: np.ndarray, limits: np.ndarray, pieces: Pieces) -> list[bytes]:
    """The texts that the pieces stand for, as UTF-8."""
    data, at = pieces.joined_bytes(ids)
    raw, cut = data.tobytes(), at[limits].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _shared(docs: DataFrame, model_path: str | None):
    with open(model_path or default_model(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


#: Copies of a row that one row stands for until they are sampled.
COPIES = 64


def numbered_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text, copy``: rows that repeat id and text are numbered from 0, whatever partitions they come from.

    They are counted first (texts by their SHA-256), so a row that repeats without end is one row a task in the shuffle; what
    has more than ``COPIES`` copies is dealt anew in runs of that length.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.sha2(text, 256), F.lit("")).alias("sha"))
    counted = rows.groupBy("doc_id", "sha").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    runs = counted.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    few, many = runs.filter(F.col("n") <= COPIES), runs.filter(F.col("n") > COPIES).repartition("doc_id", "sha", "lo")
    last = F.least(F.col("n"), F.col("lo") + COPIES) - 1
    return few.unionByName(many).select("doc_id", "text", F.explode(F.sequence(F.col("lo"), last)).alias("copy"))


def segment(docs: DataFrame, model_path: str | None = None, copies: bool = False, block: int = TEXTS) -> DataFrame:
    """``doc_id, n_pieces, ids, lossless`` of every row; ``lossless``: decoding gave back the text, byte for byte.

    ``copies``: rows that repeat id and text, as epochs of a mix do, are sampled anew by their number, and ``copy`` (from 0)
    is a further column. Without it repeated rows get the same pieces. Either way the result follows from the rows alone.
    ``block``: bytes of texts that a task works on at once; it changes no result.
    """
    model = _shared(docs, model_path)
    names = ["doc_id", "copy"] if copies else ["doc_id"]

    def start():
        pieces = Pieces(model.value)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            ids, limits = encode(texts, batch.column("key").to_numpy().view(np.uint64), pieces)
            back = decode(ids, limits, pieces)
            lists = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(ids))
            lossless = np.array([a == b.encode() for a, b in zip(back, texts, strict=True)], bool)
            return {k: batch.column(k) for k in names} | {"n_pieces": np.diff(limits), "ids": lists, "lossless": lossless}

        return work

    own = F.xxhash64(F.col("doc_id").cast("long"))
    if copies:
        docs = numbered_copies(docs)
        own = F.when(F.col("copy") == 0, own).otherwise(F.xxhash64(F.col("doc_id").cast("long"), "copy"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names[1:], own.alias("key"), "text")
    return map_texts(rows, "".join(f"{k} bigint, " for k in names) + "n_pieces bigint, ids array<int>, lossless boolean", start, limit=block)


def decode_rows(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids`` (null ids: an empty text)."""
    model = _shared(rows, model_path)

    def start():
        pieces = Pieces(model.value)

        def work(batch: pa.RecordBatch) -> dict:
            lists = batch.column("ids")
            limits = lists.offsets.to_numpy().astype(np.int64)
            texts = decode(lists.values.to_numpy()[limits[0] : limits[-1]], limits - limits[0], pieces)
            return {"doc_id": batch.column("doc_id"), "text": [x.decode("utf-8", "replace") for x in texts]}

        return work

    some = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.lit("").alias("pad"))
    return map_texts(some, "doc_id bigint, text string", start, "pad")


def op5_sample_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(table(spark, sf_dir, "documents"))
