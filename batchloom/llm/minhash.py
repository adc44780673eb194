"""Operator 9: near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles, told apart by their bytes; sketches work on their fingerprints. A
sketch has ``BANDS * ROWS`` coordinates. In round i of the first half, each element is placed in a hashed bin with a hashed
value; bins that earlier rounds filled keep their value, so small sets take more rounds and large ones one or two. In the
second half, round i puts every element in bin i, which guarantees that every coordinate fills. Values of earlier rounds rank
below later ones, so two sets agree in a coordinate with probability equal to their similarity, with Chernoff-style
concentration.

Documents with the same words in the same order (equal SHA-256 of the words joined by single spaces) are one class, which
takes part once. Links between classes are found in three steps that never emit the pairs of a whole group:

1. Bands of ``ROWS`` coordinates are bucket keys. A bucket's leader is its smallest class (a partial aggregation joined
   back). Every class is verified against the one leader it shares most buckets with: at most one pair a class. A leader's
   members are cut into parts, and each part gets the leader's text once.
2. Verified links are contracted. Buckets whose members are in one component are done.
3. In the others, members of different components are compared by their stored sketches in blocks; members of the bucket's
   largest component meet only the others, not each other. Rows in a pair whose estimate lies within reach of the
   threshold (less than 6 standard deviations below) and whose sizes permit a link meet again with their texts, and a task
   hands out only the links that join components.

Every link is confirmed on the full sets of both texts by their bytes (``shingle_numbers``).

At similarity 0.85 a pair shares no band with probability (1 - 0.85 ** 5) ** 40 = 6.5e-11, at 0.80 with 1.3e-7. Step 3 has
no cap. The threshold is a parameter, ``PERCENT`` unless given.

Edge cases: a text with fewer than five words has one shingle, its whole word sequence; a null, empty or blank text has no
shingles and links with nothing; rows with a null id come back with a null component; repeated rows come back repeated;
of an id with several texts each row follows its own text; texts of any length enter with all their shingles; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import connected_components, forget, free_name, join_hot, map_groups, map_texts, stored, table, text_or_empty
from batchloom.llm.textkernel import LOWER, SPACE, blocks, buffers, distinct_spans, mix, same_spans, span_hashes, window_numbers, window_places, windows, word_spans

WIDTH = 5
BANDS, ROWS = 40, 5
PERCENT = 85
#: Standard deviations below the threshold down to which a pair is verified by its share of agreeing coordinates.
REACH = 5.94
#: Rows and shingles of a block of a bucket, and shingles of a part of a leader's members.
BLOCK_ROWS, BLOCK_SHINGLES, PART_SHINGLES = 512, 1_000_000, 200_000
#: Candidate ids up to this number are broadcast to prune the scan of texts; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shingles:
    """Shingles of a block of texts: ``keys`` (distinct ones of each text as sorted fingerprints, whose upper bits are the
    text's row, so that one sort serves all texts), ``firsts`` (each text's first among them, one more at the end) and
    ``counts`` (how many each text has, by their bytes)."""

    def __init__(self, texts: pa.Array, width: int = WIDTH):
        data, offsets = buffers(texts)
        self.data, self.offsets = LOWER[data], offsets
        self.starts, self.ends = s, e = word_spans(self.data, offsets)
        self.words = w = np.searchsorted(s, offsets)
        hashes = span_hashes(self.data, s, e)
        prints, rows, at = windows(hashes, w, width)
        counts = np.diff(w)
        for row in np.flatnonzero((counts > 0) & (counts < width)):  # the whole sequence as one
            one, _, _ = windows(hashes[w[row] : w[row + 1]], np.array([0, counts[row]]), int(counts[row]))
            prints, rows, at = np.append(prints, mix(one + np.uint64(counts[row]))), np.append(rows, row), np.append(at, w[row])
        self.bits = np.uint64(max(1, int(len(texts) - 1).bit_length()))
        keys = (rows.astype(np.uint64) << (np.uint64(64) - self.bits)) | (prints >> self.bits)
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        self.keys = keys[order[new]]
        self.firsts = np.searchsorted((self.keys >> (np.uint64(64) - self.bits)).astype(np.int64), np.arange(len(texts) + 1))
        self.counts = np.diff(self.firsts)
        again = np.flatnonzero(~new)
        a, b, same = at[order[again]], at[order[again - 1]], np.ones(len(again), bool)
        for k in range(width if len(again) else 0):
            same &= same_spans(self.data, s[a + k], e[a + k], s[b + k], e[b + k])
        for row in np.unique(rows[order[again[~same]]]).tolist():  # fingerprints met by chance
            self.counts[row] = len(np.unique(shingle_numbers(texts.slice(row, 1), width)[0]))

    def elements(self) -> np.ndarray:
        """The fingerprints without the row in their upper bits, kept to the 48 bits that blocks of any size share."""
        return (self.keys << self.bits) >> np.uint64(16)

    def digests(self) -> list[bytes]:
        """SHA-256 of each text's words, joined by single spaces."""
        data, keep = self.data.copy(), ~SPACE[self.data]
        gap = self.ends[:-1][np.searchsorted(self.offsets, self.starts[1:], "right") == np.searchsorted(self.offsets, self.starts[:-1], "right")]
        keep[gap], data[gap] = True, 0x20
        limits = np.concatenate([[0], np.cumsum(keep)])[self.offsets].tolist()
        raw = data[keep].tobytes()
        return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(limits, limits[1:], strict=False)]


def shingle_keys(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted fingerprints, and each text's first place among them (one more at the end)."""
    found = Shingles(texts, width)
    return found.keys, found.firsts


def elements(keys: np.ndarray, n_texts: int) -> np.ndarray:
    """The fingerprints without the row in their upper bits, kept to the 48 bits that blocks of any size share."""
    bits = np.uint64(max(1, int(n_texts - 1).bit_length()))
    return (keys << bits) >> np.uint64(16)


def shingle_numbers(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted numbers, and each text's first place among them (one more at the end).

    Equal numbers mean equal words, byte for byte; numbers hold for the texts of one call only.
    """
    data, offsets = buffers(texts)
    data = LOWER[data]
    s, e = word_spans(data, offsets)
    firsts = np.searchsorted(s, offsets)
    _, words = distinct_spans(data, s, e)
    rows, at = window_places(firsts, width)
    numbers = window_numbers(words, at, width)
    top, short = int(numbers.max(initial=-1)) + 1, {}
    for row in np.flatnonzero((np.diff(firsts) > 0) & (np.diff(firsts) < width)).tolist():
        key = tuple(words[firsts[row] : firsts[row + 1]].tolist())
        rows, numbers = np.append(rows, row), np.append(numbers, top + short.setdefault(key, len(short)))
    span = top + len(short) + 1
    keys = np.unique(rows * span + numbers)
    return keys % span, np.searchsorted(keys // span, np.arange(len(texts) + 1))


def sketches(elems: np.ndarray, firsts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketches of all sets that are not empty; a row of ``EMPTY`` for the others."""
    n = len(firsts) - 1
    out = np.full(n * size, EMPTY)
    counts = np.diff(firsts)
    rows = np.repeat(np.arange(n), counts)
    elems = mix(elems)
    for i in range(2 * size):
        if not len(elems):
            break
        h = mix(elems + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        at = rows * size + bins
        free = out[at] == EMPTY
        value = mix(h) >> np.uint64(1)
        if i >= size or not free.all():
            at, value = at[free], value[free]
        np.minimum.at(out, at, value)
        open_ = (out.reshape(n, size) == EMPTY).any(axis=1)
        keep = open_[rows]
        if not keep.all():
            rows, elems = rows[keep], elems[keep]
    return out.reshape(n, size)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) ^ part[:, :, k])
    return h.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, raw, n_shingles, sha, sketch`` (a byte a coordinate), ``bands``; ``raw``: a hash of the text as it is."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            found = Shingles(batch.column("text"))
            sketch = sketches(found.elements(), found.firsts)
            bands, size = band_keys(sketch), sketch.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()), mask=pa.array(found.counts == 0))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(sketch), [None, pa.py_buffer(np.ascontiguousarray(sketch.astype(np.uint8)))])
            return {"doc_id": batch.column("doc_id"), "raw": batch.column("raw"), "n_shingles": found.counts, "sha": pa.array(found.digests(), pa.binary()), "sketch": raw.cast(pa.binary()), "bands": lists}

        return work

    return map_texts(with_raw(docs), "doc_id bigint, raw bigint, n_shingles bigint, sha binary, sketch binary, bands array<bigint>", start)


def with_raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty("text")).alias("raw"), text_or_empty("text").alias("text"))


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(texts: pa.Array, percent: int) -> np.ndarray:
    """Which texts after the first have ``100 * intersection >= percent * union`` with it, on full sets."""
    numbers, firsts = shingle_numbers(texts)
    sets = [numbers[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]
    both = np.array([common(sets[0], x) for x in sets[1:]], np.int64)
    n = np.diff(firsts)
    return (both > 0) & (100 * both >= percent * (n[0] + n[1:] - both))


def confirm_first(rows: pa.Table, groups: list[tuple[int, int]], percent: int = PERCENT) -> pa.Table:
    """Links ``a, b`` of a leader (side 0) with those members of its part that the full sets confirm."""
    ids, side, text = rows.column("id").to_numpy(), rows.column("side").to_numpy(), rows.column("text").combine_chunks()
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e in groups:
        lead, members = s + np.flatnonzero(side[s:e] == 0)[:1], s + np.flatnonzero(side[s:e] == 1)
        sizes = text_lengths(text, members)
        for lo, hi in blocks(np.concatenate([[0], np.cumsum(sizes)])):
            part = members[lo:hi]
            good = part[linked(text.take(pa.array(np.concatenate([lead, part]))), percent)]
            out_a.append(np.full(len(good), ids[lead[0]]))
            out_b.append(ids[good])
    return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})


def text_lengths(text: pa.Array, places: np.ndarray) -> np.ndarray:
    return np.diff(buffers(text)[1])[places]


def with_texts(need: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``need`` (a column ``id``: classes) with the ``text`` of each class."""
    need = stored(need.join(classes.select(F.col("node").alias("id"), F.col("rep").alias("doc_id"), "raw"), "id"), "need")
    few = need.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(need) if few else need, ["doc_id", "raw"]).select(*[c for c in need.columns if c not in ("doc_id", "raw")], "text")


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs ``a, b`` (``na, nb``: sizes; a is a leader of any number of b) whose full sets link them."""
    pairs = stored(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.sum(F.col("nb") + 1) / PART_SHINGLES).cast("int").alias("parts"))
    sizes = stored(sizes, "leaders")
    members = join_hot(pairs, sizes, ["a"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("b").alias("id"))
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("a").alias("id"))
    rows = with_texts(members.union(leaders), classes, texts)
    return map_groups(rows, ["a", "part"], "a bigint, b bigint", partial(confirm_first, percent=percent))


def _near_pairs(rows: pa.Table, groups: list[tuple[int, int]], percent: int):
    """For each group, the places of pairs of different components that are near by sketch and size, in the bucket of the
    first band that they share (so that only one bucket looks at a pair)."""
    sketch = buffers(rows.column("sketch").combine_chunks())[0].reshape(rows.num_rows, -1)
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    n, comp, side, band = (rows.column(c).to_numpy() for c in ("n", "comp", "side", "band"))
    lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    share = percent / 100
    least = (share - REACH * (share * (1 - share) / sketch.shape[1]) ** 0.5) * sketch.shape[1]
    for s, e in groups:
        if e - s < 2:
            continue
        same = lo[s] == hi[s]
        left, right = (np.arange(s, e), np.arange(s, e)) if same else (s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1))
        if not len(left) or not len(right):
            continue
        step = max(1, (1 << 22) // (len(right) * sketch.shape[1]))
        found = []
        for k in range(0, len(left), step):
            part = left[k : k + step]
            ok = (comp[part][:, None] != comp[right][None, :]) & (100 * np.minimum(n[part][:, None], n[right][None, :]) >= percent * np.maximum(n[part][:, None], n[right][None, :]))
            if same:
                ok &= part[:, None] < right[None, :]
            if ok.any():
                agree = (sketch[part][:, None, :] == sketch[right][None, :, :]).sum(axis=2, dtype=np.int16)
                i, j = np.nonzero(ok & (agree >= least))
                found.append(np.stack([part[i], right[j], agree[i, j]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        if pairs.shape[1]:
            mine = np.empty(pairs.shape[1], bool)
            for k in range(0, len(mine), 65536):
                x, y = pairs[0, k : k + 65536], pairs[1, k : k + 65536]
                first = (bands[x] == bands[y]).argmax(axis=1)
                mine[k : k + 65536] = bands[x, first] == band[s]
            pairs = pairs[:, mine]
        if pairs.shape[1]:
            yield pairs


def flag_near(rows: pa.Table, groups: list[tuple[int, int]], percent: int = PERCENT) -> pa.Table:
    """The rows that are in a near pair."""
    hit = np.zeros(rows.num_rows, bool)
    for pairs in _near_pairs(rows, groups, percent):
        hit[pairs[:2].ravel()] = True
    return rows.filter(pa.array(hit))


def confirm_near(rows: pa.Table, groups: list[tuple[int, int]], percent: int = PERCENT) -> pa.Table:
    """Links between components, confirmed on full sets; pairs that links of the group already join are passed over."""
    ids, comp, text = rows.column("id").to_numpy(), rows.column("comp").to_numpy(), rows.column("text").combine_chunks()
    out_a, out_b = [], []
    for pairs in _near_pairs(rows, groups, percent):
        root: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def find(c: int, root: dict = root) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def prints(i: int, sets: dict = sets) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_keys(text.slice(i, 1))[0]
            return sets[i]

        for x, y in pairs[:2, np.argsort(-pairs[2], kind="stable")].T.tolist():
            cx, cy = find(int(comp[x])), find(int(comp[y]))
            if cx == cy:
                continue
            both = common(prints(x), prints(y))  # fingerprints turn most pairs away; what they let through is compared in full
            if 100 * both >= percent * (len(prints(x)) + len(prints(y)) - both) and linked(text.take(pa.array([x, y])), percent)[0]:
                root[max(cx, cy)] = min(cx, cy)
                out_a.append(int(ids[x]))
                out_b.append(int(ids[y]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def links_inside(members: DataFrame, classes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links ``a, b`` between components that meet in a bucket, from ``band, id, comp, n``.

    A bucket is cut into blocks: those of its largest component, and those of all other members. Pairs of blocks are compared
    in tasks of their own, except pairs inside the largest component. Sketches travel first; texts only for rows that are in
    a near pair. No pair leaves a task unless it joins two components.
    """
    parts = members.groupBy("band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks_for = lambda c, n: F.greatest(F.ceil(c / BLOCK_ROWS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    size = parts.groupBy("band").agg(F.max(F.struct("c", "comp", "n")).alias("m"), F.sum("c").alias("every"), F.sum("n").alias("n"))
    size = stored(size.select("band", "every", F.col("m.comp").alias("main"), blocks_for(F.col("every") - F.col("m.c"), F.col("n") - F.col("m.n")).alias("rest_blocks"), blocks_for(F.col("m.c"), F.col("m.n")).alias("main_blocks")), "bucket-sizes")
    dealt = join_hot(members, size, ["band"], "every").withColumn("is_main", F.col("comp") == F.col("main"))
    dealt = dealt.join(classes.select(F.col("node").alias("id"), "sketch", "bands"), "id")
    of = F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))
    p = F.pmod(F.xxhash64("id"), of).cast("int") + F.when(F.col("is_main"), F.col("rest_blocks")).otherwise(0)
    last = F.col("rest_blocks") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("main_blocks"))
    both = dealt.withColumn("p", p).withColumn("q", F.explode(F.sequence(F.lit(0), last)))
    keyed = both.select("band", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).cast("int").alias("side"), "id", "n", "comp", "sketch", "bands")
    schema = "band bigint, lo int, hi int, side int, id bigint, n bigint, comp bigint, sketch binary, bands array<bigint>"
    flagged = map_groups(keyed, ["band", "lo", "hi"], schema, partial(flag_near, percent=percent))
    return map_groups(with_texts(flagged, classes, texts), ["band", "lo", "hi"], "a bigint, b bigint", partial(confirm_near, percent=percent))


def near_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, raw, n_shingles, sha``) and classes (``sha, rep, raw, n, component_id, stays``): ``rep``: smallest id, with
    the hash of its text; ``stays``: the class is the first of its component."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs), "prints")
    some = prints.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("sha").agg(
        F.min(F.struct("doc_id", "raw")).alias("r"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = stored(some.select(F.monotonically_increasing_id().alias("node"), "sha", F.col("r.doc_id").alias("rep"), F.col("r.raw").alias("raw"), "n", "n_shingles", "sketch", "bands"), "classes")
    texts = with_raw(docs)
    spread = stored(classes.select("node", "n_shingles", F.explode("bands").alias("band")), "spread")
    leaders = stored(spread.groupBy("band").agg(F.min("node").alias("lead"), F.min_by("n_shingles", "node").alias("lead_n"), F.count("*").alias("n")).filter("n > 1"), "leading")
    buckets = stored(join_hot(spread, leaders, ["band"]), "buckets")

    votes = buckets.filter("lead < node").groupBy("node", "lead").agg(F.count("*").alias("c"), F.first("n_shingles").alias("nb"), F.first("lead_n").alias("na"))
    first = votes.groupBy("node").agg(F.max(F.struct("c", (-F.col("lead")).alias("m"), "na", "nb")).alias("v"))
    first = first.select((-F.col("v.m")).alias("a"), F.col("node").alias("b"), F.col("v.na").alias("na"), F.col("v.nb").alias("nb"))
    fits = first.filter(percent * F.greatest("na", "nb") <= 100 * F.least("na", "nb"))
    comps = connected_components(stored(verify(fits, classes, texts, percent), "links"))

    inside = buckets.select("band", F.col("node").alias("id"), F.col("n_shingles").alias("n")).join(comps, "id", "left").select("band", "id", "n", F.coalesce("component_id", "id").alias("comp"))
    inside = stored(inside, "inside")
    split = inside.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("every")).filter("c0 < c1").select("band", "every")
    left = stored(join_hot(inside, stored(split, "split"), ["band"], "every"), "left")
    more = links_inside(left, classes, texts, percent)
    edges = comps.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more)
    final = connected_components(edges).select(F.col("id").alias("node"), F.col("component_id").alias("root"))
    named = stored(classes.select("node", "sha", "rep", "raw", "n").join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    roots = stored(named.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("r"), F.count("*").alias("k")), "roots")
    out = join_hot(named, roots, ["root"], "k").select("sha", "rep", "raw", "n", F.col("r.rep").alias("component_id"), (F.col("r.node") == F.col("node")).alias("stays"))
    out = stored(out, "components")
    forget(spark, spread, leaders, buckets, inside, left, named, roots)
    return prints.select("doc_id", "raw", "n_shingles", "sha"), out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``), linked from ``percent`` on."""
    rows, classes = near_classes(docs, percent)
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = join_hot(rows.filter(full), classes.select("sha", "n", "component_id"), ["sha"]).select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.filter(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each group: the row with the smallest id, and of rows that repeat its id and
    text, one. Rows without shingles stay, as do rows with a null id; of such rows that repeat id and text, too, one stays if
    the id is not null.

    Only ids and hashes of the rows that go are joined to the texts.
    """
    rows, classes = near_classes(docs, percent)
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    stays = join_hot(rows.filter(full), classes.select("sha", "n", F.col("rep").alias("r_id"), F.col("raw").alias("r_raw"), "stays"), ["sha"])
    here = F.col("stays") & (F.col("doc_id") == F.col("r_id")) & (F.col("raw") == F.col("r_raw"))
    gone = stored(stays.filter(~here).select("doc_id", "raw").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    again = stored(rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "raw").count().filter("count > 1").select("doc_id", "raw"), "again")
    key, raw, nth = (free_name(docs, x) for x in ("_key", "_raw", "_nth"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(raw, F.xxhash64(text_or_empty("text")))
    named = lambda df: df.select(F.col("doc_id").alias(key), F.col("raw").alias(raw))
    rest = keyed.join(F.broadcast(named(gone)) if few else named(gone), [key, raw], "left_anti")
    if again.isEmpty():
        return rest.select(*docs.columns)
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(key, raw).orderBy(F.xxhash64(*plain))
    single = rest.join(named(again), [key, raw], "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return rest.join(named(again), [key, raw], "left_anti").select(*docs.columns).union(single.select(*docs.columns))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, CASE WHEN len(ws) >= {WIDTH} THEN len(ws) - {WIDTH - 2} ELSE least(len(ws), 1) + 1 END)) AS k FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + {WIDTH - 1}], ' ') AS sh FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
r AS (SELECT a AS id, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""
