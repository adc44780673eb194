"""Operator 4: language of web pages by Bayesian fusion of text, declared markup language, address suffix and host.

Text: a multinomial model of letter trigrams (hashed to ``BUCKETS``) for each language, its counts grouped aggregates over
a bounded sample of documents with a declared language (at most ``SAMPLE`` rows, those with the smallest hash of their id). A
language that less than one in ``MOST_LANGUAGES`` of these rows declare is not learnt, which bounds the model.
A page's log likelihood is scaled to at most ``EVIDENCE`` trigrams' worth, since neighbouring trigrams repeat each other.
Declared language: the markup's ``lang`` is right with probability ``TRUST``. Suffix and host: soft counts of languages,
from text and markup, are summed for each address suffix and host by grouped aggregation; a host's prior is its counts
smoothed with its suffix's prior, and that with the prior of all pages. A page's own counts are taken out of its host's and
suffix's, so its text is not counted twice.

Edge cases: a page without letters, markup or address gets the prior that is left; declared languages unknown to the model
and null, empty or malformed addresses count as missing; a null id is kept; repeated rows come back repeated; without any
training language the language is null and the probability 0; an id with contradicting languages does not train; extra
columns are ignored; an empty table gives an empty result. A host may hold any share of the pages: counts are pre-aggregated
and come back to its pages as a hot key, and pages without a host or suffix take no part in that join. Entities stand for
their characters. Documents and pages of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import join_hot, map_texts, scratch, stored, table
from batchloom.llm.textkernel import NO_LETTER, buffers

SAMPLE = 20_000
#: Languages of a model at most: the counts of all of them come to the driver.
MOST_LANGUAGES = 256
BUCKETS = 1 << 14
EVIDENCE = 60.0
TRUST = 0.9
#: Pseudo-counts that the coarser level lends to the finer one.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 5.0

MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"
DECLARED = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_GAP = np.where(NO_LETTER, 0x20, np.arange(256)).astype(np.uint8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of each text (with one gap at most), and each text's first place among them."""
    data, offsets = buffers(pc.utf8_lower(texts))
    data = _GAP[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = data == 0x20
    code = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
    inside = ~(gap[:-2] & gap[1:-1]) & ~(gap[1:-1] & gap[2:])
    for cut in offsets[1:-1]:
        inside[max(0, cut - 2) : cut] = False
    at = np.flatnonzero(inside)
    bucket = (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return bucket.astype(np.int64), np.searchsorted(at, offsets)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # bucket, language

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scaled log likelihood of each text for each language, the best at 0."""
        buckets, firsts = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        n = np.diff(firsts)
        full = np.flatnonzero(n)
        if len(full) and self.languages:
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.logs[:, k][buckets], firsts[:-1][full])
            out[full] *= (np.minimum(n[full], EVIDENCE) / n[full])[:, None]
        return out - out.max(axis=1, keepdims=True, initial=-np.inf) if self.languages else out


def train_text(docs: DataFrame) -> TextModel:
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("lang").alias("lang"))
    single = known.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("most")).filter("lang = most").drop("most")
    sample = stored(single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "lang-sample")
    shares = sample.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r.lang for r in shares.filter(F.col("n") * MOST_LANGUAGES >= sample.count()).select("lang").collect())  # so many at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.filter(F.col("lang").isin(languages))), "doc_id")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            buckets, firsts = trigrams(batch.column("text"))
            names, code = np.unique(batch.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            keys, n = np.unique(np.repeat(code, np.diff(firsts)) * BUCKETS + buckets, return_counts=True)
            return {"lang": pa.array(names[keys // BUCKETS].tolist(), pa.string()), "bucket": keys % BUCKETS, "n": n}

        return work

    counts = map_texts(texts, "lang string, bucket bigint, n bigint", start).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    logs = np.full((BUCKETS, len(languages)), 0.5)
    at = np.searchsorted(languages, counts["lang"].to_numpy().astype(str)) if languages else np.zeros(0, int)
    logs[counts["bucket"].to_numpy(np.int64), at] += counts["n"].to_numpy(float)
    return TextModel(languages, np.log(logs / logs.sum(axis=0)).astype(np.float32))


def page_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, host, suffix, declared`` and ``text`` (log likelihoods) of every page."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            plain = pc.replace_substring_regex(batch.column("html"), MARKUP, " ")
            scores = model.scores(pa.array([unescape(x) if "&" in x else x for x in plain.to_pylist()], pa.string()))
            width = scores.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * width), pa.array(scores.ravel(), pa.float64()))
            return {**{c: batch.column(c) for c in ("page_id", "host", "suffix", "declared")}, "text": lists}

        return work

    host = F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(host, r"([^.]+)\.?$", 1).alias("suffix"),
        F.lower(F.nullif(F.regexp_extract("html", DECLARED, 1), F.lit(""))).alias("declared"), "html",
    )
    return map_texts(rows, "page_id bigint, host string, suffix string, declared string, text array<double>", start, "html")


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    return stored(rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("soft")[k]) for k in range(n)]).alias(name), F.count("*").alias("n")), name)


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, host, declared, lang, probability`` of every page."""
    n = len(model.languages)
    evidence = page_evidence(pages, model)
    if not n:
        return evidence.select("page_id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    names = F.array(*map(F.lit, model.languages))
    other = (1 - TRUST) / max(n - 1, 1)
    markup = F.transform(names, lambda x: F.when(~F.array_contains(names, F.col("declared")) | F.col("declared").isNull(), 0.0).when(x == F.col("declared"), F.log(F.lit(TRUST))).otherwise(F.log(F.lit(max(other, 1e-6)))))
    evidence = evidence.withColumn("own", F.zip_with("text", markup, lambda a, b: a + b))
    rows = stored(evidence.withColumn("soft", _posterior(F.col("own"))).drop("text"), "lang-evidence")

    every = rows.agg(*[F.sum(F.col("soft")[k]).alias(f"n{k}") for k in range(n)]).first()  # a number for each language
    every = F.array(*[F.lit(float(x or 0.0)) for x in every])
    suffixes = _sums(rows.filter("suffix IS NOT NULL AND suffix <> ''"), ["suffix"], "suffix_n", n)
    hosts = _sums(rows.filter("host IS NOT NULL"), ["host"], "host_n", n)
    none = F.array(*[F.lit(0.0)] * n)
    joined = join_hot(stored(join_hot(rows, hosts, ["host"], how="left"), "lang-hosts"), suffixes, ["suffix"], how="left")
    less = lambda counts: F.zip_with(counts, F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    smooth = lambda counts, weight, coarse: F.zip_with(counts, coarse, lambda c, p: (c + weight * p) / (total(counts) + weight))
    joined = joined.withColumn("p0", smooth(less(every), float(n), F.array(*[F.lit(1.0 / n)] * n)))
    joined = joined.withColumn("p1", smooth(F.when(F.col("suffix_n").isNull(), none).otherwise(less(F.col("suffix_n"))), SUFFIX_WEIGHT, F.col("p0")))
    joined = joined.withColumn("p2", smooth(F.when(F.col("host_n").isNull(), none).otherwise(less(F.col("host_n"))), HOST_WEIGHT, F.col("p1")))
    joined = joined.withColumn("p", _posterior(F.zip_with("own", "p2", lambda a, b: a + F.log(b))))
    best = F.array_max("p")
    return joined.select("page_id", "host", "declared", F.element_at(names, F.array_position("p", best).cast("int")).alias("lang"), best.alias("probability"))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as result:
        return result(identify(table(spark, sf_dir, "pages"), train_text(table(spark, sf_dir, "documents"))), "languages")
