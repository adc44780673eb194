"""Operator 2: toxicity by a chain of linear classifiers over categories.

Categories are predicted in a fixed order: poor quality, toxic and poor, toxic (the verdict). The model of a category sees
word features and the probabilities of the earlier categories. In training those probabilities are out-of-fold: ``FOLDS``
models, each fitted without one fold of rows on words selected without that fold, so that a later model meets probabilities of
the quality it will meet in use. Each category's threshold comes from its out-of-fold probabilities: the geometric mean of one
half and the one that at most ``FALSE_RATE`` of the clean rows exceed (0.1 at least), or just above the latter where it is
over one half.

Features are words (runs of letters, lower case) and word beginnings (which join inflected forms) whose presence goes with
the verdict: document frequencies by label and fold are one grouped aggregate over the labelled sample, and the ``FEATURES``
words with the highest likelihood ratio are kept, for each fold's model from the other folds' counts. The sample is bounded:
at most ``SAMPLE`` labelled rows, those with the smallest hash of their id. Scoring reads every whole text once, without a
shuffle: words become fingerprints, and those of selected words are looked up.

Edge cases: a null or empty text gets the probabilities of a text without selected words; labels that are null or not 0 or
1 and ids with contradicting labels are not used, and of an id with several texts the first in order is; without rows of
both kinds a category's probability is its rate (0 for no rows) and nothing is rejected; repeated rows give repeated results;
extra columns are ignored; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import map_texts, stored, table
from batchloom.llm.minhash import elements, shingle_keys
from batchloom.llm.textkernel import NO_LETTER, SAME, blocks, buffers, mix, word_hashes
from batchloom.session import ship

SAMPLE = 20_000
FEATURES = 512
#: Least number of labelled texts that hold a selected word.
LEAST_TEXTS = 3
#: Least share of labelled texts with a selected word that are toxic, two clean texts added.
LEAST_SHARE = 0.6
#: Least log-likelihood gain of a selected word: by chance, about one of 20,000 words reaches it.
LEAST_GAIN = 10.0
FOLDS = 5
#: Bytes of the word beginnings.
PREFIXES = (4, 5)
#: Categories in chain order, as SQL conditions on a row of labels; the last one is the verdict.
CATEGORIES = (("poor", "quality = 0"), ("toxic_poor", "toxic = 1 AND quality = 0"), ("toxic", "toxic = 1"))
#: Most labelled clean rows that the verdict's threshold may reject.
FALSE_RATE = 0.001
PENALTY = 0.03


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of lower-case letter runs and of their beginnings, and each text's first place among them."""
    data, offsets = buffers(pc.utf8_lower(texts))
    return word_hashes(data, offsets, SAME, NO_LETTER, PREFIXES)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.weights + self.bias, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, words: int, penalty: float = PENALTY) -> Linear:
    """Logistic regression with a squared penalty, by damped Newton steps.

    Each of the first ``words`` columns also stands alone as two rows, weighted with the positive rows that have the word and
    with the others plus two. Without them words that come together share one weight, and none of them suffices.
    """
    n, d = x.shape
    rate = y.mean() if n else 0.0
    if rate in (0.0, 1.0):
        return Linear(np.zeros(d), 40.0 if n and rate == 1.0 else -40.0)
    has = x[:, :words].sum(axis=0)
    alone = np.hstack([np.eye(words, dtype=np.float32), x[:, :words].T @ x[:, words:] / np.maximum(has, 1)[:, None]])
    with_word = x[y == 1][:, :words].sum(axis=0)
    z = np.vstack([np.hstack([part, np.ones((len(part), 1))]).astype(np.float32) for part in (x, alone, alone)])
    weight = np.concatenate([np.ones(n), with_word, has - with_word + 2])
    y = np.concatenate([y, np.ones(words), np.zeros(words)])
    w = np.zeros(d + 1)
    w[-1] = np.log(rate / (1 - rate))
    ridge = np.full(d + 1, penalty)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        m = z @ v.astype(np.float32)
        return float(weight @ (np.logaddexp(0, m) - y * m) + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32), -40, 40)))
        curve = ((z * (weight * p * (1 - p)).astype(np.float32)[:, None]).T @ z).astype(float) + np.diag(ridge)
        step, size = np.linalg.solve(curve, z.T @ (weight * (p - y)) + ridge * w), 1.0
        while (then := loss(w - size * step)) > now and size > 1e-3:  # a full step can overshoot where rows separate
            size /= 2
        if then > now - 1e-6 * (1 + now):
            break
        w, now = w - size * step, then
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Selected words (sorted fingerprints), and for each category its model and threshold."""

    words: np.ndarray
    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def design(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text row, selected word) of the texts, each once."""
        if not len(self.words) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self._sieve()[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        hit = self.words[at] == hashes[maybe]
        rows = np.searchsorted(firsts, maybe[hit], "right") - 1
        pairs = np.unique(rows * len(self.words) + at[hit])
        return pairs // len(self.words), pairs % len(self.words)

    def _sieve(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << 20, bool)
            self._bits[(self.words >> np.uint64(44)).astype(np.int64)] = True
        return self._bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_bits"}

    def probabilities(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        rows, cols = self.design(hashes, firsts)
        n, d = len(firsts) - 1, len(self.words)
        out = np.zeros((n, len(self.models)))
        for k, m in enumerate(self.models):
            score = np.bincount(rows, m.weights[cols], n) + out[:, :k] @ m.weights[d : d + k] + m.bias
            out[:, k] = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        return out


def fit_chain(x: np.ndarray, labels: np.ndarray, words: np.ndarray, names: Sequence[str], folds: np.ndarray, selected: np.ndarray | None = None) -> Chain:
    """Models in chain order on dense features ``x``, with out-of-fold probabilities of earlier categories.

    ``selected``: which columns each fold's model may use (a row a fold) and, in the last row, those of the final models.
    """
    n_folds = int(folds.max(initial=0)) + 1
    selected = np.ones((n_folds + 1, x.shape[1]), bool) if selected is None else selected
    out_of_fold = np.zeros((len(x), 0))
    models, thresholds = [], []
    for k in range(len(names)):
        y = labels[:, k].astype(float)
        p = np.zeros(len(x))
        for f in np.unique(folds):
            z = np.hstack([x[:, selected[f]], out_of_fold])
            p[folds == f] = fit_linear(z[folds != f], y[folds != f], int(selected[f].sum()))(z[folds == f])
        models.append(fit_linear(np.hstack([x[:, selected[-1]], out_of_fold]), y, int(selected[-1].sum())))
        clean = np.sort(p[y == 0])
        floor = clean[len(clean) - 1 - int(FALSE_RATE * len(clean))] if len(clean) else 1.0
        thresholds.append(float(np.nextafter(floor, 2.0) if floor >= 0.5 else max(0.1, np.sqrt(floor * 0.5))))
        out_of_fold = np.hstack([out_of_fold, p[:, None]])
    return Chain(words[selected[-1]], list(names), models, thresholds)


def fold_of(doc_ids: np.ndarray) -> np.ndarray:
    return (doc_ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDS


def sample_rows(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` labelled ids with a column for each category (1, 0), small enough to broadcast."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("t1"), F.min("quality").alias("quality"), F.max("quality").alias("q1")).filter("toxic = t1 AND quality <=> q1")
    ys = [F.coalesce(F.expr(c), F.lit(False)).cast("int").alias(f"y{k}") for k, (_, c) in enumerate(CATEGORIES)]
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", *ys)


def one_of_each_copy(texts: DataFrame) -> DataFrame:
    """The sample without most near copies, whose words would all seem to go with their one label.

    Of rows that agree in one of two minimum fingerprints over five-word shingles, the one with the smallest id stays.
    """

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            keys, firsts = shingle_keys(batch.column("text"))
            elems = elements(keys, batch.num_rows)
            out = {"doc_id": batch.column("doc_id")}
            for name, salt in (("k1", 0xA24BAED4963EE407), ("k2", 0x9FB21C651E98DF25)):
                low = np.zeros(batch.num_rows, np.uint64)
                full = np.flatnonzero(np.diff(firsts))
                low[full] = np.minimum.reduceat(mix(elems ^ np.uint64(salt)), firsts[full]) if len(full) else 0
                out[name] = low.view(np.int64)
            return out

        return work

    keys = map_texts(texts.select("doc_id", "text"), "doc_id bigint, k1 bigint, k2 bigint", start)
    keys = keys.groupBy("k1").agg(F.min(F.struct("doc_id", "k2")).alias("m")).groupBy("m.k2").agg(F.min("m.doc_id").alias("doc_id"))
    return stored(texts.join(F.broadcast(keys.select("doc_id")), "doc_id", "left_semi"), "tox-distinct")


def _likelihood_ratio(n: int, n1: int, has, has1):
    """SQL gain of knowing that a word is present (``has`` of ``n`` texts, ``has1`` of the ``n1`` toxic ones)."""
    term = lambda seen, of, all_: F.when(seen > 0, seen * F.log(seen * n / (of * all_))).otherwise(0.0)
    return term(has1, has, n1) + term(has - has1, has, n - n1) + term(n1 - has1, n - has, n1) + term(n - n1 - has + has1, n - has, n - n1)


def word_counts(texts: DataFrame, last: str) -> DataFrame:
    """``word`` and, for each fold, in how many texts (``n0`` ...) and toxic texts (``t0`` ...) of the sample it stands."""

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            hashes, firsts = text_words(batch.column("text"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
            order = np.lexsort((rows, hashes))
            h, r = hashes[order], rows[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[once], r[once]
            word, at = np.unique(h, return_inverse=True)
            fold, y = fold_of(batch.column("doc_id").to_numpy())[r], batch.column(last).to_numpy()[r]
            out = {"word": word.view(np.int64)}
            for f in range(FOLDS):
                out[f"n{f}"] = np.bincount(at[fold == f], minlength=len(word))
                out[f"t{f}"] = np.bincount(at[(fold == f) & (y == 1)], minlength=len(word))
            return out

        return work

    fields = [f"{c}{f}" for f in range(FOLDS) for c in "nt"]
    counts = map_texts(texts.select("doc_id", "text", last), "word bigint, " + ", ".join(f"{c} bigint" for c in fields), start)
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in fields])


def select_words(words: DataFrame, sizes: dict[int, tuple[int, int]]) -> list[np.ndarray]:
    """Selected words (sorted fingerprints) for each fold's model, from the other folds, and for the final models."""
    out = []
    for left in [*range(FOLDS), None]:
        use = [f for f in range(FOLDS) if f != left]
        n, n1 = (sum(sizes.get(f, (0, 0))[k] for f in use) for k in (0, 1))
        if not 0 < n1 < n:
            out.append(np.zeros(0, np.uint64))
            continue
        has, has1 = (sum((F.col(f"{c}{f}") for f in use), F.lit(0)) for c in "nt")
        rows = words.select("word", has.alias("n"), has1.alias("t")).filter(f"n >= {LEAST_TEXTS} AND t >= {LEAST_SHARE} * (n + 2)")
        gain = _likelihood_ratio(n, n1, F.col("n"), F.col("t"))
        best = rows.select("word", gain.alias("g")).filter(F.col("g") >= LEAST_GAIN).orderBy(F.desc("g"), "word").limit(FEATURES)
        out.append(np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64)))
    return out


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain fitted on the labelled sample; words and texts stay on the executors, selected features come back."""
    ys = [f"y{k}" for k in range(len(CATEGORIES))]
    sample = stored(sample_rows(labels), "tox-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = one_of_each_copy(stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(y).alias(y) for y in ys]), "tox-texts"))
    last = ys[-1]
    total = texts.agg(F.count("*"), F.sum(last)).first()
    n, n1 = total[0], total[1] or 0
    if not n1 or n1 == n:
        rate = 40.0 if n and n1 == n else -40.0
        return Chain(np.zeros(0, np.uint64), [c for c, _ in CATEGORIES], [Linear(np.zeros(k), rate) for k in range(len(CATEGORIES))], [2.0] * len(CATEGORIES))
    ids = texts.select("doc_id", last).toPandas()  # at most SAMPLE rows of two numbers
    fold = fold_of(ids["doc_id"].to_numpy(np.int64))
    sizes = {f: (int((fold == f).sum()), int(ids[last].to_numpy()[fold == f].sum())) for f in range(FOLDS)}
    chosen = select_words(stored(word_counts(texts, last).filter(" + ".join(f"n{f}" for f in range(FOLDS)) + f" >= {LEAST_TEXTS}"), "tox-words"), sizes)
    every = np.unique(np.concatenate(chosen))
    blank = Chain(every, [], [], [])

    def design_start():
        def work(batch: pa.RecordBatch) -> dict:
            rows, cols = blank.design(*text_words(batch.column("text")))
            limits = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            return {"doc_id": batch.column("doc_id"), **{y: batch.column(y) for y in ys}, "cols": pa.ListArray.from_arrays(pa.array(limits), pa.array(cols.astype(np.int32)))}

        return work

    rows = map_texts(texts, "doc_id bigint, " + ", ".join(f"{y} int" for y in ys) + ", cols array<int>", design_start).orderBy("doc_id").toPandas()
    x = np.zeros((len(rows), len(every)), np.float32)
    for i, cols in enumerate(rows["cols"]):
        x[i, np.asarray(cols, np.int64)] = 1
    selected = np.stack([np.isin(every, some) for some in chosen])
    return fit_chain(x, rows[ys].to_numpy(), every, [c for c, _ in CATEGORIES], fold_of(rows["doc_id"].to_numpy(np.int64)), selected)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` each, ``is_toxic`` and ``kept`` of every row."""
    fields = ", ".join(f"p_{c} double" for c in chain.names)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            p = chain.probabilities(*text_words(batch.column("text")))
            toxic = p[:, -1] >= chain.thresholds[-1]
            return {"doc_id": batch.column("doc_id"), **{f"p_{c}": p[:, k] for k, c in enumerate(chain.names)}, "is_toxic": toxic, "kept": ~toxic}

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f"doc_id bigint, {fields}, is_toxic boolean, kept boolean", start)


def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns (a null text stays null)."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        array = pa.array(texts.fillna(""), pa.string())
        _, offsets = buffers(array)
        parts = [chain.probabilities(*text_words(array.slice(lo, hi - lo)))[:, -1] for lo, hi in blocks(offsets)]
        return pd.Series(np.concatenate(parts) >= chain.thresholds[-1] if parts else np.zeros(0, bool))

    return docs.filter(~toxic("text"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
