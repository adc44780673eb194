"""Operator 7: mix sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets the key ``-ln(u) / weight`` from a hashed uniform number ``u`` and its quality weight; ascending keys are
a weighted sample without replacement. A source's target is met by complete epochs (every document once each) first; the
rest comes from the documents in key order while the middle of a document lies within the budget, so a source misses its
target by at most half of one document.

Prefix sums do not sort a source in one task. A source of more than ``RANGE_ROWS`` rows has its keys cut at approximate
quantiles of its own keys, into as many ranges as its rows ask for (at most ``MOST_RANGES``), so that ranges hold about as
many rows each whatever the weights; the limits, at most one for ``RANGE_ROWS`` rows, are found by a binary search in the
source's array. Ranges are summed and prefix-summed on that small table, and rows are ordered only inside a range. Rows that
repeat id, key and size are one row with a count until then. Targets come from water-filling: with capacities of twice a
source's size, the level is the only one at which the targets add up to the budget, and resharing the excess until no source
is above its capacity ends there.

Edge cases: a null text has size 0 and is taken 0 times; a source without words has target 0; a null source is a source of
its own, last in order; repeated rows count each (ties in the key are broken by id and size; ``mixed_copies`` takes all rows
that repeat the last one taken, or none of them twice); texts of any length are counted whole, and the last document taken
may be one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import free_name, join_hot, scratch, stored, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2
SEED = "mix-1"
#: Marks rows without a source; the others have "s" before their name.
NO_SOURCE = "n"
#: Rows of a range of keys, about, and most ranges of a source; entries of a quantile summary for each range.
RANGE_ROWS, MOST_RANGES, ENTRIES = 4000, 2000, 10


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(n_chars: Column, n_symbols: Column, size: Column) -> Column:
    """From two statistics of the quality rules: 1 for prose-like word lengths (about six characters a word with its space)
    without symbols, less for other lengths and the more symbols there are a word."""
    return F.when(size > 0, 1 / ((1 + F.abs(n_chars / size - 6.0) / 6.0) * (1 + 10.0 * n_symbols / size))).otherwise(F.lit(1.0))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``src, source_size, target`` from one row ``src, source_size`` a source (a dimension table; see ``mix_documents``)."""
    order = Window.orderBy(F.col("src") == NO_SOURCE, "src")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", (cap * F.col("source_size")).cast("double"))
    until = Window.orderBy(F.col("most") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped, free = F.coalesce(F.sum("most").over(until), F.lit(0.0)), F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(until), F.lit(0.0))
    rows = rows.withColumn("level", (budget * F.sum("source_size").over(whole) - capped) / free)
    return rows.withColumn("level", F.max("level").over(whole)).select("src", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def keyed(docs: DataFrame, seed: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with columns for the source mark, the size in words and the sampling key, under the given names."""
    text = text_or_empty("text")
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(NO_SOURCE))
    rows = docs.withColumn(names["src"], src).withColumn(names["size"], word_count(text))
    key = -F.log(uniform(F.col("doc_id").cast("long"), seed)) / quality_weight(F.length(text), F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.col(names["size"]))
    return rows.withColumn(names["key"], key)


def key_limits(rows: DataFrame) -> DataFrame:
    """``src, limits, n`` of every source: the keys that its ranges end with (none: one range), and how many rows it has."""
    of = [k / MOST_RANGES for k in range(1, MOST_RANGES)]
    sources = stored(rows.groupBy("src").agg(F.count("*").alias("n")), "mix-sources")
    large = sources.filter(F.col("n") > RANGE_ROWS)
    wide = join_hot(rows, large, ["src"]).groupBy("src").agg(F.percentile_approx("key", of, ENTRIES * MOST_RANGES).alias("keys"))
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.col("n") / RANGE_ROWS))
    some = F.transform(F.sequence(F.lit(1), ranges - 1), lambda k: F.element_at("keys", F.greatest(F.lit(1), F.floor(k * MOST_RANGES / ranges)).cast("int")))
    limits = large.join(wide, "src").select("src", F.array_distinct(some).alias("limits"))
    return sources.join(limits, "src", "left").select("src", F.coalesce("limits", F.array().cast("array<double>")).alias("limits"), "n")


def place_in(limits: str, key: str) -> Column:
    """How many of the ascending limits lie below the key, by halving steps."""
    steps = ", ".join(str(1 << k) for k in reversed(range(MOST_RANGES.bit_length())))
    return F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= size({limits}) AND {limits}[at + step - 1] < {key}, at + step, at))")


def decisions(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row a document: ``doc_id, src, size, key, source_size, target, epochs, more`` (one copy beyond the epochs)."""
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), seed, {"src": "src", "size": "size", "key": "key"})
    rows = stored(rows.groupBy("src", "key", "doc_id", "size").agg(F.count("*").alias("copies")), "mix-rows")
    limits = stored(key_limits(rows), "mix-limits")
    rows = stored(join_hot(rows, limits, ["src"]).withColumn("range", place_in("limits", "key")).drop("limits"), "mix-ranged")
    ranges = stored(rows.groupBy("src", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("n")), "mix-ranges")
    targets = source_targets(ranges.groupBy("src").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    dim = stored(ranges.select("src", "range", "n", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first")).join(targets, "src"), "mix-starts")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = join_hot(rows.withColumn("lower", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))), dim, ["src", "range"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    upto = F.col("first") + F.col("lower") + F.col("copy") * F.col("size")
    return out.withColumn("more", (upto - F.col("size") / 2 <= rest) & (rest > 0) & (F.col("size") > 0)).drop("copies", "copy", "first", "lower", "range")


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, times`` of every row."""
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("more").cast("long")).otherwise(F.lit(0)).cast("long")
    with scratch() as result:
        every = decisions(docs, seed).withColumn("times", times)
        return result(every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"), "mixed")


def mixed_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` (all columns) as often as the mix takes it.

    The documents taken once more are a prefix of their source in key order, so one cut a source carries the decision, and
    texts of sources with many rows are not shuffled.
    """
    names = {x: free_name(docs, "_" + x) for x in ("src", "size", "key", "epochs", "cut", "n")}
    cut = F.max(F.when(F.col("more"), F.struct("key", "doc_id", "size")))
    with scratch() as result:
        cuts = decisions(docs, seed).groupBy("src").agg(F.first("epochs").alias(names["epochs"]), cut.alias(names["cut"]), F.count("*").alias(names["n"]))
        cuts = result(cuts.withColumnRenamed("src", names["src"]), "mix-cuts")
    rows = join_hot(keyed(docs, seed, names), cuts, [names["src"]], names["n"])
    here = F.struct(F.col(names["key"]).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(names["size"]).alias("size"))
    more = F.coalesce(here <= F.col(names["cut"]), F.lit(False)).cast("long")
    times = F.when(F.col(names["size"]) > 0, F.col(names["epochs"]) + more).otherwise(F.lit(0)).cast("int")
    return rows.withColumn(names["cut"], F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


_SPACE_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE_WORD}'))::BIGINT AS size, length(coalesce(text, '')) AS n_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)})
    / CASE WHEN size > 0 THEN 1 / ((1 + abs(n_chars::DOUBLE / size - 6.0) / 6.0) * (1 + 10.0::DOUBLE * n_symbols / size)) ELSE 1.0 END AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, {CAP} * source_size AS most FROM s),
c AS (SELECT *, coalesce(sum(most) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free, sum(source_size) OVER () AS everything FROM w
  WINDOW b AS (ORDER BY most / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(({BUDGET}::DOUBLE * everything - capped) / free) AS level FROM c),
t AS (SELECT source, source_size, least(most, level * weight) AS target FROM c, l),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE epochs + CASE WHEN target - epochs * source_size > 0 AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END END AS times FROM p)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * times)::BIGINT AS taken, times::BIGINT AS times FROM m
"""
