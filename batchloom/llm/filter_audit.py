"""Operator 11: how corpus filters interact, for every order in which they can be applied.

A document's failures are five flags. Rows are counted by part and flags first (at most 32 rows a part), and one SQL CUBE over
the five flags and the part adds up that small table. A grouping-set row that has the part and some flags, all of them false,
counts the documents that pass just these filters: the survivors of that subset. What a step of an order does is then the
difference of two subsets, the filters before it and those with its own, so the 120 orders read 80 pairs of subsets a part
and no document is looked at again.

The texts are read once, for their four own flags and a SHA-256 that stands for the text in the search for repeats: a text
repeats if a row with a smaller id has it. Only ids, flags and hashes are shuffled; a text that many rows share is joined as
a hot key, and rows that repeat an id are added up before the labels are joined.

Edge cases: a null text is an empty one, a null part the empty string; a null id is smaller than none and has none that is
smaller, so its row never repeats another, and it has no labels; rows that share id and text repeat only smaller ids; of
several labels of an id any 1 counts, and null labels count as 0; texts of any length are read whole; an empty table has no
parts and gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import join_hot, scratch, stored, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """The failures that a text shows by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.regexp_count(text, F.lit(WORD))
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, A, B, C, D, E`` of every row of ``doc_id, text, lang``."""
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), *(c.alias(k) for k, c in text_flags(text).items()), F.unhex(F.sha2(text, 256)).alias("gid"))
    rows = stored(rows, "audit-rows")
    repeats = stored(rows.groupBy("gid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "audit-repeats")
    out = join_hot(rows, repeats, ["gid"], how="left")
    return out.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, A .. E, docs, good, toxic``: rows by part and flags, and how many of them are labelled so."""
    keys = ["part", *FILTERS]
    rows = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("docs"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")))
    known = rows.join(marks, "doc_id", "left")
    times = lambda c: F.sum(F.col("docs") * F.coalesce(F.col(c), F.lit(0)))
    return known.groupBy(*keys).agg(F.sum("docs").alias("docs"), times("quality").alias("good"), times("toxic").alias("toxic"))


def subset_survivors(counts: DataFrame, filters: str = FILTERS, measures: tuple[str, ...] = ("docs", "good", "toxic")) -> DataFrame:
    """``part, subset`` (bit i: the i-th filter) and the measures' sums over rows that pass all filters of the subset; one row
    for each part and subset, zeros included."""
    sums = ", ".join(f"sum({m}) AS {m}" for m in measures)
    cube = counts.sparkSession.sql(f"SELECT part, {', '.join(filters)}, grouping(part) AS every, {', '.join(f'grouping({f}) AS no{f}' for f in filters)}, {sums} FROM {{counts}} GROUP BY CUBE (part, {', '.join(filters)})", counts=counts)
    passes = F.col("every") == 0
    subset = F.lit(0)
    for i, f in enumerate(filters):
        passes &= (F.col(f"no{f}") == 1) | ~F.col(f)
        subset = subset + F.when(F.col(f"no{f}") == 0, 1 << i).otherwise(0)
    some = cube.filter(passes).select("part", subset.alias("subset"), *measures)
    grid = counts.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    return grid.join(some, ["part", "subset"], "left").fillna(0, list(measures))


def order_steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter_order, step, filter, before, after, share``: the steps of every order, with the subsets before and after them
    and in how many orders a filter meets the subset before (so many rows as orders times filters, whatever the data)."""
    rows = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << filters.index(f)
            rows.append(("".join(order), k + 1, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def subset_pairs(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``filter, before, after, orders``: each filter with each subset of the others, and the orders that have them so."""
    rows, n = [], len(filters)
    for i, f in enumerate(filters):
        for k in range(n):
            for others in combinations([j for j in range(n) if j != i], k):
                before = sum(1 << j for j in others)
                rows.append((f, before, before | 1 << i, factorial(k) * factorial(n - 1 - k)))
    return spark.createDataFrame(rows, "filter string, before int, after int, orders long")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order and step, from counts by part and flags (see ``op11_filter_interactions``)."""
    spark = counts.sparkSession
    survivors = stored(subset_survivors(counts, filters), "audit-subsets")
    every = (1 << len(filters)) - 1
    before = survivors.select("part", F.col("subset").alias("before"), *(F.col(m).alias(f"{m}_before") for m in ("docs", "good", "toxic")))
    after = survivors.select("part", F.col("subset").alias("after"), "docs", "good", "toxic")
    pairs = before.join(F.broadcast(subset_pairs(spark, filters)), "before").join(after, ["part", "after"])
    pairs = pairs.select("part", "filter", "before", "after", "orders", F.col("docs").alias("kept"), (F.col("docs_before") - F.col("docs")).alias("removed"), (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"))
    pairs = stored(pairs, "audit-pairs")
    alone = lambda c: F.max(F.when(c, F.col("removed")))
    whole = pairs.groupBy("part", "filter").agg(alone(F.col("before") == 0).alias("failing"), alone(F.col("after") == every).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = pairs.drop("orders").join(whole, ["part", "filter"]).join(F.broadcast(order_steps(spark, filters)), ["filter", "before", "after"])
    return steps.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over ``doc_id, text, lang`` with ``doc_id, quality, toxic``."""
    with scratch() as result:
        return result(interactions(stored(counted(flagged(docs), labels), "audit-counts")), "audit")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part, filter_order, step`` and what that step does: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
#: Works from each document's place of removal in each order, not from subsets.
ORACLE = rf"""
WITH l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT doc_id, part, t, least, regexp_extract_all(t, '{WORD}') AS words FROM d),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > {MAX_CAPITALS_PERCENT} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '{SYMBOLS}') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(w.doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_ORDERS}) AS v(filter_order)),
p AS (SELECT g.*, filter_order, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda x: instr(filter_order, x))), 6) AS gone FROM g CROSS JOIN o),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed,
    sum(n) FILTER (WHERE gone < step AND contains(fails, filter_order[step])) AS redundant, sum(n) FILTER (WHERE fails = filter_order[step]) AS unique_fails,
    sum(good) FILTER (WHERE gone = step) AS good_lost, sum(toxic) FILTER (WHERE gone = step) AS toxic_lost
  FROM p CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM s
"""
