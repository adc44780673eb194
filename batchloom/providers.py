"""What outside services may answer, as tables. The offline provider answers nothing, so that every open value goes to a
person; others may be plugged in with the same methods."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.text import mask_secrets
from batchloom.session import stored

ATTEMPTS = 3
#: Characters of an error that an audit row keeps.
ERROR_CHARS = 200
# What an error says that another attempt would not mend.
FINAL_ERRORS = ["401", "authentication", "unauthorized", "403", "forbidden", "400", "bad request", "invalid"]


class Provider(Protocol):
    def judge(self, queue: DataFrame) -> DataFrame | None:
        """``job_id, idx, in_spec`` for queued values; None where the service cannot be reached."""

    def semantic(self, summaries: DataFrame) -> DataFrame:
        """``job_id, json``: findings as JSON text for each job's summary."""


class Offline:
    reason = "LLM 调用失败: ConnectionError"

    def judge(self, queue: DataFrame) -> None:
        return None

    def semantic(self, summaries: DataFrame) -> DataFrame:
        return summaries.select("job_id", F.lit(None).cast("string").alias("json")).limit(0)


def is_final(error: Column) -> Column:
    """An error that is not tried again."""
    said = F.lower(error)
    return reduce(lambda a, b: a | b, [F.contains(said, F.lit(x)) for x in FINAL_ERRORS])


def asked(queue: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: list[str], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """Answers to queued rows, and an audit row ``*keys, attempt, success, error`` of the last attempt at each.

    ``ask`` gets the rows that are open and returns for them ``*keys``, ``error`` (null: answered) and what it answers; a row
    that it leaves out stays open. Rows are asked again, after a wait that doubles each time and varies by half, until they are
    answered, their error is final, or ``attempts`` are over. Each round's answers are stored before the next, so nothing is
    asked twice; errors are kept without secrets and cut.
    """
    left, answers, audit = queue, [], []
    for k in range(1, attempts + 1):
        told = stored(ask(left), "answers")
        good, final = F.col("error").isNull(), is_final(F.col("error"))
        seen = left.select(*keys).join(told.select(*keys, "error", F.lit(True).alias("told")), keys, "left").withColumn("error", F.when(F.col("told").isNull(), "no answer").otherwise(F.col("error")))
        answers.append(told.filter(good).drop("error"))
        done = seen.filter(F.col("error").isNull() | final) if k < attempts else seen
        audit.append(done.select(*keys, F.lit(k).alias("attempt"), F.col("error").isNull().alias("success"), F.left(mask_secrets(F.col("error")), F.lit(ERROR_CHARS)).alias("error")))
        left = stored(queue.join(seen.filter(F.col("error").isNotNull() & ~final).select(*keys), keys, "left_semi"), "unanswered")
        if k == attempts or left.isEmpty():
            break
        wait(2**k * random.uniform(0.5, 1.5))
    return reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, audit)


def semantic_findings(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of a provider (``job_id, json``: an array, or an object with ``findings``). Those without a page, type,
    severity or description are left out; a rule id counts only for a user rule that is in force (``rules``: ``id``)."""
    items = F.coalesce(F.from_json("json", "array<string>"), F.from_json(F.get_json_object("json", "$.findings"), "array<string>"))
    rows = answers.select("job_id", F.explode(items).alias("f")).filter("f LIKE '{%'")
    get = lambda k: F.get_json_object("f", f"$.{k}")
    rows = rows.select("job_id", get("page").try_cast("int").alias("page"), *[get(k).alias(k) for k in ("type", "severity", "description", "rule_id")], F.coalesce(get("ocr_text"), F.lit("")).alias("ocr_text"), F.coalesce(get("operator"), F.lit("")).alias("operator"))
    rows = rows.filter("page IS NOT NULL AND type IS NOT NULL AND severity IS NOT NULL AND description IS NOT NULL")
    rows = rows.withColumn("source", F.when(F.col("type") == "user_rule", "user_rule").otherwise("llm_cross"))
    known = rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "rule_id", "left")
    return rows.withColumn("rule_id", F.when(F.col("known") & (F.col("source") == "user_rule"), F.col("rule_id"))).drop("known")
