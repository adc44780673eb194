"""Structured results that models return as text: parsing, repair, and progress notes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.dates import strip

RAW_LIMIT = 500


def unfenced(c: Column) -> Column:
    """Without a Markdown fence around the whole text."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[^\n]*\n", ""), r"\n\s*```\s*$", ""))


def _closed(text: str) -> str | None:
    """A cut JSON text, cut back to its last whole value and closed; None where nothing is open."""
    stack, quote, escaped = [], -1, False
    for i, ch in enumerate(text):
        if quote >= 0:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quote = -1
        elif ch == '"':
            quote = i
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    if not stack:
        return None
    body = (text[:quote] if quote >= 0 else text).rstrip()
    if not re.search(r"(?:[\s:,\[{]|^)(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)$", body):
        body = re.sub(r"[A-Za-z0-9.+\-]+$", "", body).rstrip()
    if body.endswith(":"):
        body += "null"
    return body.rstrip().removesuffix(",") + "".join(reversed(stack))


def _recovered(text: str) -> str:
    """JSON text of what can be read: as it is, its first block, or the closed cut text; else a note of the failure."""
    tries = [text]
    if not text.startswith(("{", "[")):
        tries += [text[a : b + 1] for o, c in ("{}", "[]") if (a := text.find(o)) != -1 and (b := text.rfind(c)) > a]
    elif (closed := _closed(text)) is not None:
        tries.append(closed)
    for k, one in enumerate(tries):
        try:
            value = json.loads(one)
        except ValueError:
            continue
        if k and text.startswith("{") and isinstance(value, dict):
            value["_truncated_recovered"] = True
        return json.dumps(value, ensure_ascii=False)
    return json.dumps({"_parse_error": True, "_raw": text[:RAW_LIMIT]}, ensure_ascii=False)


def _recovered_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _recovered(t))


def parse_json(c: Column) -> Column:
    """JSON text of a model's answer. Sound answers stay in the JVM; the others are repaired by an Arrow function."""
    text = unfenced(c)
    sound = F.call_function("try_parse_json", text).isNotNull()
    return F.when(c.isNull(), None).when(sound, text).otherwise(F.pandas_udf(_recovered_all, T.StringType())(F.when(~sound, text)))


def first_object(c: Column) -> Column:
    """A result that is a list as its first item, if that is an object; other results as they are."""
    head = F.get_json_object(c, "$[0]")
    return F.when(F.ltrim(c).startswith("["), F.when(head.startswith("{"), head)).otherwise(c)


def parsed_ok(c: Column) -> Column:
    return c.isNotNull() & c.startswith("{") & F.coalesce(F.get_json_object(c, "$._parse_error") != "true", F.lit(True))


def progress(c: Column) -> Column:
    """``done, total`` of a progress note; null for none or an unreadable one."""
    note = F.from_json(c, "done string, total string")
    number = lambda x: F.coalesce(x.try_cast("double").cast("int"), F.lit(0))
    return F.when(F.call_function("try_parse_json", c).isNotNull() & c.startswith("{"), F.struct(number(note["done"]).alias("done"), number(note["total"]).alias("total")))


def phase(status: Column, analyzed: Column, total: Column) -> Column:
    done = ["review", "partial_review", "error", "cancelled", "archived"]
    return F.when(status == "ocr_running", "ocr").when(status == "analyzing", F.when((total > 0) & (analyzed >= total), "cross").otherwise("analyze")).when(status.isin(done), "done").otherwise("idle")
