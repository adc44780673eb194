"""Fuzzy dates and times of recognised text, as Column expressions over TIMESTAMP_NTZ.

A text is tried against layouts in a fixed order; the first layout that fits decides (a clock time or a month-day time
takes its missing parts from a fallback date), but a garbled double date whose second date is impossible lets the next
layouts try. Impossible dates give null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: what counts as a date in a batch record.
CLOCK = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
MONTH_DAY = r"^(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"
GARBLED = r"(20\d{2})[/.\-]?(\d{1,2})?[/.\-](20\d{2})[.\-/]?(\d{2})[.\-/]?(\d{2})"
CHINESE = r"((?:19|20)\d{2})年(\d{1,2})月(\d{1,2})日(?:\s*(\d{1,2})[时:](\d{2})分?)?"
PLAIN = r"(?<!\d)((?:19|20)\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})(?:[\sT]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
YEAR = r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])"
TIME_OF_DAY = r"[0-9０-９][:时][0-9０-９]{2}"
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (and that keeps generated code small)."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


#: Whole texts that only ``PLAIN`` or ``CHINESE`` can read (one year, plain digits, no white space around): a cast reads them.
_SIMPLE = r"^(?:19|20)[0-9]{2}(?:[./-][0-9]{1,2}[./-][0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?|年[0-9]{1,2}月[0-9]{1,2}日)\z"


def _simple(text: Column) -> Column:
    return F.coalesce(text.rlike(_SIMPLE), F.lit(False))


def _simple_moment(text: Column) -> Column:
    dashed = F.replace(F.replace(text, F.lit("."), F.lit("-")), F.lit("/"), F.lit("-"))
    return F.when(F.contains(text, F.lit("年")), F.translate(text, "年月日", "--")).otherwise(dashed).try_cast("timestamp_ntz")


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, "(?U)" + pattern, k).try_cast("int")


#: Layouts in the order in which they are tried; the first two take what they lack from the fallback.
_LAYOUTS = (CLOCK, MONTH_DAY, GARBLED, CHINESE, PLAIN, YEAR)


def _moment(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """The moment, or null where a part is out of range (a 60th second would roll over)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    made = F.call_function("try_make_timestamp_ntz", year, month, day, zero(hour), zero(minute), zero(second).cast("decimal(8,6)"))
    return F.when(zero(second) <= 59, made)


def _raw(text: Column) -> Column:
    return F.translate(strip(text), _WIDE, _NARROW)


def _layout(raw: Column, given: Column) -> Column:
    """The number of the layout that decides, from 1 on; null for none."""
    none = F.lit(None).cast("int")
    fits = [raw.rlike("(?U)" + p) for p in _LAYOUTS]
    fits[1] = given & fits[1]
    fits[2] = fits[2] & _moment(*(_group(raw, GARBLED, k) for k in (3, 4, 5)), none, none, none).isNotNull()
    out = F.when(raw == "", none)
    for k, fit in enumerate(fits, 1):
        out = out.when(fit, k)
    return out


def _numbers(raw: Column, layout: Column) -> Column:
    """The numbers that the layout finds, as texts."""
    matched = F.coalesce(*[F.when(layout == k, F.regexp_extract(raw, "(?U)" + p, 0)) for k, p in enumerate(_LAYOUTS, 1) if p != GARBLED])
    second = F.array(*[F.regexp_extract(raw, "(?U)" + GARBLED, k) for k in (3, 4, 5)])
    return F.when(layout == _LAYOUTS.index(GARBLED) + 1, second).otherwise(F.split(F.regexp_replace(matched, "[^0-9]+", ","), ","))


def _read(layout: Column, numbers: Column, fallback: Column) -> Column:
    """The moment of a layout's numbers; a year alone is its first day."""
    n = [F.get(numbers, F.lit(k)).try_cast("int") for k in range(6)]
    clock, short, year = layout == 1, layout == 2, layout == len(_LAYOUTS)
    shift = lambda k: F.when(clock, n[k - 3] if k >= 3 else F.lit(None).cast("int")).when(short, n[k - 1]).otherwise(n[k])
    parts = [F.when(clock | short, F.year(fallback)).otherwise(n[0]), F.when(clock, F.month(fallback)).when(year, 1).otherwise(shift(1)), F.when(clock, F.dayofmonth(fallback)).when(year, 1).otherwise(shift(2))]
    return F.when(layout.isNotNull(), _moment(*parts, *(shift(k) for k in (3, 4, 5))))


def _defaults(fallback: Column | None, given: Column | None) -> tuple[Column, Column]:
    return F.lit(None).cast("timestamp_ntz") if fallback is None else fallback, F.lit(False) if given is None else F.coalesce(given, F.lit(False))


def _dated(layout: Column, given: Column) -> Column:
    """A clock time without a page date is nothing."""
    return F.when((layout != 1) | given, layout)


def parse_time(text: Column, fallback: Column | None = None, fallback_given: Column | None = None) -> Column:
    """The moment a text names. ``fallback``: a moment (``parse_time`` of the page's date); ``fallback_given``: whether
    the page has a date at all, parsable or not. (``with_times`` gives the same as columns, and is faster.)"""
    fallback, given = _defaults(fallback, fallback_given)
    found = lambda raw: let(_dated(_layout(raw, given), given), lambda k: _read(k, _numbers(raw, k), fallback))
    return let(_raw(text), found)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once a row, however often later expressions name them: a generator
    stands between, which no optimiser rule merges with what comes after."""
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("settled_")
    old = [c for c in rows.columns if c not in columns]
    return rows.select("*", made).select(*[F.col(f"`{c}`") for c in old], *[F.col(f"settled_.`{n}`").alias(n) for n in columns])


def with_times(rows: DataFrame, **named: tuple[Column, Column | None, Column | None]) -> DataFrame:
    """``rows`` with a moment for each name, from (text, fallback, whether there is a fallback) as ``parse_time`` takes them:
    the normalised text, its layout and its numbers are found one after the other, in generated code. Most texts have a plain
    layout and are read at once; the search through the layouts then sees a null."""
    given = {n: _defaults(fallback, has) for n, (_, fallback, has) in named.items()}
    c = F.col
    out = settled(rows, **{f"{n}_text": text for n, (text, _, _) in named.items()}, **{f"{n}_simple": _simple(text) for n, (text, _, _) in named.items()}, **{f"{n}_given": has for n, (_, has) in given.items()}, **{f"{n}_base": base for n, (base, _) in given.items()})
    out = settled(out, **{f"{n}_raw": F.when(~c(f"{n}_simple"), _raw(c(f"{n}_text"))) for n in named})
    out = settled(out, **{f"{n}_layout": _dated(_layout(c(f"{n}_raw"), c(f"{n}_given")), c(f"{n}_given")) for n in named})
    out = settled(out, **{f"{n}_numbers": _numbers(c(f"{n}_raw"), c(f"{n}_layout")) for n in named})
    out = settled(out, **{n: F.when(c(f"{n}_simple"), _simple_moment(c(f"{n}_text"))).otherwise(_read(c(f"{n}_layout"), c(f"{n}_numbers"), c(f"{n}_base"))) for n in named})
    return out.drop(*[f"{n}_{x}" for n in named for x in ("text", "simple", "raw", "given", "base", "layout", "numbers")])


def parse_year(text: Column) -> Column:
    """The year of the moment, else a bare year."""
    return year_of(text, parse_time(text))


def year_of(text: Column, moment: Column) -> Column:
    return F.coalesce(F.year(moment), _group(F.translate(text, _WIDE, _NARROW), YEAR, 1))


def interval(text: Column, moment: Column) -> Column:
    """``start, end, precise``: a point where the text has a time of day, else the whole day; null without a moment."""
    precise = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("时"))) & text.rlike(TIME_OF_DAY)
    end = F.when(precise, moment).otherwise(moment + F.expr("INTERVAL 1 DAY"))
    return F.when(moment.isNotNull(), F.struct(moment.alias("start"), end.alias("end"), precise.alias("precise")))


def after(a: Column, b: Column) -> Column:
    """Interval ``a`` lies wholly after ``b``; a whole day may have ended anywhere before its end."""
    return (a["start"] > b["end"]) | ((a["start"] == b["end"]) & ~b["precise"])


def before(a: Column, b: Column) -> Column:
    return (a["end"] < b["start"]) | ((a["end"] == b["start"]) & ~a["precise"])


def step_key(step_no: Column) -> Column:
    """Sorting number of a step: the first number in its name, 9999 without one."""
    return F.coalesce(F.regexp_extract(F.translate(step_no, _WIDE, _NARROW), r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(9999.0))
