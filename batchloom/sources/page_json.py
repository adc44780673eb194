"""Page results stored as JSON text: typed pages, one level at a time, dropping or converting what has the wrong type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.functions.dates import let
from batchloom.functions.jsonx import first_object, parsed_ok
from batchloom.functions.text import names_match, value_source
from batchloom.schema import EVENT_TYPES, UNREADABLE


def _objects(json: str) -> str:
    """SQL for the elements of a JSON array that are objects."""
    return f"coalesce(filter(from_json({json}, 'array<string>'), x -> x LIKE '{{%'), array())"


def _struct(json: str, *fields: str) -> str:
    return ", ".join(f"'{f}', get_json_object({json}, '$.{f}')" for f in fields)


_VALUES = f"""transform(filter(coalesce(map_entries(from_json(get_json_object(m, '$.values'), 'map<string,string>')), array()), e -> e.value LIKE '{{%'),
  e -> named_struct('col', e.key, {_struct("e.value", "spec", "actual", "unit", "value_source")}))"""
_STEPS = f"""transform({_objects("get_json_object(j, '$.steps')")}, s -> named_struct({_struct("s", "step_no", "operation", "start_time", "end_time", "operator", "reviewer")},
  'parameters', transform({_objects("get_json_object(s, '$.parameters')")}, p -> named_struct({_struct("p", "name", "spec_range", "value", "unit", "value_source")}, 'in_spec', try_cast(get_json_object(p, '$.in_spec') AS boolean))),
  'measurements', transform({_objects("get_json_object(s, '$.measurements')")}, m -> named_struct('time', get_json_object(m, '$.time'), 'values', {_VALUES})),
  'signatures', transform({_objects("get_json_object(s, '$.signatures')")}, g -> named_struct({_struct("g", "role", "name", "sign_time")})),
  'checks', transform({_objects("get_json_object(s, '$.checks')")}, c -> named_struct({_struct("c", "item", "selected", "marker")})),
  'handwritten', coalesce(from_json(get_json_object(s, '$.handwritten'), 'array<string>'), array())))"""
_YEARS = """coalesce(transform_values(from_json(get_json_object(j, '$.event_year_groups'), 'map<string,string>'), (k, v) -> coalesce(filter(from_json(v, 'array<string>'), y -> try_cast(y AS int) IS NOT NULL), array())), map())"""


def typed_pages(rows: DataFrame) -> DataFrame:
    """Pages for the rules from ``job_id, page, structured_json``; unreadable results are
    left out, and a list stands for its first object. A value's source is,
    in this order: handwritten where its name or the value itself carries the recogniser's mark, as given, by its name."""
    rows = rows.withColumn("j", first_object(F.col("structured_json"))).filter(parsed_ok(F.col("j")))
    info = F.when(F.get_json_object("j", "$.page_info").startswith("{"), F.from_json(F.get_json_object("j", "$.page_info"), "title string, file_code string, version string, batch_no string, production_date string"))
    names = F.coalesce(F.from_json(F.get_json_object("j", "$._ocr_low_conf_cols"), "array<string>"), F.array().cast("array<string>"))
    rows = rows.select(
        "job_id", F.col("page").cast("int").alias("page"), info.alias("page_info"), F.expr(_YEARS).alias("event_year_groups"), F.expr(_STEPS).alias("steps"),
        F.expr(f"transform({_objects('get_json_object(j, ' + chr(39) + '$.findings' + chr(39) + ')')}, f -> named_struct({_struct('f', 'type', 'severity', 'description', 'ocr_text', 'operator')}))").alias("findings"),
        F.get_json_object("j", "$.overall_confidence").alias("overall_confidence"), names.alias("low_conf_cols"),
    )

    def source(name, value, given):
        return F.when(names_match(F.coalesce(name, F.lit("")), F.col("low_conf_cols")) | F.coalesce(F.contains(value, F.lit(UNREADABLE)), F.lit(False)), "handwritten").otherwise(value_source(F.coalesce(name, F.lit("")), given))

    def filled_step(s):
        params = F.transform(s["parameters"], lambda p: p.withField("value_source", source(p["name"], p["value"], p["value_source"])))
        cells = F.transform(s["measurements"], lambda m: m.withField("values", F.transform(m["values"], lambda v: v.withField("value_source", source(v["col"], v["actual"], v["value_source"])))))
        return s.withField("parameters", params).withField("measurements", cells)

    return rows.withColumn("steps", F.transform("steps", filled_step))


def problems(c, page):
    """What is wrong with a page result (an empty array for a sound one)."""
    # each part is taken from the text once; fields below it only where the part names them
    parts = F.struct(*[F.get_json_object(c, f"$.{f}").alias(f) for f in ("page_info", "steps", "findings", "event_year_groups")])
    return let(parts, lambda told: _problems(c, page, told))


def _problems(c, page, told):
    get = lambda p: F.get_json_object(c, p)
    named = lambda text, f: F.contains(text, F.lit(f'"{f}"'))
    say = lambda when, what: F.when(when, F.lit(what) if isinstance(what, str) else what)
    top = [say(told[f].isNull(), f"missing field: {f}") for f in ("page_info", "steps")]
    info = say(told["page_info"].startswith("{") & get("$.page_info.title").isNull(), "page_info missing: title")
    steps, groups = told["steps"], told["event_year_groups"]
    broken = steps.isNotNull() & ~steps.startswith("[")
    items = F.coalesce(F.from_json(told["findings"], "array<string>"), F.array().cast("array<string>"))
    drift = F.array_compact(F.transform(items, lambda x, i: F.when(x.startswith("{") & ~F.get_json_object(x, "$.page").eqNullSafe(page.cast("string")), F.concat(F.lit("findings["), i.cast("string"), F.lit("].page="), F.coalesce(F.get_json_object(x, "$.page"), F.lit("None")), F.lit(" must be "), page.cast("string"), F.lit(" (current PDF page)")))))
    kinds = F.array_compact(F.array(say(~groups.startswith("{"), "event_year_groups must be an object"), *[say(named(groups, k) & ~get(f"$.event_year_groups.{k}").startswith("["), f"event_year_groups.{k} must be an array") for k in EVENT_TYPES], say(~told["findings"].startswith("["), "findings must be an array")))
    each = F.coalesce(F.from_json(steps, "array<string>"), F.array().cast("array<string>"))
    fields = F.flatten(F.transform(each, lambda s, i: F.array_compact(F.array(*[F.when(s.startswith("{") & named(s, f) & ~F.get_json_object(s, f"$.{f}").startswith("["), F.concat(F.lit("step["), i.cast("string"), F.lit(f"].{f} must be an array"))) for f in ("measurements", "signatures", "checks")]))))
    early = F.array_compact(F.array(*top, info, say(broken, "steps is not a list")))
    return F.when(broken, early).otherwise(F.concat(early, drift, kinds, fields))
