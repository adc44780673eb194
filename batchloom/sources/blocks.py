"""Pages from recognised blocks, as data: what a kind of block does is a table, paragraphs are runs between breaks.

A block is one row. Its text comes from its JSON as a variant: the strings under ``content`` in the order of the top level's
keys, else ``text``. ``KINDS`` says how a kind is written and what of it is noise. Of a page's blocks that have something to
say, one of kind ``text`` goes on in the paragraph of the block before it if that is of the same kind and ends no sentence;
every other block begins a paragraph. A running count of the beginnings numbers the paragraphs, and each number is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.functions.text import MARK

# Kinds of blocks by what becomes of them, and the texts that stand for what is missing.
KINDS = {
    "prefix": {"title": "## ", "header": "### ", "page_header": "### "},
    "pictured": ["image", "equation", "equation_interline"],
    "noisy": ["footer", "page_footer", "page_number", "header", "page_header"],
    "numbering": ["footer", "page_footer", "page_number"],
    "lost": ["discarded", "discard"],
    "prose": ["paragraph", "text", "title"],
    "plain": ["paragraph", "title", "header", "page_header", "footer", "page_footer", "page_number", "page_aside_text", "aside_text", "image", "equation", "equation_interline"],
}
SENTENCE_END = r"[。！？.!?;；]$"
NOISE = r"^[\d./%°\-()]{1,20}$"
NUMBERING = r"^(第\s*\d+\s*页|\d+\s*/\s*\d+)$"
PAGE_TITLE, BLANK, NO_TABLE = "## 第 {} 页", "（此页无文本内容）", "[表格内容提取失败 — OCR 结构缺失]"
TABLE_FIELDS = ("html", "table_html", "table_body", "table_markdown")
MACHINE_KEYS = "^(type|bbox|poly|score|conf|idx|id|page_|line_)"
#: Levels of lists and objects that a block's text may lie under.
DEPTH = 8

_NONE = "CAST(array() AS array<variant>)"


def _is(x: str, kind: str) -> str:
    return f"startswith(schema_of_variant({x}), '{kind}')"


def _leaves(start: str, items: str, values: str) -> str:
    """SQL for the strings below some variants, in order. ``items``: what an element ``y`` of a list is opened to; ``values``:
    what an object ``x`` is opened to (both arrays of variants)."""
    opened = f"CASE WHEN {_is('x', 'STRING')} THEN array(x) WHEN {_is('x', 'ARRAY')} THEN flatten(transform(CAST(x AS array<variant>), y -> {items})) WHEN {_is('x', 'OBJECT')} THEN {values} ELSE {_NONE} END"
    found = f"aggregate(sequence(1, {DEPTH}), {start}, (a, i) -> flatten(transform(a, x -> {opened})))"
    return f"transform(filter({found}, x -> {_is('x', 'STRING')}), x -> {_stripped('CAST(x AS string)')})"


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '(?U)^\\s+|\\s+$', '')"


def content_text() -> Column:
    """Text under ``content`` of a block (``v``, its variant; ``fields``, the values of ``content`` if it is an object): of
    list elements strings and what lies in their own ``content``, of objects strings and lists."""
    item = f"CASE WHEN {_is('y', 'STRING')} THEN array(y) WHEN {_is('y', 'OBJECT')} THEN array_compact(array(variant_get(y, '$.content', 'variant'))) ELSE {_NONE} END"
    inner = f"filter(map_values(CAST(x AS map<string,variant>)), z -> {_is('z', 'STRING')} OR {_is('z', 'ARRAY')})"
    start = f"CASE WHEN content IS NULL THEN {_NONE} WHEN {_is('content', 'OBJECT')} THEN filter(fields, z -> {_is('z', 'STRING')} OR {_is('z', 'ARRAY')}) ELSE array(content) END"
    return F.expr(f"array_join(filter({_leaves(start, item, inner)}, s -> s <> ''), ' ')")


def any_text() -> Column:
    """Every string of a block but those under machine keys, for kinds that are not known."""
    said = _leaves("array(v)", "array(y)", f"map_values(map_filter(CAST(x AS map<string,variant>), (k, z) -> NOT k RLIKE '{MACHINE_KEYS}'))")
    return F.expr(f"array_join(filter({said}, s -> length(s) > 1), ' ')")


def table_text() -> Column:
    """The first of a table block's fields that holds something: named ones of ``content``, markup anywhere in it, and those
    of the block itself."""
    string = lambda v, field: F.expr(f"CASE WHEN {_is(f'variant_get({v}, "$.{field}", "variant")', 'STRING')} THEN {_stripped(f'variant_get({v}, "$.{field}", "string")')} END")
    marked = F.expr(f"get(filter(transform(filter(fields, z -> {_is('z', 'STRING')}), z -> {_stripped('CAST(z AS string)')}), s -> s LIKE '%<tr%' OR s LIKE '%<td%'), 0)")
    tries = [string("inner_", f) for f in TABLE_FIELDS] + [marked] + [string("v", f) for f in ("table_body", "markdown", "html")]
    filled = [F.when(t != "", t) for t in tries]
    return F.coalesce(*filled)


def block_texts(blocks: DataFrame) -> DataFrame:
    """``job_id, k, at, kind, lost, said`` from ``job_id, k, at, b`` (``b``: a block's JSON, an object; null: none)."""
    rows = blocks.withColumn("v", F.expr("try_parse_json(b)")).withColumn("content", F.expr("variant_get(v, '$.content', 'variant')"))
    keys = F.expr("json_object_keys(get_json_object(b, '$.content'))")
    is_object = F.expr(_is("content", "OBJECT"))
    rows = rows.withColumn("inner_", F.when(is_object, F.col("content"))).withColumn("of", F.expr("CAST(inner_ AS map<string,variant>)"))
    rows = rows.withColumn("fields", F.coalesce(F.array_compact(F.transform(keys, lambda k: F.element_at(F.col("of"), k))), F.expr(_NONE)))
    kind = F.coalesce(F.expr("try_variant_get(v, '$.type', 'string')"), F.lit("text"))
    rows = rows.withColumn("kind", kind).withColumn("lost", kind.isin(KINDS["lost"]) | F.coalesce(F.expr("schema_of_variant(variant_get(v, '$.discard', 'variant')) = 'BOOLEAN' AND try_variant_get(v, '$.discard', 'boolean')"), F.lit(False)))
    own = lambda field: F.expr(f"coalesce({_stripped(f"try_variant_get(v, '$.{field}', 'string')")}, '')")
    first = lambda *tries: F.coalesce(*[F.when(t != "", t) for t in tries], F.lit(""))
    rows = rows.withColumn("text", content_text()).withColumn("text", first(F.col("text"), F.when(F.col("kind").isin(KINDS["pictured"]), own("caption")), own("text")))
    text, kind = F.col("text"), F.col("kind")
    noise = kind.isin(KINDS["noisy"]) & F.regexp_replace(text, r"[  ]", "").rlike(NOISE) | kind.isin(KINDS["numbering"]) & text.rlike(NUMBERING)
    prefix = F.coalesce(F.create_map(*[F.lit(x) for p in KINDS["prefix"].items() for x in p])[kind], F.lit(""))
    other = first(text, F.when(~kind.isin(KINDS["plain"]), any_text()))
    said = (
        F.when(kind == "table", first(table_text(), other))
        .when(kind.isin(KINDS["pictured"]), F.concat(F.lit("["), kind, F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""), F.lit("]")))
        .when((text == "") & kind.isin(KINDS["plain"]) | noise, F.lit(""))
        .otherwise(F.concat(prefix, other))
    )
    return rows.select("job_id", "k", "at", "kind", F.col("lost"), F.when(~F.col("lost"), said).alias("said"), F.col("b").isNotNull().alias("there"))


def marked_lines(text: Column) -> Column:
    """Lines with marks of unread handwriting named as such; headings of the third level stay."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.startswith("### "), x).otherwise(F.replace(x, F.lit("###"), F.lit(MARK)))), "\n")


def page_title(page: Column) -> Column:
    before, after = PAGE_TITLE.split("{}")
    return F.concat(F.lit(before), page.cast("string"), F.lit(after))


def blank_page(page: Column) -> Column:
    return F.concat(page_title(page), F.lit("\n\n" + BLANK))


def composed(blocks: DataFrame) -> DataFrame:
    """``job_id, page, text, lost, tables, paragraphs`` of every page that has a row in ``job_id, k, at, b`` (pages count from
    0 there; a row without a block only says that there is such a page)."""
    rows = block_texts(blocks)
    table = F.col("kind") == "table"
    order = Window.partitionBy("job_id", "k").orderBy("at")
    speaks = ~F.col("lost") & (table | (F.coalesce("said", F.lit("")) != "")) & F.col("there")
    rows = rows.withColumn("speaks", speaks)
    # the last block before this one that has something to say
    before = F.last(F.when(F.col("speaks"), F.struct("kind", F.col("said").rlike(SENTENCE_END).alias("ended"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    goes_on = (F.col("kind") == "text") & (before["kind"] == "text") & ~before["ended"]
    rows = rows.withColumn("begins", F.when(F.col("speaks"), (~F.coalesce(goes_on, F.lit(False))).cast("int")).otherwise(0))
    rows = rows.withColumn("paragraph", F.sum("begins").over(order))
    line = F.when(table, F.concat(F.lit("\n"), F.when(F.coalesce("said", F.lit("")) != "", F.col("said")).otherwise(NO_TABLE), F.lit("\n"))).otherwise(F.col("said"))
    count = lambda c: F.count_if(c & F.col("there")).cast("int")
    lines = rows.groupBy("job_id", "k", "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("speaks"), F.struct("at", line.alias("line"))))), lambda x: x["line"]), " ").alias("line"), F.max("speaks").alias("speaks"),
        count(F.col("lost") | table & (F.coalesce("said", F.lit("")) == "")).alias("lost"), count(table).alias("tables"), count(F.col("kind").isin(KINDS["prose"])).alias("paragraphs"), count(F.lit(True)).alias("blocks"),
    )
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("speaks"), F.struct("paragraph", "line")))), lambda x: x["line"])
    pages = lines.groupBy("job_id", "k").agg(body.alias("lines"), *(F.sum(c).cast("int").alias(c) for c in ("lost", "tables", "paragraphs", "blocks")))
    number = F.col("k") + 1
    text = F.regexp_replace(marked_lines(F.array_join(F.concat(F.array(page_title(number)), "lines"), "\n")), r"(?U)^\s+|\s+$", "")
    return pages.select("job_id", number.alias("page"), F.when(F.col("blocks") == 0, blank_page(number)).otherwise(text).alias("text"), "lost", "tables", "paragraphs")


def block_rows(files: DataFrame) -> DataFrame:
    """``job_id, k, at, b`` from block lists (``job_id, json``): lists of pages, or flat lists whose blocks name their page
    from 0. Every page up to the last has a row."""
    rows = files.withColumn("items", F.from_json("json", "array<string>"))
    nested = F.coalesce(F.get("items", F.lit(0)).startswith("["), F.lit(False))
    pages = rows.filter(nested).select("job_id", F.posexplode("items").alias("k", "group")).select("job_id", "k", F.posexplode_outer(F.from_json("group", "array<string>")).alias("at", "b"))
    flat = rows.filter(~nested).select("job_id", F.posexplode_outer("items").alias("at", "b")).withColumn("b", F.when(F.col("b").startswith("{"), F.col("b")))
    page = F.expr("CASE WHEN schema_of_variant(variant_get(try_parse_json(b), '$.page_idx', 'variant')) = 'BIGINT' THEN try_variant_get(try_parse_json(b), '$.page_idx', 'int') END")
    flat = flat.select("job_id", F.coalesce(page, F.lit(0)).alias("k"), "at", "b").filter("k >= 0")
    every = flat.groupBy("job_id").agg(F.max("k").alias("last")).select("job_id", F.explode(F.sequence(F.lit(0), "last")).alias("k"), F.lit(-1).alias("at"), F.lit(None).cast("string").alias("b"))
    flat = flat.filter("b IS NOT NULL")
    blocks = pages.withColumn("b", F.when(F.col("b").startswith("{"), F.col("b"))).withColumn("at", F.coalesce("at", F.lit(-1)))
    return blocks.unionByName(flat).unionByName(every)


def content_list_pages(files: DataFrame) -> DataFrame:
    """``job_id, page, text, lost, tables, paragraphs`` of every page of block lists (see ``block_rows``, ``composed``)."""
    return composed(block_rows(files))
