"""Cleaning, masking and searching of recognised text and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.dates import let, strip
from batchloom.schema import UNREADABLE

HTML_LIMIT, MARKER_ROOM = 12_000, 128
MARK = f"[{UNREADABLE}]"
# Words in column names that tell written from printed values; labels of codes.
WRITTEN_WORDS = ("实际", "实测", "记录", "填写", "手写", "结果", "偏差")
PRINTED_WORDS = ("规格", "标准", "范围", "指导", "要点", "要求", "检查项目", "项目")
SEVERITY_LABELS = {"critical": "严重", "warning": "警告", "info": "提示"}
STATUS_LABELS = {"pending": "待复核", "confirmed": "已确认", "rejected": "已拒绝", "corrected": "已修正"}


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


_ATTRIBUTES = ((r"""(?U)\s*style=['"][^'"]*['"]""", ""), (r"""(?U)\s*width=['"][^'"]*['"]""", ""), (r"""(src=["'])[^"']*/([^/"']+)(["'>])""", "$1$2$3"))


def clean_ocr(c: Column) -> Column:
    """Recognised text before it is stored: formula remains, styles, empty cells, control characters, page-number lines and
    surplus white space go. The steps depend on their order."""
    s = _chain(c, (r"\$+", ""), (r"\\[a-zA-Z]{2,}", ""), (r"[{}]", ""), (r"\\n", "\n"), (r"\\t", "\t"), *_ATTRIBUTES)
    s = _chain(s, (r"(?iU)<td>(?:&nbsp;|\s)*</td>", "<td></td>"), (r"(?U)>\s+<", "><"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " "), (r" {2,}", " "))
    lines = F.filter(F.split(s, "\n", -1), lambda x: ~strip(x).rlike(r"(?U)^(第\s*\d+\s*页|\d+\s*/\s*\d+)$"))
    return strip(_chain(F.array_join(lines, "\n"), (r"\n{3,}", "\n\n")))


_TABLE = r"(?s)<table[\s>].*?</table>"


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _within_limit(html: Column, original: Column) -> Column:
    """Markup over the limit cut to it, with a note of what went.

    Tables come first: all of them if they fit, else each that fits into what the kept ones before it leave. Other text gets
    the room that all tables leave, in order. Markup from which nothing can be kept so is cut at a table's or row's limit.
    """
    room = HTML_LIMIT - MARKER_ROOM
    size = lambda texts: F.transform(texts, lambda x: F.length(x))
    parts = F.struct(F.regexp_extract_all(html, F.lit(_TABLE), F.lit(0)).alias("tables"), F.split(html, _TABLE, -1).alias("texts"))

    def measured(x: Column) -> Column:
        total = _sum(size(x["tables"]))
        greedy = F.aggregate(
            size(x["tables"]), F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("keep")),
            lambda a, n: F.struct((a["used"] + F.when(a["used"] + n <= room, n).otherwise(0)).alias("used"), F.array_append(a["keep"], a["used"] + n <= room).alias("keep")), lambda a: a["keep"],
        )
        keep = F.when(total <= room, F.transform(x["tables"], lambda t: F.lit(True))).otherwise(greedy)
        return F.struct(x["tables"].alias("tables"), x["texts"].alias("texts"), keep.alias("keep"), F.greatest(F.lit(room) - total, F.lit(0)).alias("left"))

    def assembled(x: Column) -> Column:
        before = lambda i: _sum(size(F.slice(x["texts"], F.lit(1), i)))
        share = lambda t, i: F.greatest(x["left"] - before(i), F.lit(0))
        text = F.transform(x["texts"], lambda t, i: F.when(F.length(t) <= share(t, i), t).otherwise(F.regexp_replace(F.substring(t, F.lit(1), share(t, i)), r"(?U)\s+$", "")))
        kept = F.zip_with(x["tables"], x["keep"], lambda t, k: F.when(k, t).otherwise(""))
        whole = F.array_join(F.zip_with(text, kept, lambda a, t: F.concat(F.coalesce(a, F.lit("")), F.coalesce(t, F.lit("")))), "")
        skipped = F.size(F.filter(x["keep"], lambda k: ~k))
        cut = _sum(size(x["texts"])) > x["left"]
        some = (F.size(x["tables"]) > 0) & (F.exists(x["keep"], lambda k: k) | ((x["left"] > 0) & (_sum(size(x["texts"])) > 0)))
        lost = F.concat(F.when(skipped > 0, F.concat(F.lit("，跳过 "), skipped.cast("string"), F.lit(" 个表格"))).otherwise(""), F.when(cut, "，部分正文被裁剪").otherwise(""))
        return F.when(some, F.concat(whole, note, lost)).otherwise(F.concat(let(F.substring(html, 1, HTML_LIMIT), _clean_end), note))

    note = F.concat(F.lit("\n[HTML 已截断：原文 "), original.cast("string"), F.lit(f" 字符，超过上限 {HTML_LIMIT}"))
    return F.concat(let(let(parts, measured), assembled), F.lit("，本页信息可能不完整]"))


def _clean_end(head: Column) -> Column:
    """The head of a page up to its last whole table or row begun, if that lies in its last two fifths; an open table closed."""
    least = int(HTML_LIMIT * 0.6)
    after_table = F.length(F.regexp_extract(head, "(?s)^(.*)</table>", 1))
    before_row = F.length(F.regexp_extract(head, "(?s)^(.*)<t[rd]", 1))
    cut = F.when(after_table > least, F.substring(head, F.lit(1), after_table + 8)).when(before_row > least, F.substring(head, F.lit(1), before_row)).otherwise(head)
    return let(cut, lambda x: F.when(F.regexp_count(x, F.lit(r"<table[\s>]")) > F.regexp_count(x, F.lit("</table>")), F.concat(x, F.lit("</table>"))).otherwise(x))


def collapsed_html(c: Column) -> Column:
    """Markup with attributes shortened and white space collapsed."""
    return _chain(c, *_ATTRIBUTES, (r"(?U)\s+", " "))


def clean_html(c: Column) -> Column:
    """A page's markup for a model: collapsed, longer pages cut to the limit."""
    return let(collapsed_html(c), lambda s: F.when(F.length(s) > HTML_LIMIT, _within_limit(s, F.length(c))).otherwise(s))


def plain_text(c: Column) -> Column:
    """Tags as spaces, white space collapsed."""
    return strip(_chain(c, ("<[^>]+>", " "), (r"(?U)\s+", " ")))


def readable_text(c: Column) -> Column:
    """Markup as lines of text with cells between bars."""
    return strip(_chain(
        c, (r"\\n", "\n"), (r"\\t", "\t"), (r"(?i)<br\s*/?>", "\n"), ("(?i)<img[^>]*>", "[图]"), ("(?i)</tr>", "\n"), ("(?i)</t[dh]>", " | "), ("(?i)</p>", "\n"), ("(?i)<div[^>]*>", "\n"), ("<[^>]+>", ""),
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), (r"[ \t]+", " "), (r" *\| *", " | "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ))


def mark_unreadable(c: Column) -> Column:
    """The recogniser's ``###`` as a plain mark, except at headings."""
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(x.startswith("### "), x).otherwise(F.replace(x, F.lit("###"), F.lit(MARK)))), "\n")


def redact_urls(c: Column) -> Column:
    """Addresses without their queries (which may hold signatures); long paths cut."""
    no = r"\s\"'<>"
    return _chain(
        c, (rf"(?i)\b(https?://[^{no}?#]*)\?[^{no}#]+(?:#[^{no}]*)?", "$1?<redacted>"), (rf"(?i)\b(/[^{no}?]*)\?[^{no}]+", "$1?<redacted>"),
        (rf"(?i)\b(https?://[^{no}?#]*)(?:\?(?!<redacted>)|#[^{no}]*)+", "$1"), (rf"(?i)\b(https?://[^{no}/?#]*/[^{no}?#]{{119}})[^{no}?#]++(?!\?<redacted>)", "$1..."),
    )


def mask_secrets(c: Column) -> Column:
    # Fixed patterns: forms of keys and tokens in messages.
    return _chain(c, (r"sk-[A-Za-z0-9_-]{8,}", "sk-***"), (r"(?<![0-9a-fA-F])[0-9a-fA-F]{32}(?![0-9a-fA-F])", "***"), (r"cli_[A-Za-z0-9_-]{8,}", "cli_***"), (r"cli-[A-Za-z0-9]{10,}", "cli-***"), (r"(?i)Bearer\s+[A-Za-z0-9._-]{8,}", "Bearer ***"))


def mask_key(c: Column) -> Column:
    """A key's ends, or stars only for a short one."""
    return F.when(F.length(c) <= 12, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(4))))


def escape_markup(c: Column, quotes: bool = False) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&#34;"), ("'", "&#39;")) if quotes else ())):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_markdown(c: Column) -> Column:
    """Text that stays text in a Markdown report."""
    c = escape_markup(c)
    for char in "![]()":
        c = F.replace(c, F.lit(char), F.lit(f"&#{ord(char)};"))
    return c


def page_links(c: Column, job: Column) -> Column:
    linked = F.concat(F.lit('<a href="/jobs/'), job, F.lit('/review?page=$1" class="page-link">第$1页</a>'))
    return F.regexp_replace(escape_markup(c, quotes=True), F.lit(r"第(\d+)页"), linked)


def locate(excerpt: Column, text: Column) -> Column:
    """``token, place``: the first word of four characters or more of an excerpt that the text holds (place from 0)."""
    words = F.filter(F.split(excerpt, r"[\s|；;，,]+", -1), lambda w: (F.length(w) >= 4) & F.contains(text, w))
    return F.when(F.size(words) > 0, F.struct(words[0].alias("token"), (F.call_function("instr", text, words[0]) - 1).alias("place")))


def value_source(name: Column, given: Column | None = None) -> Column:
    """``handwritten``, ``printed`` or ``unknown`` from a column's name, unless given."""
    guess = F.when(name.rlike("|".join(WRITTEN_WORDS)), "handwritten").when(name.rlike("|".join(PRINTED_WORDS)), "printed").otherwise("unknown")
    return guess if given is None else F.when(given.isNotNull() & (given != ""), given).otherwise(guess)


def names_match(name: Column, tokens: Column) -> Column:
    """A name and a token of two characters or more hold one another."""
    return F.coalesce(F.exists(tokens, lambda t: (F.length(t) >= 2) & (F.contains(name, t) | F.contains(t, name))), F.lit(False)) & (name != "")


def page_letters(html: Column) -> Column:
    """A page's text without tags and white space, in lower case, to look values up in."""
    return F.lower(_chain(html, ("<[^>]+>", " "), (r"(?U)\s+", "")))


def grounded(letters: Column, value: Column) -> Column:
    """One number of a value stands in the page: long ones anywhere, short ones not inside another number."""
    v = F.lower(F.regexp_replace(value, r"(?U)\s+", ""))

    def stands(p: Column) -> Column:
        long = F.length(F.regexp_replace(p, "[^0-9]", "")) >= 4
        alone = F.regexp_like(letters, F.concat(F.lit(r"(^|[^0-9.])\Q"), p, F.lit(r"\E($|[^0-9.])")))
        return F.when(long, F.contains(letters, p)).otherwise(alone)

    found = F.transform(F.array(v), lambda v: F.regexp_extract_all(v, F.lit(r"(\d+\.?\d*)"), F.lit(1)))[0]
    return F.when(F.length(letters) < 4, True).when(F.size(found) == 0, True).otherwise(F.exists(found, stands))


def warning_of(c: Column) -> Column:
    """``warning, text``: a recogniser's warning in front of a page's text, and the text without it."""
    pattern = r"^\[OCR 警告:\s*([^\]]+)\]"
    return F.struct(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("warning"), strip(F.regexp_replace(c, pattern, "")).alias("text"))


def sparse_page(html: Column) -> Column:
    table = F.contains(html, F.lit("<table"))
    return (~table & (F.length(html) < 80)) | (table & (F.regexp_count(html, F.lit("<tr")) < 3) & (F.length(html) < 200))


def empty_page(html: Column) -> Column:
    return (F.length(html) < 100) | (F.length(F.regexp_replace(html, "<[^>]+>", "")) < 100)


# Fixed patterns: a label before the mark, and names that are only numbers or dates.
LABEL = r"([\u4e00-\u9fffA-Za-z0-9()（）/·._%+\-]{2,40})[：:]?\s*\[?" + UNREADABLE
NUMBERS_ONLY = r"^[\d./\-:年月日\s]+$"


def _marked(cells: Column, names: Column) -> Column:
    """The names at the places of marked cells."""
    return F.filter(F.zip_with(names, F.slice(cells, F.lit(1), F.size(names)), lambda n, x: F.when(F.contains(x, F.lit(UNREADABLE)), n)), lambda n: n.isNotNull())


def _table_names(table: Column) -> Column:
    """Marked columns of a table in markup. Places count on through all data cells, so only the first data row lines up."""
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?s)<(t[dh])\b[^>]*>(.*?)</\1>"), F.lit(2))
    rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr\b.*?</tr>"), F.lit(0))
    return let(rows, lambda r: F.when(F.size(r) > 0, _marked(F.flatten(F.transform(F.slice(r, F.lit(2), F.size(r)), cells)), cells(r[0]))))


def _bar_names(block: Column) -> Column:
    """Marked columns of a run of lines between bars."""
    cells = lambda row: F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1), strip)
    rows = F.filter(F.split(block, "\n", -1), lambda x: strip(x) != "")
    return let(F.transform(rows, cells), lambda r: F.flatten(F.transform(F.slice(r, F.lit(2), F.size(r)), lambda row: _marked(row, r[0]))))


def unreadable_names(c: Column) -> Column:
    """Names of fields and columns whose value the recogniser could not read, in order of appearance."""
    lines = F.regexp_replace(c, r"\r\n?", "\n")
    spans = r"<t[dh]\b[^>]*(?:col|row)span"
    tables = F.filter(F.regexp_extract_all(lines, F.lit(r"(?s)<table\b.*?</table>"), F.lit(0)), lambda t: ~t.rlike(spans))
    bars = F.regexp_extract_all(lines, F.lit(r"(?m)((?:^[ \t]*\|[^\n]*(?:\n|\z))+)"), F.lit(1))
    none = F.array().cast("array<string>")
    every = F.concat(
        F.regexp_extract_all(lines, F.lit(LABEL), F.lit(1)),
        F.flatten(F.transform(tables, lambda t: F.coalesce(_table_names(t), none))),
        F.flatten(F.transform(bars, lambda b: F.coalesce(_bar_names(b), none))),
    )
    bare = F.transform(every, lambda n: F.replace(F.regexp_replace(strip(F.regexp_replace(n, "<[^>]+>", "")), r"^[*`]+|[*`]+$", ""), F.lit(" "), F.lit("")))
    good = lambda names: F.filter(names, lambda n: F.length(n).between(2, 40) & ~n.rlike(NUMBERS_ONLY) & ~F.contains(n, F.lit(UNREADABLE)))
    found = F.array_distinct(good(F.flatten(F.transform(good(bare), lambda n: F.split(n, "/", -1)))))
    return F.when(F.contains(c, F.lit(UNREADABLE)), found).otherwise(none)
