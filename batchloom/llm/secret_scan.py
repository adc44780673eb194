"""Operator 8: secrets in whole texts, by patterns and by sliding-window Shannon entropy, in SQL expressions only.

Pattern spans (``assign``, ``access``, ``hex``) are the leftmost non-overlapping matches of each kind; positions come from
the lengths of the pieces between matches, in code points, ends exclusive. The entropy method looks at candidate strings:
runs of base64 characters, cut where a sample word stands between delimiters or an alphabet begins, so that such a word hides
nothing beside it. Each is sorted into a character class (``hex``, ``lower`` or ``upper`` letters with digits, or ``base64``)
and a window of ``WINDOW`` characters slides along it. A fold carries how often each character stands in the window and the
sum of ``c * log2(c)`` of these counts; a step changes the counts of the character that leaves and of the one that enters, so
it costs the same whatever the candidate's length. The span from the first to the last window at or above the class's
threshold is added, unless an allow-list pattern fits that span or a pattern span already holds it.

Prefix sums and maxima over a text's matches are taken in blocks of about the square root of their number, so a text of a
hundred thousand matches does not cost their square.

Edge cases: a null text counts as an empty one and has no spans (hash of the empty string); repeated rows give repeated
results; texts and candidates of any length are scanned whole; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import free_name, table, text_or_empty

WINDOW = 20
#: Classes of candidates in the order they are tried, with their pattern and the least entropy of a window.
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.0), "lower": ("^[0-9a-z]+$", 3.6), "upper": ("^[0-9A-Z]+$", 3.6), "base64": ("", 3.7)}
#: A span of high entropy that one of these fits as a whole is no secret: words, letters of one case, number strings.
ALLOW = ("^[_=+/-]*+([A-Z]?+[a-z]{2,}+[_=+/-]*+)++$", "^[A-Z_=+/-]*$", "^[0-9_=+/-]*$")
#: Where candidates are cut: sample words between delimiters (a candidate gets one on either side first), and alphabets.
SAMPLE = "(?i)[_=+/-]((example|sample|placeholder|dummy|xxxx+)[_=+/-])+|0123456789|abcdefghij"
KINDS = ("assign", "access", "hex", *(f"entropy_{c}" for c in CLASSES))
PLACEHOLDER = "[SECRET]"

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of one class is found whole, so its least length can be part of the pattern; "assign" is filtered afterwards.
PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: The characters of candidates.
SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
#: Characters of a stretch that parts of a text are read from.
STRETCH = 16384


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once for a body that names it often."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefix(values: str, start: str, put: str) -> str:
    """SQL for the running fold (``put`` of ``a`` and ``x``, associative) of an array of integers, a value for each place."""
    fold = lambda part: f"aggregate({part}, {start}, (a, x) -> {put})"
    before = _let("sums", f"transform(sequence(0, (size(v) - 1) div w), b -> {fold('slice(v, b * w + 1, w)')})", f"transform(sequence(0, size(sums) - 1), b -> {fold('slice(sums, 1, b)')})")
    each = _let("before", before, f"transform(v, (y, i) -> aggregate(slice(v, i - i % w + 1, i % w + 1), before[i div w], (a, x) -> {put}))")
    return _let("v", values, f"if(size(v) = 0, CAST(array() AS array<int>), {_let('w', 'greatest(8, CAST(ceil(sqrt(size(v))) AS int))', each)})")


def _matches(text: str, pattern: str) -> str:
    """SQL for ``start, stop, s`` (the match) and ``g`` (group 2, or the match) of all matches of a pattern."""
    p = _quoted(pattern)
    group = f"regexp_extract_all({text}, {p}, 2)" if pattern == _ASSIGN else "found"
    stops = _prefix(f"zip_with(slice(split({text}, {p}, -1), 1, size(found)), found, (x, y) -> length(x) + length(y))", "0", "a + x")
    rows = _let("gs", group, _let("ends", stops, "transform(found, (x, i) -> named_struct('start', ends[i] - length(x), 'stop', ends[i], 's', x, 'g', gs[i]))"))
    return f"CASE WHEN {text} RLIKE {p} THEN {_let('found', f'regexp_extract_all({text}, {p}, 0)', rows)} ELSE CAST(array() AS array<struct<start:int,stop:int,s:string,g:string>>) END"


def _spans(text: str, pattern: str, rank: int, keep: str = "true") -> str:
    """SQL for the spans of a pattern's matches; ``keep``: a condition on ``m.g``."""
    return f"transform(filter({_matches(text, pattern)}, m -> {keep}), m -> named_struct('start', m.start, 'rank', {rank}, 'stop', m.stop))"


def _entropy_hits(codes: str, threshold: str) -> str:
    """SQL for ``first, last``: ends (1-based) of the first and last window whose entropy reaches the threshold, or 0.

    ``codes``: each character's place in ``SYMBOLS``, from 1 on."""
    logs = "array(" + ",".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 2)) + ")"
    # at step i the character at i - WINDOW leaves (0: none does yet), then the one at i enters
    without = "if(o = 0, a.s, a.s - l[a.n[o - 1]] + l[a.n[o - 1] - 1])"
    more = f"if(o = c, a.s, {_let('k', 'a.n[c - 1]', f'{without} - l[k] + l[k + 1]')})"
    counts = "if(o = c, a.n, transform(a.n, (x, j) -> x + int(j + 1 = c) - int(j + 1 = o)))"
    hit = f"i >= {WINDOW} AND {math.log2(WINDOW)!r}D - s / {WINDOW} >= {threshold}"
    step = _let("s", more, _let("hit", hit, f"named_struct('s', s, 'n', {counts}, 'first', if(hit AND a.first = 0, i, a.first), 'last', if(hit, i, a.last))"))
    step = _let("o", f"if(i > {WINDOW}, {codes}[i - {WINDOW + 1}], 0)", _let("c", f"{codes}[i - 1]", step))
    start = f"named_struct('s', 0D, 'n', array_repeat(0, {len(SYMBOLS)}), 'first', 0, 'last', 0)"
    return _let("l", logs, f"aggregate(sequence(1, size({codes})), {start}, (a, i) -> {step}, a -> named_struct('first', a.first, 'last', a.last))")


def _candidates(text: str) -> str:
    """SQL for ``start, s`` of the candidates: matches of ``CANDIDATE`` cut at ``SAMPLE``, and what is left long enough."""
    p = _quoted(SAMPLE)
    # parts of "/" + s + "/" between the samples; ends[i] is where part i ends there, one more than in s
    ends = _prefix("zip_with(ps, xs, (x, y) -> length(x) + coalesce(length(y), 0))", "0", "a + x")
    part = "named_struct('start', greatest(b - 1, 0), 'stop', least(b - 1 + length(x), length(m.s)))"
    cut = _let("es", ends, f"transform(ps, (x, i) -> {_let('b', 'if(i = 0, 0, es[i - 1])', part)})")
    cut = _let("w", "concat('/', m.s, '/')", _let("xs", f"regexp_extract_all(w, {p}, 0)", _let("ps", f"split(w, {p}, -1)", cut)))
    pieces = f"filter(transform({cut}, y -> named_struct('start', m.start + y.start, 's', substring(m.s, y.start + 1, y.stop - y.start))), y -> length(y.s) >= {WINDOW})"
    whole = "array(named_struct('start', m.start, 's', m.s))"
    return f"flatten(transform({_matches(text, CANDIDATE)}, m -> if(concat('/', m.s, '/') RLIKE {p}, {pieces}, {whole})))"


def _entropy_spans(text: str, base: str) -> str:
    kind = "CASE " + " ".join(f"WHEN m.s RLIKE '{p}' THEN {k}" if p else f"ELSE {k}" for k, (p, _) in enumerate(CLASSES.values())) + " END"
    least = "array(" + ",".join(f"{t}D" for _, t in CLASSES.values()) + ")"
    hits = _let("codes", f"transform(split(m.s, ''), x -> instr('{SYMBOLS}', x))", _entropy_hits("codes", f"{least}[m.k]"))
    found = f"transform({_candidates(text)}, m -> named_struct('start', m.start, 's', m.s, 'k', {kind}))"
    scored = f"transform({found}, m -> named_struct('start', m.start, 's', m.s, 'k', m.k, 'hit', {hits}))"
    part = f"substring(m.s, m.hit.first - {WINDOW - 1}, m.hit.last - m.hit.first + {WINDOW})"
    allow = " AND ".join(f"NOT {part} RLIKE {_quoted(p)}" for p in ALLOW)
    spans = f"transform(filter({scored}, m -> m.hit.first > 0 AND {allow}), m -> named_struct('start', m.start + m.hit.first - {WINDOW}, 'rank', m.k + 3, 'stop', m.start + m.hit.last))"
    # a span is held by a pattern span if the furthest end of those that begin no later lies no earlier than its own
    both = f"array_sort(concat({base}, es))"
    reach = _prefix("transform(bs, x -> if(x.rank < 3, x.stop, -1))", "-1", "greatest(a, x)")
    kept = _let("bs", both, _let("r", reach, "transform(filter(transform(bs, (x, i) -> named_struct('m', x, 'r', r[i])), y -> y.m.rank >= 3 AND y.r < y.m.stop), y -> y.m)"))
    return _let("es", spans, f"if(size(es) = 0, es, {kept})")


def _joined(spans: str) -> str:
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return f"concat_ws(',', transform({spans}, m -> concat({kinds}[m.rank], ':', m.start, ':', m.stop)))"


def find_secrets(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The rows with two columns of sorted spans (pattern spans, and all); returns their names, free in ``docs``."""
    text, base, every = (free_name(docs, x) for x in ("_whole", "_base", "_every"))
    found = docs.withColumn(text, text_or_empty(text_col))
    kinds = [_spans(f"`{text}`", p, i, "length(m.g) >= 6" if k == "assign" else "true") for i, (k, p) in enumerate(PATTERNS.items())]
    found = found.withColumn(base, F.expr(f"array_sort(concat({', '.join(kinds)}))"))
    found = found.withColumn(every, F.expr(f"array_sort(concat(`{base}`, {_entropy_spans(f'`{text}`', f'`{base}`')}))"))
    return found.drop(text), base, every


def redacted(text: str, spans: str) -> Column:
    """The text with each maximal run of overlapping spans replaced by the placeholder."""
    # the run before place i ends at r[i - 1]; parts are read from stretches of the text, so that no part counts from its start
    part = lambda a, b: f"if({a} div {STRETCH} = ({b} - 1) div {STRETCH}, substring(ts[{a} div {STRETCH}], {a} % {STRETCH} + 1, {b} - {a}), substring({text}, {a} + 1, {b} - {a}))"
    begins = "filter(sequence(0, size(ms) - 1), i -> i = 0 OR ms[i].start >= r[i - 1])"
    before = f"transform({begins}, i -> {_let('p', 'if(i = 0, 0, r[i - 1])', part('p', 'ms[i].start'))})"
    body = f"concat(array_join({before}, '{PLACEHOLDER}'), '{PLACEHOLDER}', substring({text}, r[size(ms) - 1] + 1))"
    stretches = f"transform(sequence(0, length({text}) div {STRETCH}), k -> substring({text}, k * {STRETCH} + 1, {STRETCH}))"
    return F.expr(_let("ms", spans, _let("r", _prefix("transform(ms, x -> x.stop)", "0", "greatest(a, x)"), _let("ts", stretches, body))))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with secrets in ``text`` replaced (a null text stays null)."""
    found, base, every = find_secrets(docs)
    return found.withColumn("text", F.when(F.size(every) > 0, redacted("`text`", f"`{every}`")).otherwise(F.col("text"))).select(*docs.columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base, every = find_secrets(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"CAST(size(filter({base}, m -> m.rank = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"), F.expr(_joined(every)).alias("spans"))


def _duck(pattern: str) -> str:
    """The pattern for DuckDB, whose matcher never goes back and has no possessive quantifiers."""
    return "'" + re.sub(r"([*+?}])\+", r"\1", pattern).replace("'", "''") + "'"


def _duck_spans(rank: int, pattern: str) -> str:
    group = 2 if rank == 0 else 0
    return f"""SELECT r, {rank} AS rank, unnest(range(1, len(regexp_extract_all(t, {_duck(pattern)})) + 1)) AS k, string_split_regex(t, {_duck(pattern)}) AS p,
      regexp_extract_all(t, {_duck(pattern)}) AS s, regexp_extract_all(t, {_duck(pattern)}, {group}) AS g FROM d"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_duck_spans(i, p) for i, p in enumerate([*PATTERNS.values(), CANDIDATE]))}),
l AS (SELECT r, rank, s[k] AS s, g[k] AS g, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(s[1:k - 1], lambda x: length(x))), 0))::INT AS start FROM m),
base AS (SELECT r, rank, start, start + length(s) AS stop FROM l WHERE rank < 3 AND (rank > 0 OR length(g) >= 6)),
w AS (SELECT r, s, start, string_split_regex('/' || s || '/', {_duck(SAMPLE)}) AS ps, regexp_extract_all('/' || s || '/', {_duck(SAMPLE)}) AS xs FROM l WHERE rank = 3),
y AS (SELECT r, s, start, ps, unnest(range(1, len(ps) + 1)) AS k, xs FROM w),
z AS (SELECT r, s, start, ps[k] AS x, (coalesce(list_sum(list_transform(ps[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(xs[1:k - 1], lambda x: length(x))), 0))::INT AS b FROM y),
v AS (SELECT r, start + greatest(b - 1, 0) AS start, substr(s, greatest(b - 1, 0) + 1, least(b - 1 + length(x), length(s)) - greatest(b - 1, 0)) AS s FROM z),
c AS (SELECT r, s, start, CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN {k}" if p else f"ELSE {k}" for k, (p, _) in enumerate(CLASSES.values()))} END AS k FROM v WHERE length(s) >= {WINDOW}),
h AS (SELECT *, list_filter(range({WINDOW}, length(s) + 1), lambda i: list_entropy(string_split(substr(s, i - {WINDOW - 1}, {WINDOW}), '')) >= ({[t for _, t in CLASSES.values()]})[k + 1]) AS hits FROM c),
p AS (SELECT r, k, start, hits, substr(s, hits[1] - {WINDOW - 1}, hits[-1] - hits[1] + {WINDOW}) AS part FROM h WHERE len(hits) > 0),
e AS (SELECT r, k + 3 AS rank, start + hits[1] - {WINDOW} AS start, start + hits[-1] AS stop FROM p WHERE {" AND ".join(f"NOT regexp_matches(part, {_duck(p)})" for p in ALLOW)}),
x AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = e.r AND b.start <= e.start AND e.stop <= b.stop)),
every AS (SELECT *, ({list(KINDS)})[rank + 1] || ':' || start || ':' || stop AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM x)),
agg AS (SELECT r, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (r)
"""
