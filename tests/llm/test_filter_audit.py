import re
from itertools import permutations

import pytest
from batchloom.llm.filter_audit import audit_filters, flagged, op11_filter_interactions, subset_survivors
from batchloom.llm.queries import ORACLES, QUERIES
from tests.helpers import same_as_oracle

DOCS = "doc_id long, text string, lang string, A int, part string, step int"
LABELS = "doc_id long, quality int, toxic int, part string"
NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, i, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return out + "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, *_ in rows)


def brute(rows, labels):
    """Every order applied to every document, filter after filter."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    docs = [(lang or "", i, fails(text or "", i, rows)) for i, text, lang, *_ in rows]
    out, removed_by = [], {}
    for part in {p for p, _, _ in docs}:
        for order in permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[2]]
                redundant = sum(f in d[2] for d in gone)
                left = [d for d in left if f not in d[2]]
                gone += here
                unique = sum(d[2] == f for d in docs if d[0] == part)
                removed_by[part, f] = removed_by.get((part, f), 0) + len(here)
                out.append([part, "".join(order), step, len(left), len(here), redundant, unique, sum(d[1] in good for d in here), sum(d[1] in toxic for d in here), f])
    return sorted((*r[:-1], removed_by[r[0], r[-1]]) for r in out)


def words(n, k, more=""):
    return " ".join(f"w{j % k}" for j in range(n)) + more


ROWS = [
    (1, words(250, 250), "en"), (2, words(250, 250), "en"), (3, words(250, 250), "de"), (3, words(250, 250), "de"), (4, words(250, 124), "en"), (5, words(250, 125), "en"), (6, words(199, 199), "en"),
    (7, words(200, 200, " #"), "en"), (8, words(220, 220, " " + "Q" * 60), "de"), (9, None, None), (10, "", "en"), (11, "", ""), (None, "", "en"), (None, words(250, 250), "de"), (12, words(3, 1), None),
    (13, "É" * 100 + " ÀB C", "fr"), (14, "Q" * 3 + "x" * 97, "fr"), (15, "Q" * 4 + "x" * 96, "fr"), (16, " \t\n\x0b\x0c\r", "fr"), (17, "\xa0　 a", "fr"), (18, words(60_000, 29_000, "|"), "en"), (-1, words(60_000, 29_000, "|"), "en"),
]
LABELLED = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (4, None, 1), (6, 1, 1), (12, 1, 1), (15, 0, 1), (18, 1, 0), (999, 1, 1), (None, 1, 1)]


def test_equal_to_brute_force(spark):
    docs = spark.createDataFrame([(*r, 7, "x", 9) for r in ROWS], DOCS)
    labels = spark.createDataFrame([(*r, "y") for r in LABELLED], LABELS)
    got = audit_filters(docs, labels)
    assert [f.name for f in got.schema] == list(NAMES)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int", *["bigint"] * 7]
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, LABELLED)
    flags = {(r.doc_id, r.part): "".join(f for f in "ABCDE" if r[f]) for r in flagged(docs).collect()}
    assert flags == {(i, lang or ""): fails(text or "", i, ROWS) for i, text, lang in ROWS}
    assert audit_filters(docs.repartition(7), labels.repartition(3)).exceptAll(got).isEmpty()


@pytest.mark.parametrize("which", ["documents", "labels"])
def test_empty_tables(spark, which):
    docs, labels = spark.createDataFrame([(*r, 7, "x", 9) for r in ROWS[:6]], DOCS), spark.createDataFrame([(*r, "y") for r in LABELLED], LABELS)
    if which == "documents":
        assert audit_filters(docs.filter("false"), labels).count() == 0
    else:
        assert sorted(tuple(r) for r in audit_filters(docs, labels.filter("false")).collect()) == brute(ROWS[:6], [])


def test_subsets_of_other_filters(spark):
    rows = [("p", True, False, 5, 1), ("p", False, False, 2, 0), ("q", True, True, 4, 4)]
    counts = spark.createDataFrame(rows, "part string, x boolean, y boolean, docs long, good long")
    got = {(r.part, r.subset): (r.docs, r.good) for r in subset_survivors(counts, "xy", ("docs", "good")).collect()}
    assert got == {("p", 0): (7, 1), ("p", 1): (2, 0), ("p", 2): (7, 1), ("p", 3): (2, 0), ("q", 0): (4, 4), ("q", 1): (0, 0), ("q", 2): (0, 0), ("q", 3): (0, 0)}


def test_equal_to_sql(spark):
    same_as_oracle(spark, QUERIES["op11_filter_interactions"], ORACLES["op11_filter_interactions"])


def test_plan_shuffles_no_text(spark):
    plan = op11_filter_interactions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "text#" not in plan
