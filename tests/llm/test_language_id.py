import numpy as np
import pyarrow as pa
from batchloom.llm.common import table
from batchloom.llm.language_id import BUCKETS, TextModel, identify, train_text, trigrams

SF = "/root/testdata/sf0.01"


def test_text_model_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = train_text(docs.filter("doc_id % 3 > 0"))
    rest = docs.filter("doc_id % 3 = 0 AND length(text) > 200").select("text", "lang").toPandas()
    best = model.scores(pa.array(rest["text"])).argmax(axis=1)
    assert (np.array(model.languages)[best] == rest["lang"]).mean() > 0.97


def test_pages(spark):
    model = train_text(table(spark, SF, "documents"))
    pages = table(spark, SF, "pages")
    got = identify(pages, model).toPandas()
    assert len(got) == pages.count() and got.page_id.is_unique and got.probability.between(0.25, 1).all()
    assert (got.lang == got.declared).mean() > 0.9


def tiny():
    logs = np.full((BUCKETS, 2), 1e-9)
    for k, words in enumerate(("the and of with that", "der die und nicht das")):
        for b in trigrams(pa.array([words]))[0]:
            logs[b, k] += 1
    return TextModel(["de", "en"], np.log(logs / logs.sum(axis=0))[:, ::-1].astype(np.float32))


def test_fusion_of_evidence(spark):
    rows = [(i, f"https://h.example.de/{i}", "<html lang='de'><p>der die und nicht das</p>") for i in range(30)]
    rows += [(100, "https://h.example.de/x", "<html><p>12 34</p>"), (101, "http://u@new.example.de:80/y", "<html>"), (102, "https://h.example.de/z", "<html lang=en><script>der die</script>the and of with that")]
    rows += [(103, None, None), (104, "", ""), (105, "no address", "<HTML LANG=\"xx-YY\">"), (None, "https://h.example.de/", "<p>und"), (104, "", "")]
    got = identify(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS lang", "2 AS host"), tiny()).toPandas()
    assert len(got) == len(rows)
    at = got.drop_duplicates("page_id").set_index("page_id")
    assert at.loc[100, "lang"] == "de" and at.loc[101, "lang"] == "de" and at.loc[102, "lang"] == "en"
    assert at.loc[100, "probability"] > at.loc[101, "probability"] > 0.5  # a known host says more than its suffix
    assert at.loc[101, "host"] == "new.example.de" and at.loc[105, "declared"] == "xx"
    assert identify(spark.createDataFrame([], "page_id long, url string, html string"), tiny()).count() == 0
    none = train_text(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.languages == [] and identify(spark.createDataFrame(rows, "page_id long, url string, html string"), none).filter("lang IS NULL").count() == len(rows)


def posterior_by_hand(page, scores, pages, languages):
    """The fused posterior of one page from all pages' own evidence."""
    def own(i):
        declared = pages[i][3]
        return [s + (0.0 if declared not in languages else np.log(0.9 if x == declared else 0.1 / (len(languages) - 1))) for s, x in zip(scores[i], languages, strict=True)]

    def normal(logs):
        w = np.exp(np.array(logs) - max(logs))
        return w / w.sum()

    soft = [normal(own(i)) for i in range(len(pages))]
    n = len(languages)
    others = lambda k: sum((soft[j] for j in range(len(pages)) if j != page and (k is None or pages[j][k] == pages[page][k])), np.zeros(n))
    p0 = (others(None) + np.ones(n)) / (others(None).sum() + n)
    host, suffix = pages[page][1], pages[page][2]
    p1 = (others(2) + 20 * p0) / (others(2).sum() + 20) if suffix else p0
    p2 = (others(1) + 5 * p1) / (others(1).sum() + 5) if host else p1
    return normal([a + np.log(b) for a, b in zip(own(page), p2, strict=True)])


def test_posterior_equals_brute_force(spark):
    model = tiny()
    words = ["the and of", "der die und", "with that", "nicht das", "12", ""]
    rows = []
    for i in range(300):
        host = ("", "hot.de", "b.com", f"h{i}.fr")[min(i % 5, 3)]
        declared = ("", " lang='de'", " lang=en", " lang=fr")[i % 4]
        rows.append((i, f"https://{host}/{i}" if host else None, f"<html{declared}><p>{words[i % 6]} {words[(i // 7) % 6]}</p>"))
    got = {r.page_id: r for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    pages = [(i, r[1] and r[1].split("/")[2], r[1] and r[1].split("/")[2].split(".")[-1], {0: None, 1: "de", 2: "en", 3: "fr"}[i % 4]) for i, r in enumerate(rows)]
    scores = model.scores(pa.array([f"  {words[i % 6]} {words[(i // 7) % 6]} " for i in range(300)]))
    for i in range(0, 300, 7):
        want = posterior_by_hand(i, scores, pages, model.languages)
        assert abs(got[i].probability - want.max()) < 1e-6 and (abs(want[0] - want[1]) < 1e-9 or got[i].lang == model.languages[int(want.argmax())])


def test_entities_and_many_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i}") for i in range(100)], "doc_id long, text string, lang string")
    assert len(train_text(docs).languages) == 100
    pages = spark.createDataFrame([(1, None, "<p>caf&eacute; &#233;t&#xe9;</p>"), (2, None, "<p>café été</p>")], "page_id long, url string, html string")
    a, b = identify(pages, tiny()).orderBy("page_id").collect()
    assert a.probability == b.probability


def test_rare_languages_do_not_train(spark, monkeypatch):
    from batchloom.llm import language_id

    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 8)
    rows = [(i, "the quick brown fox " * 3, ("en", "xx", "yy", "zz")[0 if i < 90 else 1 + i % 3]) for i in range(100)] + [(200 + i, "le vif renard brun " * 4000, "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train_text(docs).languages == ["en", "fr"]
    assert language_id.train_text(docs.filter("false")).languages == []
