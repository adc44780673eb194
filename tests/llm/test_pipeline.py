import corpus_pipeline
from batchloom.llm.common import table
from batchloom.llm.mixing import mix_documents, mixed_copies
from batchloom.llm.minhash import one_of_each_group
from tests.llm.test_minhash import brute as groups
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    rows = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == COLUMNS
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    left = {r.doc_id: r.text for r in kept.collect()}
    assert all(i in left for i in rows if labels.get(i) == 0) and all(left[i] == rows[i].text for i in left)
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    want = {i for i, (_, c, k) in groups(list(left.items()), 80).items() if k}
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == want
    clean = corpus_pipeline.secrets(spark, single, SF)
    assert clean.columns == COLUMNS
    for r in clean.collect():
        if not spans(left[r.doc_id])[4]:
            assert r.text == left[r.doc_id]
        else:
            assert "[SECRET]" in r.text and spans(r.text)[4] == ""
        assert r.n_chars == len(r.text)
    mix = corpus_pipeline.mixing(spark, clean, SF)
    times = {r.doc_id: r.times for r in mix_documents(clean).collect()}
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == COLUMNS and counts == {i: n for i, n in times.items() if n}
    last = corpus_pipeline.pieces(spark, mix, SF).collect()
    assert len(last) == sum(counts.values()) and all(r.lossless for r in last)
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def test_edges(spark):
    rows = [(1, "a b c d e f", None, 0), (1, "a b c d e f", None, 0), (2, "A b c d e  f", "s", 1), (None, None, "s", 2), (3, "", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _src int")
    got = sorted(one_of_each_group(df).collect(), key=repr)
    assert [tuple(r) for r in got] == sorted([rows[0], rows[3], rows[4]], key=repr)
    assert mixed_copies(df).columns == df.columns and mixed_copies(df.filter("false")).count() == 0


def test_one_of_each_group_from_80_percent(spark):
    words = [f"w{i}" for i in range(100)]
    copy = list(words)
    copy[30] = copy[70] = "x"  # 86 of 106 shingles in common
    other = list(words)
    for i in (15, 45, 75):
        other[i] = "y"  # 81 of 111
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, copy, other))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets = [{tuple(w[k : k + 5]) for k in range(96)} for w in (words, copy, other)]
    near = {(i, j) for i in range(3) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert near == {(1, 0)}
    assert {r.doc_id for r in one_of_each_group(df, 80).collect()} == {0, 2}
    assert one_of_each_group(df).count() == 3


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", "en", None, 3), (2, "x" * 40_000 + " token=abcdef12", "de", "t", 40_015), (2, "x y", "de", "t", 3), (2, "x y", "de", "t", 3)]
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        assert all(r.lossless for r in got) and (len(got) > 0) == bool(rows)


def test_stages_keep_very_long_texts_and_do_not_depend_on_partitions(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i} of a very long document" for i in range(40_000))
    rows = [(i, f"plain text number {i} " * (1 + i % 4), "en", f"s{i % 3}", 30) for i in range(60)] + [(100, long, "en", "s0", len(long)), (101, long + " token=abcdef1234567", "en", "s1", len(long) + 21)]
    spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    results = []
    for parts in (1, 4, 7):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, str(tmp_path)).repartition(parts)
        results.append(sorted((r.doc_id, r.copy, r.n_pieces, tuple(r.ids), r.lossless) for r in docs.collect()))
    assert results[0] == results[1] == results[2] and all(r[-1] for r in results[0])
    assert 100 in {r[0] for r in results[0]} and 101 not in {r[0] for r in results[0]}
