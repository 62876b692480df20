"""Decontamination against a word-by-word model."""

from roadloom.llm import decontamination as d

LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Kurz und gut"), (3, ""), (4, None), (5, "w3, W4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15!"), (5, "kurz und"), (None, "écho écho")]
DOCS = [
    (1, "x " + LONG.upper() + " y"), (2, "ein kurz, und gut; gesagt"), (3, None), (4, ""), (5, "w1 w2 w3"),
    (6, "écho écho écho ÉCHO"), (6, "écho écho écho ÉCHO"), (None, "kurz und gut " * 300), (8, "filler " * 5000 + LONG),
    (9, "kurz"), (10, "und gut"),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in DOCS], "doc_id long, text string, hits string, row string, words string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_report_equals_brute_force(spark):
    docs, items = frames(spark)
    assert key(d.report(docs, items).collect()) == key(d.brute_force(DOCS, ITEMS))


def test_slices_do_not_change_the_result(spark):
    docs, items = frames(spark)
    plain, cut = (d.find_hits(docs, items, "text", ["doc_id"], n).select("doc_id", "hits.*").collect() for n in (500_000, 12))
    assert key(plain) == key(cut)


def test_removing_documents_keeps_columns_and_clean_rows(spark):
    docs, items = frames(spark)
    kept = d.remove_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8, 9, 10]


def test_removing_spans(spark):
    docs, items = frames(spark)
    cut = {r.doc_id: r.text for r in d.remove_spans(docs, items).collect()}
    assert cut[1] == "x  y" and cut[2] == "ein ; gesagt" and cut[3] is None and cut[5] == "w1 w2 w3" and cut[6] == " ÉCHO"


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert d.report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in d.report(docs, items.limit(0)).collect()} == {0}


def test_long_items_are_cut_and_scans_do_not_pile_up(spark):
    words = [f"v{i}" for i in range(4_000)]
    items = [(1, " ".join(words)), (2, LONG), (3, "Kurz, und; GUT"), (None, None), (4, "")]
    texts = [(1, " ".join(words[990:1030])), (2, " ".join(words[:12])), (3, " ".join(words[-13:]) + " x"), (4, " ".join(words[500:3500])), (5, LONG + " kurz und gut"), (6, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sizes = [sum(map(len, windows.words.values())) for windows, _ in d.benchmark_slices(benchmark, 3000)]
    assert len(sizes) > 3 and max(sizes) < 3000
    found = d.find_hits(docs, benchmark, "text", ["doc_id"], 3000)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.select("doc_id", "hits.*").collect()]
    assert sorted(got) == [(1, 40, 40, 1), (2, 12, 0, 0), (3, 14, 13, 1), (4, 3000, 3000, 1), (5, 33, 33, 2), (6, 0, 0, 0)]
