import zlib

from quern.llm import language_id, quality
from quern.llm.queries import op5_language_id, op6_quality


def test_language_held_out(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(spark, docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "中", None), (None, "the dog", "x"), (5, "der hund " * 200_000, "x"), (5, "der hund", "x")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.accepted) for r in language_id.identify(spark, odd, model).collect()]
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert got[3][1] in ("en", "de") and got[4][1] == "en" and got[5][1] == got[6][1] == "de"
    nothing = language_id.learn(spark, docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(spark, docs, nothing).collect()} == {"und"}
    assert language_id.identify(spark, docs.limit(0), model).count() == 0


def test_block_edges_dont_matter():
    import numpy as np

    text = "abc déf " * 30
    whole = np.sort(np.concatenate(list(language_id.subwords(text))))
    old = language_id.BLOCK_CHARS
    try:
        language_id.BLOCK_CHARS = 37
        assert np.array_equal(whole, np.sort(np.concatenate(list(language_id.subwords(text)))))
    finally:
        language_id.BLOCK_CHARS = old


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op6_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(y == p for _, y, p in held) > 0.93 * len(held)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "Ein guter Satz steht hier.", 9), (4, "!!! $$$ ||| " * 50_000, 9), (4, "x", 9), (None, "y", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (4, 0), (None, 0), (99, 1)], "doc_id long, quality int")
    got = quality.score_quality(spark, docs, docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    alone = quality.score_quality(spark, docs, docs, labels.limit(0)).collect()
    assert {r.predicted for r in alone} == {1}  # nothing learned, nothing rejected
    assert quality.keep_good(spark, docs, labels.limit(0)).columns == docs.columns
    assert quality.score_quality(spark, docs.limit(0), docs, labels).count() == 0


def test_keep_good_keeps_clashing_columns(spark, sf):
    from quern.llm.quality import keep_good

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as __features", "doc_id as features", "doc_id as score")
    got = keep_good(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert got.columns == docs.columns and all(r.doc_id == r["__features"] == r.features == r.score for r in got.collect())
