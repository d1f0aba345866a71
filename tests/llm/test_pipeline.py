import re
from pathlib import Path

import corpus_pipeline
from quern.llm.common import _is_stars, connected_components, materialize
from tests.llm.test_ngram_join import shingles
from tests.llm.test_pii import base


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r for r in docs.collect()]
        docs = materialize(spark, stage(spark, docs, sf), name)
        rows[name] = (before, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = rows["quality_classifier"]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    before, after = rows["ngram_jaccard_join"]
    sets = {r.doc_id: shingles(r.text, 5) for r in before}
    left = [r.doc_id for r in after]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert not any(near(sets[a], sets[b]) for i, a in enumerate(left) for b in left[:i] if sets[a] and sets[b])
    for r in before:
        if r.doc_id not in set(left):
            assert any(o.doc_id != r.doc_id and near(sets[r.doc_id], sets[o.doc_id]) for o in before)
    before, after = rows["pii"]
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)
    assert not any(k in (0, 1) for r in after for _, k, _ in base(r.text))
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if not base(texts[r.doc_id]) and "[TERM]" not in r.text)
    before, after = rows["source_mixing"]
    words = lambda rs: sum(len(re.findall(r"\S+", r.text)) for r in rs)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and abs(words(after) / words(before) - 1.5) < 0.15
    assert all(r.n_tokens == len(r.ids) for r in rows["sentencepiece"][1])


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (202, 201), (300, 300)] + [(500, 501 + i) for i in range(300)]
    got = {r.id: r.component for r in connected_components(spark, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(41), 100]) and got[202] == got[201] == got[200] == 200 and 300 not in got
    assert all(got[501 + i] == 500 for i in range(300))


def test_stars(spark):
    def stars(*edges):
        return _is_stars(spark.createDataFrame(edges, "v long, m long"))

    assert stars((2, 1), (3, 1), (5, 4)) and not stars((3, 1), (3, 2)) and not stars((3, 2), (2, 1))


def test_written_tables_trim_the_driver(spark):
    """What the JVM has freed outside its heap goes back to the system when a table has been written."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    table = spark.range(3).repartition(1)
    materialize(spark, table, "first")
    before = resident()
    held = [jvm.java.util.zip.Deflater() for _ in range(1500)]  # native memory, in pieces too small for a mapping each
    for x in held[:-1]:
        x.end()
    kept = resident() - before
    assert materialize(spark, table, "second").count() == 3
    held[-1].end()
    assert kept > 100 and resident() - before < kept / 2
