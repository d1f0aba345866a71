import re
from collections import defaultdict

from quern.llm.mixing import take_copies, taken_words


def targets(sizes, weights, share):
    """Shares by weight, stopped at twice the size, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, weight = total - sum(capped.values()), sum(w[s] for s in free)
        new = {s: 2 * sizes[s] for s in free if rest * w[s] / weight > 2 * sizes[s]} if free else {}
        if not new:
            return capped | {s: rest * w[s] / weight for s in free}
        capped |= new


def check(spark, docs, rows):
    got = taken_words(spark, docs, [3, 1, 2], 1.5).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    by_id = {i: (t, s) for i, t, s in rows}
    for _, t, s in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want, taken = targets(dict(sizes), [3, 1, 2], 1.5), defaultdict(int)
    for r in got:
        t, s = by_id[r.doc_id]
        assert r.size == size(t) and r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-9 * max(1, want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return got


def test_query_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    got = check(spark, docs, rows)
    again = taken_words(spark, docs.repartition(5), [3, 1, 2], 1.5).collect()
    assert sorted(got) == sorted(again)


def test_many_documents_fold_over_levels(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 50), "big" if i % 3 else f"s{i % 5}") for i in range(9000)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "one two three", "b"), (5, "é " * 100_000, "c"), (6, "only", "d")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    check(spark, docs.drop("target"), rows)
    same = spark.createDataFrame([(7, "a b c", "s")] * 5 + [(8, "d e", "s")], "doc_id long, text string, source string")
    got = [r.taken for r in taken_words(spark, same, [3, 1, 2], 1.5).collect() if r.doc_id == 7]
    assert len(got) == 5 and len(set(got)) == 1  # repeated rows are taken alike
    copies = take_copies(spark, docs, [3, 1, 2], 1.5)
    assert copies.columns == docs.columns and copies.count() <= 2 * len(rows)
    assert taken_words(spark, docs.limit(0), [3, 1, 2], 1.5).count() == 0


def test_near_target(spark):
    """Every source of 50 documents or more comes within 0.5 % of its target, or its smallest document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target, least = defaultdict(int), {}, {}
    for r in taken_words(spark, docs, [3, 1, 2], 1.5).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        least[s] = min(r.size, least.get(s, r.size))
    assert all(abs(taken[s] - target[s]) <= max(0.005 * target[s], least[s]) for s in target)


def test_expected_copies(spark):
    """Spreading the errors leaves expected copies as they were, but for the smallest documents, which take up the last; sums are near."""
    from pyspark.sql import functions as F

    from quern.llm.mixing import _settle_levels

    words, runs = [60, 40, 30, *[20] * 10, *[10] * 20, *[1] * 7], 1500
    docs = spark.createDataFrame([(i, w, i % 7 > 1) for i, w in enumerate(words)], "doc_id long, words long, held boolean").withColumn("p", F.lit(0.4))
    docs = docs.crossJoin(spark.range(runs).withColumnRenamed("id", "run")).withColumn("key", F.xxhash64("run", "doc_id"))
    item = F.struct((-F.col("words")).alias("order"), "key", "words", "doc_id", "p", "held")
    done = docs.groupBy("run").agg(F.array_sort(F.collect_list(item)).alias("items")).select("run", F.explode(_settle_levels(F.col("items"), 0)).alias("d"))
    rows = done.select("run", "d.doc_id", "d.p", "d.words").toPandas()
    assert len(rows) == runs * len(words) and rows.p.isin([0, 1]).all()
    large = rows[rows.words > 1]
    assert (abs(large.groupby("doc_id").p.mean() - 0.4) < 4.5 * (0.24 / runs) ** 0.5).all()
    sums = (rows.p * rows.words).groupby(rows.run).sum()
    assert (abs(sums - 0.4 * sum(words)) < 10).all()  # the smallest of those that the one-word texts cannot make up for


def test_clashing_names(spark):
    names = ["__id", "mix_id", "mix_source", "mix_size", "mix_copies", "mix_copy", "size", "copies"]
    docs = spark.createDataFrame([(i, "a b c", "s", *[i] * 8) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = take_copies(spark, docs, [3, 1], 1.5)
    assert got.columns == docs.columns and got.count() >= 6 and all(set(r[3:]) == {r.doc_id} for r in got.collect())
