import math

import numpy as np
from pyspark.sql import functions as F

from quern.llm.embedding_dedup import near_duplicates
from quern.llm.queries import OP10_SQL, op10_topk_search
from quern.llm.topk_search import search_block, top_k
from tests.oracle import check, connect

EMB = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(60):
            center = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((len(rows), [float(np.float32(x)) for x in center + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1])], label))
    big = rng.normal(size=16)
    rows += [(len(rows) + i, [float(np.float32(x)) for x in big + rng.normal(size=16) * 0.01], 1) for i in range(600)]  # one large group of near copies
    return rows


def brute(rows, cosine):
    n = len(rows)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (x @ x.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    comp = list(range(n))
    while True:
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == comp:
            return near.sum(1), comp
        comp = new


def test_near_duplicates_recall(spark):
    rows = vectors()
    links, comp = brute(rows, 0.98)
    got = {r.vec_id: r for r in near_duplicates(spark, spark.createDataFrame(rows, EMB)).collect()}
    found = sum(got[i].n_links for i in range(len(rows)))
    assert all(got[i].n_links <= links[i] for i in range(len(rows)))
    assert found >= 0.98 * links.sum() > 0
    assert np.mean([got[i].component_id == comp[i] for i in range(len(rows))]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicate_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [math.inf, 1.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [1.0, None], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], EMB + ", n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark, df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert got[None] == (0, None, False)
    assert near_duplicates(spark, df.limit(0)).count() == 0


def test_top_k_query(spark, sf):
    check(op10_topk_search(spark, sf), connect(sf), OP10_SQL)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (100, [0.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [-3.0, 2.0]), (None, [9.0, 9.0]), (8, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = {q: [(r.vec_id, r.score) for r in sorted(rows_, key=lambda r: r.rank)] for q, rows_ in _by_query(top_k(spark, df, F.col("vec_id") % 100 == 0, k=4)).items()}
    assert got[0] == [(8, 2**63 - 1), (1, 1024 * 1024 + 512 * 512), (2, 1024 * 1024 + 512 * 512), (2, 1024 * 1024 + 512 * 512)]
    assert got[100] == [(0, 0), (1, 0), (2, 0), (2, 0)]
    assert top_k(spark, df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def _by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_block_search_stops_only_when_safe():
    rng = np.random.default_rng(5)
    for dim, spread in ((2, 1), (8, 1), (8, 30), (64, 1)):
        x = np.floor(rng.normal(size=(500, dim)) * rng.choice([1, spread], size=(500, 1)) * 20)
        q, ids = np.floor(rng.normal(size=(40, dim)) * 20), rng.permutation(500)
        own = np.concatenate([ids[:20], np.full(20, -1)])
        got = {}
        for a, v, s in search_block(q, x, ids, own, 10):
            got.setdefault(a, []).append((-s, int(ids[v])))
        for a in range(40):
            want = sorted((-int(s), int(i)) for s, i in zip(x @ q[a], ids, strict=True) if i != own[a])[:10]
            assert sorted(got[a]) == want


def test_large_scores_are_integers():
    q, x = np.array([[2.0**53, 1.0]]), np.array([[1.0, 3.0], [1.0, 2.0]])
    assert [(int(v), s) for _, v, s in search_block(q, x, np.array([5, 6]), np.array([-1]), 2)] == [(0, 2**53 + 3), (1, 2**53 + 2)]
