import random
import re

import pytest

from quern.llm.ngram_join import Bands, _keys, _sketch, jaccard_components, keep_one
from quern.llm.shingles import BLOCK_BYTES, shingle_sets, word_hashes


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, p, q):
    """(n, component) by comparing all pairs; ids are unique."""
    sets = [shingles(t, k) for _, t in rows]
    comp = {i: i for i, _ in rows}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and q * shared >= p * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(rows[a][0]), root(rows[b][0])
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 20, 60, 200]))]
        for _ in range(rng.choice([1, 4, 9])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own[: -rng.randint(1, 3)] or own
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(15)]
    return rows


@pytest.mark.parametrize(("k", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_against_all_pairs(spark, k, p, q):
    rows = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), k, p, q).collect()}
    assert got == brute(rows, k, p, q)


@pytest.mark.parametrize(("p", "q"), [(9, 10), (4, 5)])
def test_pigeonhole_and_bound(p, q):
    """Every linked pair has a common key, and its sketches lie within the bound."""
    import numpy as np

    rng, bands, shapes = np.random.default_rng(0), Bands(p, q), {}
    for n in [*range(bands.least, 60), 100, 333, 1000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = bands.differ(len(a), len(a))
            cut = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, most // 2 + 1))).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if q * shared < p * (len(a) + len(b) - shared) or len(a) == len(b) == shared:
                continue
            assert set(_keys(a, bands, shapes)) & set(_keys(b, bands, shapes))
            j = max(bands.of(max(len(a), len(b)))[0], bands.of(min(len(a), len(b)))[0])
            x, y = (int.from_bytes(_sketch(s, bands.shape(j)[2])) for s in (a, b))
            assert (x ^ y).bit_count() <= bands.differ(len(a), len(b))


def test_edges(spark):
    long = "aa " * (BLOCK_BYTES // 2) + "end"
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (9, "one TWO"), (10, "one"), (11, long), (12, long), (None, "one two"), (None, "alone here"), (13, "é É")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(spark, df, 3, 9, 10).collect() if r.doc_id is not None)
    assert [(a, c) for a, _, c in got] == [(5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (9, 8), (10, 10), (11, 11), (12, 11), (13, 13)]
    assert [b for a, b, _ in got if a in (5, 6, 7)] == [0, 0, 0]
    kept = keep_one(spark, df, 3, 9, 10).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [5, 6, 7, 8, 10, 11, 13]
    assert [r.text for r in kept if r.doc_id is None] == ["alone here"]
    assert jaccard_components(spark, df.limit(0), 3, 9, 10).count() == 0


def test_word_hashes_in_blocks():
    text = ("word%d " * 3000) % tuple(range(3000)) + "x" * (BLOCK_BYTES + 5) + " tail"
    many = text * 12
    assert word_hashes([many])[0].tolist() == [int(h) for _ in range(1) for h in word_hashes([w for w in many.split()]) for h in h]
    assert len(shingle_sets(["A b", "a B"], 3)[0]) == 1 and shingle_sets(["A b"], 3)[0].tolist() == shingle_sets(["a B"], 3)[0].tolist()


def test_shapes_of_long_texts():
    for p, q in ((9, 10), (4, 5)):
        bands = Bands(p, q)
        for j in range(60):
            d, m, length = bands.shape(j)
            most = bands.start(j + 1) - 1
            assert d == bands.differ(most, most) < m <= 2 * d + 10 and length >= 2 * most


def test_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    near = list(words)
    for _ in range(300):
        near[rng.randrange(len(near))] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, " ".join(near[:-2]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 4, 5) and got[2][1] == got[4][1] == 1


def brute_rows(rows, k, p, q):
    """Component of each row, by its text alone: the least id among linked rows, or its own."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and q * shared >= p * (len(sets[a]) + len(sets[b]) - shared):
                up[root(a)] = root(b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(doc_id, ids.get(root(i), doc_id))
    return [ids.get(root(i), doc_id) if sets[i] else doc_id for i, (doc_id, _) in enumerate(rows)]


def _variants(seed, groups):
    """(id, text A), (id, text B), (_, near A), (_, near B), with the id repeated and some ids null."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        a, b = ([f"v{rng.randrange(3000)}" for _ in range(80)] for _ in range(2))
        near = [[*x[:40], "other", *x[41:]] for x in (a, b)]
        rows += [(10 * g + 5, a), (10 * g + 5, b), (None if g % 3 == 0 else 10 * g + 6, near[0]), (None if g % 3 == 1 else 10 * g + 7, near[1])]
        if g % 4 == 0:  # a row without id is the bridge of two that don't link directly
            far = [*near[0][:20], "more", *near[0][21:]]
            rows += [(10 * g + 8, far)]
    return [(i, " ".join(t)) for i, t in rows]


def test_repeated_and_missing_ids(spark):
    rows = _variants(3, 20)
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, t1 int")
    want = sorted((i if i is not None else -1, -1 if c is None else c) for (i, _), c in zip(rows, brute_rows(rows, 5, 4, 5), strict=True))
    got = sorted((r.doc_id if r.doc_id is not None else -1, -1 if r.component_id is None else r.component_id) for r in jaccard_components(spark, df).collect())
    assert got == want
    kept = keep_one(spark, df)
    assert kept.columns == df.columns
    left = [shingles(r.text, 5) for r in kept.collect()]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    assert len(left) == 40  # two texts a group, each with its near copies


def test_large_buckets_are_split(spark, monkeypatch):
    """Common passages give buckets of many classes; small tiles and second keys lose no link."""
    from quern.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "HOT", 6)
    monkeypatch.setattr(ngram_join, "TEXTS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(120):
        own = passage + [f"x{rng.randrange(10_000)}" for _ in range(12)]
        rows.append((2 * g, " ".join(own)))
        if g % 2:
            rows.append((2 * g + 1, " ".join([*own[:-1], "end"])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 4, 5)


def test_two_common_keys():
    """The split by second keys needs two keys in common for every linked pair."""
    import numpy as np

    rng, bands, shapes = np.random.default_rng(1), Bands(4, 5), {}
    for n in [*range(bands.least, 80), 200, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 5 * shared >= 4 * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                assert len(set(_keys(a, bands, shapes).tolist()) & set(_keys(b, bands, shapes).tolist())) >= 2


def test_sets_with_one_first_hash(spark):
    """Sets whose first hashes agree keep apart by the second."""
    from quern.llm import ngram_join

    classes, twins = ngram_join._ids(spark, spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 7, "c")], "c1 long, c2 long, t string"))
    ids = {r.t: r.id for r in classes.collect()}
    assert len(set(ids.values())) == 3 and ids["c"] == 2 and [sorted(r.ids) for r in twins.collect()] == [sorted([ids["a"], ids["b"]])]
    keys = ", ".join(f"keys{i} array<long>" for i in range(ngram_join.SLICES))
    scanned = spark.createDataFrame([(1, *[[9]] * ngram_join.SLICES), (2, *[[9]] * ngram_join.SLICES)], f"c1 long, {keys}")
    rows = ngram_join._buckets(spark, scanned, twins).distinct().collect()
    assert {r["class"] for r in rows} == set(ids.values()) and {r.least for r in rows} == {min(ids["a"], ids["b"])}
    assert ngram_join._ids(spark, spark.createDataFrame([(1, 5)], "c1 long, c2 long"))[1] is None
