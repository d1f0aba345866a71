"""Embedding near-dedup by collision-counting projections.

Vectors of a label are normalised and projected on PROJECTIONS random lines.
Two vectors collide on a line if the second lies in the window of half-width w
that is centred at the first. A pair whose count of collisions reaches a
threshold is verified by its cosine. w and the threshold follow from the wanted
recall: for a pair just at the least cosine, a projected difference is nearly
normal with deviation distance / sqrt(dimension), w is two deviations, and the
threshold is the binomial quantile that misses MISS of such pairs.

A window on one line holds a fixed share of all vectors, so sorting by single
lines would meet a share of all pairs. Which pairs are counted is therefore
limited first: groups of `depth` sorted lines are cut into cells, a pair is
counted where both lie in one cell of any group, and there are as many groups
as the same recall needs. depth grows with the logarithm of the number of
vectors, so that cells of scattered vectors keep a bounded size. Larger cells
(many near copies) are split into tiles of TILE x TILE, each of which sends on
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import connected_components, materialize

PROJECTIONS, MISS = 32, 0.002
#: Vectors on each side of a tile, and in a cell of scattered vectors.
TILE = 256
#: Width of a cell, in deviations of a projected difference at the least cosine.
CELL = 8.0


def _lines(dim: int, n: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, dim]).normal(size=(dim, n))
    return g / np.linalg.norm(g, axis=0)


def plan(n: int, dim: int, cosine: float) -> tuple[int, int, float, int]:
    """(depth, groups, w, threshold) for n vectors of a label."""
    deviation = math.sqrt(max(2 - 2 * cosine, 1e-12) / max(dim, 1))
    stays = 1 - math.sqrt(2 / math.pi) / CELL  # a pair at the least cosine, on one line
    apart = CELL * deviation * math.sqrt(max(dim, 1)) / (2 * math.sqrt(math.pi))  # scattered vectors, likewise
    depth = max(0, math.ceil(math.log(max(n / TILE, 1)) / -math.log(min(max(apart, 0.05), 0.9))))
    groups = 1 if depth == 0 else math.ceil(math.log(MISS) / math.log(1 - stays**depth))
    p = math.erf(2 / math.sqrt(2))
    missed, threshold = 0.0, 0
    while threshold <= PROJECTIONS and (missed := missed + math.comb(PROJECTIONS, threshold) * p**threshold * (1 - p) ** (PROJECTIONS - threshold)) <= MISS:
        threshold += 1
    return depth, groups, 2 * deviation, threshold


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _cells(n: int, cosine: float):
    """Adds a cell key for each group of lines."""

    def run(batches):
        for pdf in batches:
            keys: list = [None] * len(pdf)
            for dim, rows in pdf.groupby(pdf["embedding"].map(len)).indices.items():
                depth, groups, _, _ = plan(n, dim, cosine)
                x = _unit(np.stack(pdf["embedding"].iloc[rows].to_list()).astype(np.float64))
                out = np.zeros((len(rows), groups), np.int64)
                if depth:
                    width = CELL * math.sqrt(max(2 - 2 * cosine, 1e-12) / dim)
                    shift = np.random.default_rng([2, dim]).random(depth * groups)
                    at = np.floor(x @ _lines(dim, depth * groups, 1) / width + shift).astype(np.int64)
                    for g in range(groups):
                        for c in at[:, g * depth : (g + 1) * depth].T:
                            out[:, g] = out[:, g] * 1_000_003 + c
                for r, k in zip(rows, out.tolist(), strict=True):
                    keys[r] = k
            yield pdf.assign(cells=keys)[["id", "n", "label", "embedding", "cells"]]

    return run


def _tile(n: int, cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj, group = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0]), int(pdf["group"].iloc[0])
        pdf = pdf.sort_values("id")
        left = pdf[pdf["chunk"] == ti]
        right = left if ti == tj else pdf[pdf["chunk"] == tj]
        none = pd.DataFrame({"id": [], "links": [], "other": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        raw = [np.stack(side["embedding"].to_list()).astype(np.float64) for side in (left, right)]
        norms = [np.linalg.norm(r, axis=1) for r in raw]
        _, _, w, threshold = plan(n, raw[0].shape[1], cosine)
        lines = _lines(raw[0].shape[1], PROJECTIONS, 0)
        a, b = (r / m[:, None] @ lines for r, m in zip(raw, norms, strict=True))
        # sort by the first line; the window on it, without limit of collisions, comes cheap
        count = np.zeros((len(left), len(right)), np.int8)
        for j in range(PROJECTIONS):
            order = np.argsort(b[:, j], kind="stable")
            lo = np.searchsorted(b[order, j], a[:, j] - w)
            hi = np.searchsorted(b[order, j], a[:, j] + w, side="right")
            inside = (np.arange(len(right)) >= lo[:, None]) & (np.arange(len(right)) < hi[:, None])
            count[:, order] += inside
        may = count >= threshold
        if ti == tj:
            may &= np.arange(len(left))[:, None] < np.arange(len(right))[None]
        cells = [np.stack(side["cells"].to_list()) for side in (left, right)]
        for g in range(group):  # an earlier group has this pair
            may &= cells[0][:, g][:, None] != cells[1][:, g][None]
        i, j = np.nonzero(may)
        cos = np.einsum("ij,ij->i", raw[0][i], raw[1][j]) / (norms[0][i] * norms[1][j])
        i, j = i[cos >= cosine], j[cos >= cosine]
        if not len(i):
            return none
        ids = [side["id"].to_numpy() for side in (left, right)]
        sizes = [side["n"].to_numpy() for side in (left, right)]
        both = np.concatenate([ids[0][i], ids[1][j]])
        add = np.concatenate([sizes[1][j], sizes[0][i]])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c] = up.get(up[c], up[c])
            return c

        for x, y in zip(ids[0][i].tolist(), ids[1][j].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        found, where = np.unique(both, return_inverse=True)
        links = np.bincount(where, weights=add).astype(np.int64)
        return pd.DataFrame({"id": found, "links": links, "other": [root(x) for x in found.tolist()]})

    return run


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Rows link if their labels are equal and not null, their vectors have the
    same length, and the cosine in double precision is found to be at least
    `cosine`. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows without id. Equal vectors of a
    label are one class, whatever their number; n_links counts its other rows
    too, repeated ids among them. Nearly equal vectors are compared with each
    other, as n_links asks for their number. An empty table gives an empty
    result.
    """
    read = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").alias("label"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = read.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    classes = materialize(spark, ok.groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")), "classes")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    kind = classes.schema["embedding"].dataType.simpleString()
    label_kind = classes.schema["label"].dataType.simpleString()
    celled = classes.mapInPandas(_cells(most, cosine), f"id bigint, n bigint, label {label_kind}, embedding {kind}, cells array<bigint>")
    celled = materialize(spark, celled, "cells")

    keys = celled.select("id", "label", F.size("embedding").alias("dim"), F.posexplode("cells").alias("group", "cell"))
    block = ["label", "dim", "group", "cell"]
    counts = keys.groupBy(*block).agg(F.count("*").alias("size")).filter("size > 1").withColumn("chunks", F.ceil(F.col("size") / TILE).cast("int"))
    chunk = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int")
    members = keys.join(counts, block).select(*block, "id", "chunks", chunk.alias("chunk"))
    sides = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = sides.select(*block, "id", "chunk", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"))
    rows = tiles.join(celled.select("id", "n", "embedding", "cells"), "id")
    found = rows.groupBy(*block, "ti", "tj").applyInPandas(_tile(most, cosine), "id bigint, links bigint, other bigint")
    found = materialize(spark, found, "tiles")

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(spark, found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    by_class = classes.join(links, "id", "left").join(components, "id", "left")
    by_class = by_class.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    by_class = materialize(spark, by_class, "by_class")
    out = read.withColumn("joins", F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).alias("r").join(
        by_class.alias("c"), F.col("r.joins") & (F.col("r.label") == F.col("c.label")) & (F.col("r.embedding") == F.col("c.embedding")), "left"
    )
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
