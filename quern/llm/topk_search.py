"""Exact top-k search by inner product: aggregation without random access.

For every dimension the vectors of a block are sorted by their component. A
query reads each list from the end that suits the sign of its own component,
all lists to the same depth. At a depth, what is read of a vector gives a lower
and an upper bound of its score: unread components count as the list's last
value, or as the value at the depth. The query stops when no vector outside its
current top k, read or not, has an upper bound that reaches the k-th lower
bound; only those that do are resolved, by their exact scores.

Lists are read in steps, and a block of queries side by side, so that bounds
are matrix products. Blocks of vectors are independent tasks; their top k are
merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that a task searches: a 64th of all between these bounds, so that large tables aren't dealt to ever more blocks of one size.
LEAST_BLOCK, LARGEST_BLOCK, BLOCKS = 1024, 16384, 64
#: Queries that are sent to a block together, and bounds (queries by vectors) that are held side by side.
QUERY_BLOCK, SIDE_BY_SIDE = 4096, 1 << 18
#: Depths, as shares of a list, at which the bounds are compared.
DEPTHS = (0.25, 0.5, 0.7, 0.85, 0.95, 1.0)
#: Below this bound of a score, sums of products are exact in double precision.
EXACT = 2.0**52


def search_block(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, position in vectors, score) of each query's k best vectors but its own."""
    if queries.size and vectors.size and float(np.abs(queries).max()) * float(np.abs(vectors).max()) * vectors.shape[1] >= EXACT:
        whole = np.frompyfunc(int, 1, 1)  # products of Python floats would be rounded
        exact = whole(queries) @ whole(vectors).T
        out = []
        for q in range(len(queries)):
            best = sorted((-int(s), int(ids[v]), v) for v, s in enumerate(exact[q]) if ids[v] != own[q])[:k]
            out += [(q, v, max(min(-s, 2**63 - 1), -(2**63))) for s, _, v in best]
        return out
    x = vectors.astype(np.float64)
    n, dim = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, order, axis=0)
    out = []
    side = max(8, SIDE_BY_SIDE // n)
    for i in range(0, len(queries), side):
        q = queries[i : i + side].astype(np.float64)
        mine = ids[None] == own[i : i + side, None]
        going = np.arange(len(q))
        for share in DEPTHS:
            if not len(going):
                break
            depth = min(n, max(k + 1, int(np.ceil(share * n))))
            plus, minus = np.maximum(q[going], 0), np.minimum(q[going], 0)
            top, low = rank >= n - depth, rank < depth  # read from the upper end, from the lower end
            read = (x * top) @ plus.T + (x * low) @ minus.T
            unread_top, unread_low = (~top).astype(np.float64), (~low).astype(np.float64)
            lower = read + unread_top @ (plus * lists[0]).T + unread_low @ (minus * lists[-1]).T
            upper = read + unread_top @ (plus * lists[n - depth]).T + unread_low @ (minus * lists[depth - 1]).T
            lower[mine[going].T] = -np.inf
            upper[mine[going].T] = -np.inf
            kth = np.partition(lower, n - k, axis=0)[n - k] if n >= k else np.full(len(going), -np.inf)
            reach = (upper >= kth) & np.isfinite(upper)
            done = (reach.sum(0) <= max(4 * k, 0.02 * n)) | (depth == n)
            for c in np.flatnonzero(done):
                at = np.flatnonzero(reach[:, c])
                score = (x[at] @ q[going[c]]).astype(np.int64)
                best = np.lexsort([ids[at], -score])[:k]
                out += [(i + int(going[c]), int(at[b]), int(score[b])) for b in best]
            going = going[~done]
    return out


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby(pdf["v"].map(len), sort=True):
            asked, there = rows[rows["query"]], rows[~rows["query"]]
            if not len(asked) or not len(there):
                continue
            ids, own = there["id"].to_numpy(np.int64), asked["id"].to_numpy(np.int64)
            found = search_block(np.stack(asked["v"].to_list()), np.stack(there["v"].to_list()), ids, own, k)
            out += [(int(own[q]), int(ids[v]), s) for q, v, s in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(
    spark: SparkSession, vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows.

    Components x are floor(scale * x); the score is the integer inner product,
    ties go to the smaller id. Queries are the rows for which is_query holds.
    A row is no candidate for a query with its own id, so that repeated rows of
    a query aren't found by it; other repeated rows are found each, and
    repeated queries are one. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part; vectors of different length
    don't meet; empty vectors score 0. Scores beyond a long stop at its ends.
    Results have fewer rows where there are fewer candidates; an empty table
    gives an empty result. Other columns aren't read, whatever their names.
    """
    read = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    ok = read.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    whole = ok.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    n, n_queries = ok.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    size = min(max(LEAST_BLOCK, n // BLOCKS), LARGEST_BLOCK)
    blocks, query_blocks = max(1, -(-n // size)), max(1, -(-n_queries // QUERY_BLOCK))
    there = whole.select("id", "v", F.lit(False).alias("query"), F.monotonically_increasing_id().alias("at"))
    there = there.withColumn("block", F.pmod(F.xxhash64("id", "at"), F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = whole.filter("query").dropDuplicates(["id"]).select("id", "v", "query", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    both = there.select("block", "query_block", "id", "v", "query").unionByName(asked)
    found = both.repartition(min(blocks * query_blocks, 20_000), "block", "query_block").groupBy("block", "query_block").applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
