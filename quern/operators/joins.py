"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.numbering import steps

#: The level of intervals of no length, and that of unbounded ones, which hold a single cell.
POINT, ENDLESS = -2000, 1001


def range_join(left: DataFrame, right: DataFrame, point: Column, low: Column, high: Column, width: float, how: str = "inner") -> DataFrame:
    """Rows of left and right with low <= point <= high; point is of left, the bounds of right.

    The axis is cut into bins of the given width. A point lies in one, an
    interval is repeated in each that it touches, and the join is an equi-join
    on the bin, which shuffles and spills; the bounds are tested within. Choose
    width near the usual interval's length: much longer ones are repeated often.
    Where lengths differ widely, `interval_cells` and `point_cells` need no width.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    at = lambda x: F.floor(x.cast("double") / width).cast("bigint")
    a = left.withColumn("_bin", at(point)).withColumn("_point", point)
    b = right.filter(low <= high).withColumns({"_low": low, "_high": high}).withColumn("_cell", F.explode(F.sequence(at(low), at(high))))
    inside = (F.col("_bin") == F.col("_cell")) & (F.col("_point") >= F.col("_low")) & (F.col("_point") <= F.col("_high"))
    return a.join(b, inside, how).drop("_bin", "_point", "_cell", "_low", "_high")


def level(low: str, high: str) -> str:
    """SQL of the power of two whose cells are longer than the interval from low to high, both doubles."""
    return f"(CASE WHEN {high} - {low} = 0 THEN {POINT} ELSE cast(ceil(least(log2({high} - {low}), {ENDLESS - 1}D)) AS int) + 1 END)"


def _cell(x: str, e: str) -> str:
    return f"(CASE WHEN {e} = {POINT} THEN xxhash64({x} + 0D) WHEN {e} >= {ENDLESS} THEN 0L ELSE cast(floor({x} / power(2D, {e})) AS bigint) END)"


def interval_cells(low: str, high: str) -> str:
    """SQL of the cells, structs (e, c), of an interval: one or two of its own level."""
    both = ", ".join(f"struct(e AS e, {_cell(x, 'e')} AS c)" for x in (low, high))
    return f"(CASE WHEN {low} <= {high} THEN flatten(transform(array({level(low, high)}), e -> array_distinct(array({both})))) END)"


def point_cells(point: str, levels: str) -> str:
    """SQL of the cells that hold a point, one of each level in an array.

    A point in an interval shares exactly one cell with it. There are at most
    some 2,100 levels of doubles; intervals of like length have two or three.
    """
    return f"(CASE WHEN {point} IS NOT NULL THEN transform({levels}, e -> struct(e AS e, {_cell(point, 'e')} AS c)) END)"


#: Ranges of values that are counted side by side; a list of at most so many sums is carried from one to the next.
RANGES = 256


def counts_beside(asked: str, counted: str, sign: str) -> str:
    """SQL of (quern_v, quern_c): for each value of the query asked, how many rows of the query counted are < it, or <=, >, >=.

    Both give one column, v, of numbers. Rows aren't paired: equal
    values are counted together before the shuffle, quantiles of the distinct
    values cut them into ranges, and each range counts on from the sum of those
    before it.
    """
    order = "DESC" if sign[0] == ">" else "ASC"
    parts = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    return f"""WITH quern_u AS (SELECT v, sum(k) AS k, max(a) AS a FROM (SELECT v, 0L AS k, true AS a FROM ({asked}) UNION ALL SELECT v, 1L AS k, false AS a FROM ({counted})) WHERE v IS NOT NULL GROUP BY v),
quern_c AS (SELECT *, (SELECT approx_percentile(v, array({parts})) FROM quern_u) AS cuts FROM quern_u),
quern_b AS (SELECT v, k, a, size(filter(cuts, x -> x < v)) AS b FROM quern_c),
quern_t AS (SELECT b, coalesce(sum(k) OVER (ORDER BY b {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base FROM (SELECT b, sum(k) AS k FROM quern_b GROUP BY b))
SELECT /*+ BROADCAST(quern_t) */ v AS quern_v, base + run{"" if "=" in sign else " - k"} AS quern_c FROM (SELECT v, k, a, b, sum(k) OVER (PARTITION BY b ORDER BY v {order}) AS run FROM quern_b) JOIN quern_t USING (b) WHERE a"""


def span_rows(low: str, high: str, signs: tuple[int, int], closed: tuple[bool, bool] = (True, True)) -> str:
    """SQL of (quern_v, quern_o, quern_w): two rows for each span, with its signs as weights, for `counted_rows`.

    quern_o orders what lies at one value: 1 is a point, 0 comes before it and
    2 after it, so that a closed end holds the points at it and an open one doesn't.
    """
    row = lambda v, o, w: f"named_struct('quern_v', {v}, 'quern_o', {o}, 'quern_w', {w}L)"
    return f"inline(array({row(low, 0 if closed[0] else 2, signs[0])}, {row(high, 2 if closed[1] else 0, signs[1])}))"


def counted_rows(asked: str, counted: str) -> str:
    """SQL of asked's rows with quern_n: quern_w times the sum of quern_w over the rows of counted that lie before.

    Both are relations with (quern_v, quern_o, quern_w), in that order on the
    axis. Where points are counted for spans, the spans are asked for with signs
    -1 and 1; where spans are counted for points, they have signs 1 and -1. The
    sum of quern_n over a group is its number of pairs then. Nothing is paired:
    like `counts_beside`, each of many ranges of the distinct values counts on
    from the sum of those before it.
    """
    parts = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    return f"""WITH quern_u AS (SELECT v, o, sum(k) AS k, max(a) AS a FROM (SELECT quern_v AS v, quern_o AS o, 0L AS k, true AS a FROM {asked} UNION ALL SELECT quern_v AS v, quern_o AS o, quern_w AS k, false AS a FROM {counted} ) WHERE v IS NOT NULL GROUP BY v, o),
quern_c AS (SELECT *, (SELECT approx_percentile(v, array({parts})) FROM quern_u) AS cuts FROM quern_u),
quern_b AS (SELECT v, o, k, a, aggregate(array({steps(RANGES - 1)}), 0, (p, w) -> CASE WHEN cuts[p + w - 1] < v THEN p + w ELSE p END) AS b FROM quern_c),
quern_t AS (SELECT b, coalesce(sum(k) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base FROM (SELECT b, sum(k) AS k FROM quern_b GROUP BY b)),
quern_k AS (SELECT /*+ BROADCAST(quern_t) */ v, o, base + run AS c FROM (SELECT v, o, a, b, sum(k) OVER (PARTITION BY b ORDER BY v, o ROWS UNBOUNDED PRECEDING) AS run FROM quern_b) JOIN quern_t USING (b) WHERE a)
SELECT quern_a.*, quern_w * c AS quern_n FROM {asked} AS quern_a JOIN quern_k ON quern_v = v AND quern_o = o"""
