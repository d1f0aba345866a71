"""Numbers over a whole table's order, without one task that holds the table."""

from __future__ import annotations

#: Rows whose keys cut a table's order into ranges that are numbered side by side.
CUTS = 127


def steps(cuts: int) -> str:
    """The steps of a binary search among so many cuts, one less than a power of two."""
    return ", ".join(str(1 << i) for i in reversed(range(cuts.bit_length())))


def numbered_rows(rows: str, descending: list[bool]) -> str:
    """SQL of the rows of a relation with quern_b, their range of the order, and quern_base, the number of rows in ranges before it.

    The order is that of the columns quern_k0, quern_k1 and on. Rows of equal
    keys lie in one range. Any rows would do as cuts, so those of the smallest
    hashes are taken: they are spread like the table, and always the same.
    """
    keys = [f"quern_k{i}" for i in range(len(descending))]

    def before(c: str, row: str) -> str:
        """SQL of whether the keys of c lie before those of row, with NULL first, or last where descending."""
        out = "false"
        for k, down in reversed([*zip(keys, descending)]):
            x, y = f"{c}{k}", f"{row}{k}"
            nulls = f"{x} IS NOT NULL AND {y} IS NULL" if down else f"{x} IS NULL AND {y} IS NOT NULL"
            out = f"(coalesce({x} {'>' if down else '<'} {y}, {nulls}) OR {x} <=> {y} AND {out})"
        return out

    listed = ", ".join(keys)
    return f"""WITH quern_r AS (SELECT * FROM {rows} ),
quern_p AS (SELECT *, (SELECT array_sort(collect_list(struct({listed})), (x, y) -> CASE WHEN {before('x.', 'y.')} THEN -1 WHEN {before('y.', 'x.')} THEN 1 ELSE 0 END) FROM (SELECT {listed} FROM (SELECT {listed}, xxhash64(*) AS h FROM quern_r) ORDER BY h LIMIT {CUTS})) AS quern_cuts FROM quern_r),
quern_s AS (SELECT *, aggregate(array({steps(CUTS)}), 0, (p, w) -> CASE WHEN p + w <= size(quern_cuts) AND {before('quern_cuts[p + w - 1].', '')} THEN p + w ELSE p END) AS quern_b FROM quern_p),
quern_t AS (SELECT quern_b, coalesce(sum(n) OVER (ORDER BY quern_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS quern_base FROM (SELECT quern_b, count(*) AS n FROM quern_s GROUP BY quern_b))
SELECT /*+ BROADCAST(quern_t) */ quern_s.*, quern_base FROM quern_s JOIN quern_t ON quern_s.quern_b = quern_t.quern_b"""
