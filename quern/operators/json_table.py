"""JSON_TABLE: rows and typed columns of a JSON document, with built-in functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Path:
    """A column: name, type (SQL), path below the row; exists gives 0 or 1; a default stands for what is absent."""

    name: str
    kind: str
    path: str
    exists: bool = False
    default: object = None
    error: bool = False

    def column(self, row: Column) -> Column:
        found = F.get_json_object(row, self.path)
        if self.exists:
            return found.isNotNull().cast("int").alias(self.name)
        value = found.try_cast(self.kind)
        if self.error:
            value = F.when(found.isNull(), F.raise_error(F.lit(f"3966: no value at {self.path}"))).otherwise(value)
        return (value if self.default is None else F.coalesce(value, F.lit(self.default).cast(self.kind))).alias(self.name)


@dataclass
class Nested:
    """NESTED PATH: rows below each row; of several at one level each has rows of its own."""

    path: str
    columns: list = field(default_factory=list)
    ordinality: str | None = None


def _rows(doc: Column, path: str) -> Column:
    """The array of row documents at a path: '$' one row, '$.a[*]' the elements of $.a. Other wildcards are refused; the text form has them."""
    if "*" in path.removesuffix("[*]") or " to " in path:
        raise ValueError(f"row path {path}")
    if path.endswith("[*]"):
        inner = F.get_json_object(doc, path[:-3]) if path != "$[*]" else doc
        return F.from_json(inner, "array<string>")
    found = F.get_json_object(doc, path)
    return F.when(found.isNotNull(), F.array(found))


def json_table(df: DataFrame, doc: Column, path: str, columns: list[Path | Nested], ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """df's rows, each with the rows of its document; with outer also those without any."""
    return _level(df, doc, Nested(path, columns, ordinality), outer, 0)


def _names(columns: list) -> list[str]:
    return [n for c in columns for n in ([c.name] if isinstance(c, Path) else ([c.ordinality] if c.ordinality else []) + _names(c.columns))]


def _level(df: DataFrame, doc: Column, spec: Nested, outer: bool, depth: int) -> DataFrame:
    at, row = f"_at{depth}", f"_row{depth}"
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select("*", explode(_rows(doc, spec.path)).alias(at, row))
    if spec.ordinality:
        rows = rows.withColumn(spec.ordinality, F.col(at) + 1)
    rows = rows.select("*", *[c.column(F.col(row)) for c in spec.columns if isinstance(c, Path)])
    nested = [c for c in spec.columns if isinstance(c, Nested)]
    if not nested:
        return rows.drop(at, row)
    out = None
    for i, branch in enumerate(nested):
        # a parent without rows in any branch appears once, in the first
        one = _level(rows, F.col(row), branch, i == 0, depth + 1)
        if i == 0 and len(nested) > 1:
            others = [F.coalesce(F.size(_rows(F.col(row), b.path)), F.lit(0)) > 0 for b in nested[1:]]
            has = F.coalesce(F.size(_rows(F.col(row), branch.path)), F.lit(0)) > 0
            any_other = others[0]
            for o in others[1:]:
                any_other = any_other | o
            one = _level(rows.filter(has | ~any_other), F.col(row), branch, True, depth + 1)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.drop(at, row)
