"""Names and types: syntax trees to columns.

Everything that plain Spark SQL treats otherwise is settled here, before Catalyst sees the
plan: names are case-sensitive, of equal names the leftmost FROM item's wins, and values of
different classes are unequal instead of being cast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NameError_
from . import ast


def class_of(kind: T.DataType | int | str) -> str:
    """The class within which values compare."""
    if isinstance(kind, int) or isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, str) or isinstance(kind, T.StringType):
        return "string"
    return kind.simpleString()


class Scope:
    """Names of a row: name -> (column, type)."""

    def __init__(self, entries: dict[str, tuple[Column, T.DataType]]):
        self.entries = entries

    @classmethod
    def of(cls, df: DataFrame) -> Scope:
        found: dict[str, tuple[Column, T.DataType]] = {}
        for f in df.schema.fields:
            found.setdefault(f.name, (F.col(f"`{f.name}`"), f.dataType))
        return cls(found)

    def column(self, name: str) -> tuple[Column, T.DataType]:
        if name not in self.entries:
            raise NameError_(f"unknown column {name}")
        return self.entries[name]

    def expression(self, e: ast.Expression) -> tuple[Column, str]:
        if isinstance(e, ast.Field):
            column, kind = self.column(e.name)
            return column, class_of(kind)
        return F.lit(e.value).cast("bigint" if isinstance(e.value, int) else "string"), class_of(e.value)

    def equality(self, term: ast.Term) -> Column:
        (a, x), (b, y) = self.expression(term.left), self.expression(term.right)
        return a == b if x == y else F.lit(False)

    def condition(self, predicate: ast.Predicate) -> Column:
        return reduce(lambda x, y: x & y, map(self.equality, predicate.terms), F.lit(True))


def product(inputs: list[DataFrame]) -> tuple[DataFrame, Scope]:
    """The product of the FROM items, with columns renamed so that no two are equal.

    Catalyst turns it into joins once the equalities stand above it.
    """
    entries: dict[str, tuple[Column, T.DataType]] = {}
    renamed = []
    for i, df in enumerate(inputs):
        names = [f"c{i}_{j}__{f.name}" for j, f in enumerate(df.schema.fields)]
        renamed.append(df.toDF(*names))
        for name, f in zip(names, df.schema.fields, strict=True):
            entries.setdefault(f.name, (F.col(f"`{name}`"), f.dataType))
    return reduce(DataFrame.crossJoin, renamed), Scope(entries)


def select(query: ast.Select, inputs: list[DataFrame]) -> DataFrame:
    df, scope = product(inputs)
    columns = [scope.column(name)[0].alias(name) for name in query.fields]
    return (df.filter(scope.condition(query.predicate)) if query.predicate.terms else df).select(*columns)
