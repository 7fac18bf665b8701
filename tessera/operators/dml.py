"""Data changes as rewrites: each gives the next immutable version and the count of rows it touched."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NameError_, TypeError_
from ..plans import ast
from ..plans.resolver import Scope, class_of
from ..sources.catalog import Table


def _fits(table: Table, schema: T.StructType, name: str, value: int | str) -> None:
    column = table.column(name)
    if class_of(schema[name].dataType) != class_of(value):
        raise TypeError_(f"{name} takes {column.kind}, not {value!r}")
    if column.kind == ast.VARCHAR and column.length and len(value) > column.length:
        raise TypeError_(f"{value!r} is longer than {name} VARCHAR({column.length})")
    limits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}
    bits = limits.get(type(schema[name].dataType))
    if bits and value >= 1 << bits:
        raise TypeError_(f"{value} is out of range for {name}")


def next_version(table: Table, df: DataFrame) -> Table:
    return replace(table, load=lambda: df, version=table.version + 1, depth=table.depth + 1, folders=(), added=None)


def with_rows(table: Table, new: DataFrame) -> Table:
    """The next version has further rows; what was committed before stays where it is."""
    out = next_version(table, table.load().union(new))
    if table.folders:
        out = replace(out, folders=table.folders, added=new if table.added is None else table.added.union(new))
    return out


def insert(spark: SparkSession, table: Table, statement: ast.Insert) -> tuple[Table, int]:
    old = table.load()
    if len(set(statement.fields)) != len(statement.fields):
        raise NameError_("a column is named twice")
    given = dict(zip(statement.fields, (v.value for v in statement.values), strict=True))
    for name, value in given.items():
        table.column(name)
        _fits(table, old.schema, name, value)
    defaults = {"int": 0, "string": ""}
    row = [given.get(f.name, defaults.get(class_of(f.dataType))) for f in old.schema.fields]
    new = spark.createDataFrame([tuple(row)], T.StructType([T.StructField(f.name, f.dataType, True) for f in old.schema.fields]))
    return with_rows(table, new), 1


def _matching(df: DataFrame, predicate: ast.Predicate):
    return F.coalesce(Scope.of(df).condition(predicate), F.lit(False))


def delete(table: Table, statement: ast.Delete) -> tuple[Table, int]:
    old = table.load()
    hit = _matching(old, statement.predicate)
    return next_version(table, old.filter(~hit)), old.filter(hit).count()


def update(table: Table, statement: ast.Update) -> tuple[Table, int]:
    """SET takes the row's own values before the change."""
    old = table.load()
    column, scope = table.column(statement.field), Scope.of(old)
    if isinstance(statement.value, ast.Const):
        _fits(table, old.schema, statement.field, statement.value.value)
    value, kind = scope.expression(statement.value)
    target = old.schema[statement.field].dataType
    if class_of(target) != kind:
        raise TypeError_(f"{statement.field} takes {column.kind}")
    hit = _matching(old, statement.predicate)
    long = F.length(value) > column.length if column.kind == ast.VARCHAR and column.length else F.lit(False)
    count, over = old.agg(F.count_if(hit), F.count_if(hit & F.coalesce(long, F.lit(False)))).first()
    if over:
        raise TypeError_(f"{over} values are longer than {statement.field} VARCHAR({column.length})")
    changed = F.when(hit, value.cast(target)).otherwise(scope.column(statement.field)[0])
    return next_version(table, old.withColumn(statement.field, changed)), count
