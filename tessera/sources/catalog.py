"""Tables, views and indexes, their layouts, and the four catalog tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import NameError_
from ..plans import ast

#: Bytes of an integer, of the in-use flag and of a length, type codes, catalog name length.
WORD, INT_CODE, VARCHAR_CODE, OTHER_CODE, NAME_LENGTH, VIEW_LENGTH = 8, 0, 1, -1, 16, 100


@dataclass(frozen=True)
class Layout:
    """Byte positions that a fixed-length slot would have; block counts derive from it."""

    offsets: dict[str, int]
    slot_size: int

    def slots_per_block(self, block_size: int) -> int:
        return block_size // self.slot_size


def layout(columns: tuple[ast.ColumnDef, ...]) -> Layout:
    at, offsets = WORD, {}
    for c in columns:
        offsets[c.name] = at
        at += WORD + (c.length if c.kind == ast.VARCHAR else 0)
    return Layout(offsets, at)


def spark_schema(columns: tuple[ast.ColumnDef, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, T.LongType() if c.kind == ast.INT else T.StringType(), False) for c in columns])


def described(schema: T.StructType) -> tuple[ast.ColumnDef, ...]:
    """Column definitions of an outside table; strings have no length limit (0), other types pass through."""
    kinds = {True: ast.INT}
    return tuple(ast.ColumnDef(f.name, kinds.get(isinstance(f.dataType, T.IntegralType), ast.VARCHAR if isinstance(f.dataType, T.StringType) else f.dataType.simpleString())) for f in schema.fields)


@dataclass(frozen=True)
class Table:
    """One immutable version of a table."""

    name: str
    columns: tuple[ast.ColumnDef, ...]
    load: Callable[[], DataFrame] = field(compare=False)
    version: int = 0
    depth: int = 0  # rewrites since the data was last written out
    folders: tuple[str, ...] = ()  # committed files that hold the rows, all but the added ones
    added: DataFrame | None = field(default=None, compare=False)

    @property
    def layout(self) -> Layout:
        return layout(self.columns)

    def column(self, name: str) -> ast.ColumnDef:
        found = next((c for c in self.columns if c.name == name), None)
        if found is None:
            raise NameError_(f"table {self.name} has no column {name}")
        return found


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    fields: tuple[str, ...]


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, ast.Select] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), dict(self.views), dict(self.indexes))

    def claim(self, name: str) -> None:
        if name in self.tables or name in self.views or name in CATALOG_TABLES:
            raise NameError_(f"{name} exists already")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NameError_(f"unknown table {name}")
        return self.tables[name]

    def indexes_of(self, table: str) -> dict[str, Index]:
        """Column -> index; the last one made on a column counts."""
        return {i.fields[0]: i for i in self.indexes.values() if i.table == table}


def _def(*columns: tuple[str, int]) -> tuple[ast.ColumnDef, ...]:
    return tuple(ast.ColumnDef(n, ast.VARCHAR, size) if size else ast.ColumnDef(n, ast.INT) for n, size in columns)


#: Names, columns and lengths of the catalog tables.
CATALOG_TABLES = {
    "tblcat": _def(("tblname", NAME_LENGTH), ("slotsize", 0)),
    "fldcat": _def(("tblname", NAME_LENGTH), ("fldname", NAME_LENGTH), ("type", 0), ("length", 0), ("offset", 0)),
    "viewcat": _def(("viewname", NAME_LENGTH), ("viewdef", VIEW_LENGTH)),
    "idxcat": _def(("indexName", NAME_LENGTH), ("tableName", NAME_LENGTH), ("fieldName", NAME_LENGTH)),
}


def catalog_frame(spark: SparkSession, catalog: Catalog, name: str) -> DataFrame:
    """A catalog table as a DataFrame; its size is that of the catalog."""
    everything = {**CATALOG_TABLES, **{t.name: t.columns for t in catalog.tables.values()}}
    codes = {ast.INT: INT_CODE, ast.VARCHAR: VARCHAR_CODE}
    rows = {
        "tblcat": lambda: [(n, layout(c).slot_size) for n, c in everything.items()],
        "fldcat": lambda: [(n, c.name, codes.get(c.kind, OTHER_CODE), c.length, layout(cs).offsets[c.name]) for n, cs in everything.items() for c in cs],
        "viewcat": lambda: [(n, str(q)) for n, q in catalog.views.items()],
        "idxcat": lambda: [(i.name, i.table, f) for i in catalog.indexes.values() for f in i.fields],
    }[name]()
    return spark.createDataFrame(rows, spark_schema(CATALOG_TABLES[name]))
