"""An ordered map from integer keys to values, as an immutable DataFrame of (key, value).

Reads are filters, which reach the Parquet scan as pushed-down predicates; over data written
by `sorted_layout` they skip all row groups outside the range.  Writes give a new map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OrderedMap:
    def __init__(self, df: DataFrame, key: str = "key", value: str = "value"):
        self.df = df.select(F.col(key).cast("bigint").alias("key"), F.col(value).alias("value"))

    def get(self, key: int) -> DataFrame:
        """The entry of the key; no row if there is none."""
        return self.df.filter(F.col("key") == key)

    def scan(self, begin: int, end: int) -> DataFrame:
        """Entries from begin to end, both inclusive, ascending."""
        return self.df.filter(F.col("key").between(begin, end)).orderBy("key")

    def entries(self) -> DataFrame:
        return self.df

    def set(self, key: int, value) -> OrderedMap:
        """Insert or replace one entry."""
        return self._replaced(F.col("key") != key, [(key, value)])

    def set_all(self, entries: DataFrame) -> OrderedMap:
        """Insert or replace many entries, given as (key, value) with unique keys."""
        new = entries.select(F.col("key").cast("bigint").alias("key"), F.col("value").cast(self.df.schema["value"].dataType).alias("value"))
        return OrderedMap(self.df.join(new.select("key"), "key", "left_anti").unionByName(new))

    def remove(self, key: int) -> OrderedMap:
        """Without the key; the same entries if it is absent."""
        return OrderedMap(self.df.filter(F.col("key") != key))

    def _replaced(self, keep, rows) -> OrderedMap:
        new = self.df.sparkSession.createDataFrame(rows, self.df.schema)
        return OrderedMap(self.df.filter(keep).unionByName(new))

    def sorted_layout(self, partitions: int) -> DataFrame:
        """Entries range-partitioned and sorted by key, for writing."""
        return self.df.repartitionByRange(partitions, "key").sortWithinPartitions("key")
