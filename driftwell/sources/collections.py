"""Vector collections as Parquet folders or catalog tables, and the protocol that other stores can fill."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwell.functions import vectors
from driftwell.operators import checks, migrate
from driftwell.sources import files


class Collection(Protocol):
    """What a store offers: all rows as (id, vector), or with their places as (pos, id, vector), replacement, and upsert."""

    def read(self) -> DataFrame: ...

    def records(self) -> DataFrame: ...

    def check(self) -> None: ...

    def replace(self, records: DataFrame, order: str | None = None) -> int: ...

    def merge(self, records: DataFrame, order: str | None = None) -> int: ...


class _Stored:
    def __init__(self, spark: SparkSession, id_column: str = "id", vector_column: str = "embedding", single_precision: bool = False, order_column: str = ""):
        self.spark, self.single = spark, single_precision
        self.id_column, self.vector_column = checks.identifier(id_column, "id column"), checks.identifier(vector_column, "vector column")
        self.order_column = checks.identifier(order_column, "order column") if order_column else ""

    def read(self) -> DataFrame:
        """Two columns reach the scan."""
        return self._load().select(F.col(self.id_column).alias("id"), vectors.doubles(self.vector_column).alias("vector"))

    def records(self) -> DataFrame:
        """The rows with the order column, where one is named, as pos."""
        own = [F.col(self.order_column).alias("pos")] if self.order_column else []
        return self._load().select(*own, F.col(self.id_column).alias("id"), vectors.doubles(self.vector_column).alias("vector"))

    def check(self) -> None:
        """Whether the collection is there and has an id and a vector column."""
        kinds = dict(self._load().dtypes)
        for name in (self.id_column, self.vector_column, *([self.order_column] if self.order_column else [])):
            checks.require(name in kinds, f"the collection has no column {name!r}")
        checks.require(kinds[self.vector_column] in ("array<float>", "array<double>"), f"column {self.vector_column!r} is not an array of numbers")

    def count(self) -> int:
        return self._load().count()

    def replace(self, records: DataFrame, order: str | None = None) -> int:
        """Rows written, repeats included; of rows that share an id the last by ``order`` stays."""
        return self._change(records, lambda own: migrate.replace(own, order))

    def merge(self, records: DataFrame, order: str | None = None) -> int:
        """Rows written, repeats included; other rows stay."""
        return self._change(records, lambda own: migrate.upsert(self.read(), own, order) if self.exists() else migrate.replace(own, order))

    def _change(self, records: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """The records are written first: their plan runs once and may read this collection. The new state is then written, and takes the old one's place."""
        mark = uuid.uuid4().hex[:12]
        own = self._write(migrate.stored(records, self.single), f"in_{mark}")
        try:
            written = own.count()
            self._write(self._named(change(own)), f"new_{mark}")
            self._swap(f"new_{mark}")
            return written
        finally:
            self._remove(f"in_{mark}")

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(self.id_column), F.col("vector").cast("array<float>" if self.single else "array<double>").alias(self.vector_column))


class ParquetCollection(_Stored):
    """A folder of Parquet files. A new state is written beside the old one, which is moved aside until the new one has its place."""

    def __init__(self, spark: SparkSession, path: str, **names):
        super().__init__(spark, **names)
        checks.require(bool(path), "a path must not be empty")
        self.path = path.rstrip("/")

    def _place(self, suffix: str = ""):
        return files.place(self.spark, f"{self.path}.{suffix}" if suffix else self.path)

    def exists(self) -> bool:
        """A state that was moved aside, and whose successor never came, is put back first."""
        fs, here = self._place()
        if not fs.exists(here) and fs.exists(old := self._place("old")[1]):
            fs.rename(old, here)
        return fs.exists(here)

    def _load(self) -> DataFrame:
        checks.require(self.exists(), f"there is no collection at {self.path!r}")
        return self.spark.read.parquet(self.path)

    def _write(self, rows: DataFrame, suffix: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}.{suffix}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}.{suffix}")

    def _remove(self, suffix: str) -> None:
        fs, where = self._place(suffix)
        fs.delete(where, True)

    def _swap(self, suffix: str) -> None:
        fs, here = self._place()
        fresh, old = self._place(suffix)[1], self._place("old")[1]
        if self.exists():
            fs.delete(old, True)
            checks.require(fs.rename(here, old), f"{self.path!r} could not be moved aside")
        if not fs.rename(fresh, here):
            fs.rename(old, here)
            raise ValueError(f"the new state of {self.path!r} could not take its place")
        fs.delete(old, True)


class TableCollection(_Stored):
    """A catalog table; changes are made as for a folder."""

    def __init__(self, spark: SparkSession, name: str, **names):
        super().__init__(spark, **names)
        self.name = ".".join(checks.identifier(part, "table") for part in name.split("."))

    def exists(self) -> bool:
        if not self.spark.catalog.tableExists(self.name) and self.spark.catalog.tableExists(f"{self.name}_old"):
            self._rename(f"{self.name}_old", self.name)
        return self.spark.catalog.tableExists(self.name)

    def _rename(self, one: str, other: str) -> None:
        self.spark.sql(f"ALTER TABLE {one} RENAME TO {other}")

    def _load(self) -> DataFrame:
        checks.require(self.exists(), f"there is no table {self.name!r}")
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, suffix: str) -> DataFrame:
        rows.write.mode("overwrite").saveAsTable(f"{self.name}_{suffix}")
        return self.spark.table(f"{self.name}_{suffix}")

    def _remove(self, suffix: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{suffix}")

    def _swap(self, suffix: str) -> None:
        if self.exists():
            self._remove("old")
            self._rename(self.name, f"{self.name}_old")
        self._rename(f"{self.name}_{suffix}", self.name)
        self._remove("old")


def opened(spark: SparkSession, where: str, **names) -> ParquetCollection | TableCollection:
    """A plain identifier (or two, with a dot) is a table, all else a path."""
    plain = all(p.isidentifier() and p.isascii() for p in where.split("."))
    return TableCollection(spark, where, **names) if where and plain else ParquetCollection(spark, where, **names)
