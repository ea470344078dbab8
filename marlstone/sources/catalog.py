"""Tables as immutable versions, and what is known of their indexes.

A version is a tuple of parts, each a DataFrame over its own parquet folder.  INSERT adds a
part; UPDATE and DELETE write anew the parts that hold matching rows and keep the others, so
a statement costs what it touches.  A statement swaps the version when all is written: readers
of the old one are not disturbed, and an error leaves the table as it was.

Small parts are merged as they come: FAN of a size class become one of the next, so a table of
n rows has about FAN * log(n) parts and each row is rewritten about log(n) times.  A scan reads
all parts at once.  Folders of old versions stay until :meth:`Catalog.vacuum`.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..errors import BindError, CatalogError
from ..functions.types import Field, fields_of, struct


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    primary: bool = False


#: Parts of one size class that are merged; a class holds parts of up to FAN times the rows of the one below.
FAN = 16


def due(rows: list[int | None]) -> int:
    """How many of the last parts, given the rows of all, should become one: FAN or more, or none.  Parts of unknown size stay."""
    if not rows or rows[-1] is None:
        return 0
    tier = lambda n: len(f"{max(n, 1) - 1:x}") if n > 1 else 0  # noqa: E731  the power of 16 that holds n
    n = 0
    while n < len(rows) and rows[-1 - n] is not None and tier(rows[-1 - n]) <= tier(rows[-1]):
        n += 1
    return n if n >= FAN else 0


@dataclass
class Table:
    """``parts`` make up the version; ``batches``: the last micro-batch of each stream that is in it."""

    name: str
    fields: list[Field]
    parts: tuple[DataFrame, ...] = ()
    indexes: dict[str, Index] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.tables, self._folder, self._written = spark, {}, folder, set()

    # -- storage
    def new_path(self, table: str) -> str:
        """A fresh folder on the storage that the cluster shares: the catalog's own, or ``spark.checkpoint.dir``;
        a local one where neither is set and the master is local."""
        if self._folder is None:
            sc = self.spark.sparkContext
            shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
            if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            self._folder = f"{(shared or tempfile.mkdtemp(prefix='marlstone-')).rstrip('/')}/tables"
        return f"{self._folder}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: Table) -> DataFrame:
        """A part with the rows of ``df``."""
        path = self.new_path(table.name)
        df.write.parquet(path)
        part = self.spark.read.schema(struct(table.fields)).parquet(path)
        self._written.add(path)
        part._path, part._rows = path, part.count()  # from the new files' footers
        return part

    def add(self, table: Table, part: DataFrame) -> None:
        """A version with one part more; parts of a size class that has become full are merged."""
        parts = (*table.parts, part)
        while n := due([getattr(p, "_rows", None) for p in parts]):
            parts = (*parts[:-n], self.write(self.union(table, parts[-n:]), table))
        table.parts = parts

    def union(self, table: Table, parts: tuple[DataFrame, ...]) -> DataFrame:
        """The rows of the parts; those that the catalog has written are read in one scan."""
        paths = [p._path for p in parts if hasattr(p, "_path")]
        frames = [p for p in parts if not hasattr(p, "_path")]
        if paths:
            frames.append(self.spark.read.schema(struct(table.fields)).parquet(*paths))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], struct(table.fields))

    def vacuum(self) -> int:
        """Delete the folders that no table's version reads any more; their number.  Frames of old versions stop working."""
        used = {getattr(p, "_path", None) for t in self.tables.values() for p in t.parts}
        gone = self._written - used
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._written &= used
        return len(gone)

    # -- tables
    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise BindError("TableNotFound", name)
        return self.tables[name]

    def fields(self, name: str) -> list[Field]:
        return self.get(name).fields

    def frame(self, name: str) -> DataFrame:
        table = self.get(name)
        return self.union(table, table.parts)

    def create(self, name: str, fields: list[Field]) -> Table:
        if name in self.tables:
            raise CatalogError("DuplicateTable", name)
        self.tables[name] = Table(name, fields)
        return self.tables[name]

    def register(self, name: str, df: DataFrame) -> None:
        """A table over data that exists; statements that change it write elsewhere."""
        self.create(name, fields_of(df.schema)).parts = (df,)

    def drop(self, name: str) -> None:
        if name not in self.tables:
            raise CatalogError("TableNotFound", name)
        del self.tables[name]

    # -- indexes: kept as metadata, since file statistics and join strategies take their place
    def create_index(self, name: str, table: str, columns: list[str], primary: bool = False) -> Index:
        owner = self.get(table)
        if name in owner.indexes:
            raise CatalogError("DuplicateIndex", name)
        by_name = {f.name.lower(): f for f in owner.fields}
        found = [by_name[c.lower()] for c in columns]
        if not 1 <= len(found) <= 2 or any(f.type == "varchar" or f.type.startswith("other:") for f in found):
            raise CatalogError("UnsupportedIndexType", ", ".join(f"{f.name} {f.type}" for f in found))
        owner.indexes[name] = Index(name, table, [f.name for f in found], primary)
        return owner.indexes[name]
