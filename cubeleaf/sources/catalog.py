"""A catalog of versioned tables in a folder that Spark can reach.

A table is a folder with data versions (Parquet in order; an UPDATE's row numbers included), or a definition (a row selection of
another table, or a concatenation), and manifests ``manifest-<n>.json`` with the schema's metadata, keywords and
the version's data.  A save writes data first and then creates the next manifest, which fails if another writer
has created it meanwhile; readers take the manifest with the highest number.  So a crash leaves the version
before, and whoever holds an older version can see that it is stale.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lower import ROW
from ..plans.parser import LanguageError
from ..table import Table


class Conflict(RuntimeError):
    """Another writer has saved the table meanwhile."""


class _Folder:
    """Files of a folder, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one."""
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._at(name)) or not self.fs.rename(part, self._at(name)):
            self.fs.delete(part, False)
            raise Conflict(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Catalog:
    """Named tables below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str) -> _Folder:
        if not name or name.startswith((".", "/")) or ".." in name.split("/"):
            raise LanguageError(f"{name!r} is no table name")
        return _Folder(self.spark, f"{self.path}/{name}")

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[9:-5]) for x in self._folder(name).names() if x.startswith("manifest-") and x.endswith(".json"))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def names(self) -> list[str]:
        return sorted(n for n in _Folder(self.spark, self.path).names() if self.exists(n))

    def manifest(self, name: str, version: int | None = None) -> dict:
        known = self.versions(name)
        if not known:
            raise LanguageError(f"no table {name!r}")
        return json.loads(self._folder(name).read(f"manifest-{version or known[-1]}.json"))

    def table(self, name: str, version: int | None = None) -> Table:
        """The newest version, or a given one."""
        m = self.manifest(name, version)
        if m["kind"] == "rows":
            parent = self.table(m["parent"], m.get("parent_version"))
            rows = self.spark.read.parquet(f"{self.path}/{name}/{m['data']}")
            df = parent.df.join(rows.withColumnRenamed(ROW, "__parent"), F.col(ROW) == F.col("__parent"), "left_semi")
            picked = df.select(*(F.col(f"`{src}`").alias(out) for out, src in m["columns"].items()), ROW)
            return Table(picked, m["keywords"], name)
        if m["kind"] == "parts":
            from ..operators.query import concat

            out = concat(*(self.table(p) for p in m["parts"]))
            return Table(out.df, m["keywords"], name)
        schema = T.StructType.fromJson(m["schema"])
        at = f"{self.path}/{name}/{m['data']}"
        df = self.spark.read.schema(schema).parquet(at) if ROW in schema.names else Table.read(self.spark, at, schema).df
        df = df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields if f.name != ROW), ROW)
        for column, text in m.get("virtual", {}).items():
            from ..plans.lower import Context, lower
            from ..plans.values import output

            df = df.withColumn(column, output(lower(text, Context.of(df, m["keywords"]))))
        return Table(df, m["keywords"], name)

    def save(self, name: str, t: Table | DataFrame, *, new: bool = False, keywords: dict | None = None, virtual: dict[str, str] | None = None, same_rows: bool = False) -> int:
        """The next version of a table; virtual columns are kept as expressions and computed when read.

        same_rows: the rows are those of the version before, with their numbers, so nothing is sorted.
        """
        t = Table.of(t, keywords)
        known = self.versions(name)
        if new and known:
            raise LanguageError(f"there is a table {name!r} already")
        version = (known[-1] if known else 0) + 1
        data = f"data-{version}-{uuid.uuid4().hex}"
        # in order, so that a row's number is its place in the files; no second run of the sort would cut partitions alike
        df = t.df if same_rows else t.df.orderBy(ROW).drop(ROW)
        df.write.parquet(f"{self.path}/{name}/{data}")
        base = self.manifest(name) if known else {}
        m = {"kind": "data", "data": data, "version": version, "schema": json.loads(df.schema.json()), "keywords": keywords if keywords is not None else t.keywords or base.get("keywords", {}), "virtual": virtual or {}}
        self._folder(name).create(f"manifest-{version}.json", json.dumps(m))
        return version

    def save_rows(self, name: str, parent: str, t: Table, columns: dict[str, str] | None = None) -> int:
        """A selection of rows of a saved table's newest version, without its data; selections of selections refer to the root."""
        m = self.manifest(parent)
        of = m.get("parent_version", m["version"])
        columns = columns or {c: c for c in t.columns}
        if m["kind"] == "rows":
            columns = {out: m["columns"][src] for out, src in columns.items()}
            parent = m["parent"]
        version = len(self.versions(name)) + 1
        data = f"rows-{version}-{uuid.uuid4().hex}"
        t.df.select(ROW).write.parquet(f"{self.path}/{name}/{data}")
        self._folder(name).create(f"manifest-{version}.json", json.dumps({"kind": "rows", "data": data, "version": version, "parent": parent, "parent_version": of, "columns": columns, "keywords": t.keywords}))
        return version

    def save_parts(self, name: str, parts: list[str]) -> int:
        """A concatenation of saved tables."""
        version = len(self.versions(name)) + 1
        first = self.manifest(parts[0])
        self._folder(name).create(f"manifest-{version}.json", json.dumps({"kind": "parts", "version": version, "parts": parts, "keywords": first["keywords"]}))
        return version

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise LanguageError(f"no table {name!r}")
        self._folder(name).delete("")

    def copy(self, name: str, to: str, rows: Table | None = None) -> int:
        """A table, or a selection of it, under another name."""
        t = rows or self.table(name)
        return self.save(to, Table(t.df, t.keywords or self.manifest(name)["keywords"]), new=True)

    def is_stale(self, name: str, version: int) -> bool:
        return self.versions(name)[-1] != version

    def set_keyword(self, name: str, key: str, value) -> int:
        """A keyword of the table; the class of its value stays."""
        m = self.manifest(name)
        old = m["keywords"].get(key)
        if old is not None and type(old) is not type(value) and not (isinstance(old, (int, float)) and isinstance(value, (int, float))):
            raise LanguageError(f"keyword {key!r} has a value of another class")
        return self._restate(name, m, {**m["keywords"], key: value})

    def remove_keyword(self, name: str, key: str) -> int:
        m = self.manifest(name)
        if key not in m["keywords"]:
            raise LanguageError(f"no keyword {key!r}")
        return self._restate(name, m, {k: v for k, v in m["keywords"].items() if k != key})

    def rename_keyword(self, name: str, key: str, to: str) -> int:
        m = self.manifest(name)
        if key not in m["keywords"] or to in m["keywords"]:
            raise LanguageError(f"can't rename keyword {key!r}")
        return self._restate(name, m, {to if k == key else k: v for k, v in m["keywords"].items()})

    def _restate(self, name: str, m: dict, keywords: dict) -> int:
        """A version with the same data and other keywords."""
        version = m["version"] + 1
        self._folder(name).create(f"manifest-{version}.json", json.dumps({**m, "version": version, "keywords": keywords}))
        return version


class ObservationSet:
    """A main table and its dimension tables in one catalog."""

    def __init__(self, catalog: Catalog, main: str = "MAIN"):
        self.catalog, self.main_name = catalog, main

    @property
    def main(self) -> Table:
        return self.catalog.table(self.main_name)

    def __getitem__(self, name: str) -> Table:
        return self.catalog.table(name)

    def subtable_names(self) -> list[str]:
        return [n for n in self.catalog.names() if n != self.main_name]
