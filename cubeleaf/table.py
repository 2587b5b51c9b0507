"""Tables: a DataFrame with a row number, keywords and column metadata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.lower import ROW


@dataclass
class Table:
    """A DataFrame whose rows have an order, given by the hidden column ``__rowid`` (from 0).

    keywords holds the table's keywords, and under "columns" those of its columns.
    """

    df: DataFrame
    keywords: dict = field(default_factory=dict)
    name: str = ""

    @classmethod
    def of(cls, df: DataFrame | Table, keywords: dict | None = None) -> Table:
        """A table of any DataFrame.  Without a row number of its own it gets increasing, not contiguous ones."""
        if isinstance(df, Table):
            return df
        out = df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())
        return cls(out, keywords or {})

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: T.StructType | None = None) -> Table:
        """A Parquet table; the row number is the place in the file and the number of rows in the files before.

        In a single file that takes no job.  Else the rows of each file are counted, which reads footers only, and
        the files' offsets, two numbers for each, are sent to where the files are read.
        """
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
        at = F.col("_metadata.row_index")
        files = df.inputFiles()
        if len(files) == 1:
            return cls(df.select("*", at.alias(ROW)))
        marked = df.select("*", F.col("_metadata.file_path").alias("__file"), at.alias(ROW))
        sizes = {r["__file"]: r["count"] for r in marked.groupBy("__file").count().collect()}  # a row for each file
        start, offsets = 0, []
        for name in sorted(sizes):
            offsets.append((name, start))
            start += sizes[name]
        if not offsets:
            return cls(df.withColumn(ROW, F.lit(0).cast("bigint")))
        moved = marked.join(_offsets(spark, offsets, "__file string, __start long"), "__file").withColumn(ROW, F.col(ROW) + F.col("__start"))
        return cls(moved.select(*df.columns, ROW))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def data(self) -> DataFrame:
        """The DataFrame without the row number."""
        return self.df.drop(ROW)

    def numbered(self) -> Table:
        """The same table with row numbers 0, 1, ... in its order."""
        return Table(numbered(self.df), self.keywords, self.name)

    def nrow(self) -> int:
        return self.df.count()

    def column(self, name: str) -> DataFrame:
        return self.df.select(name)

    def getcell(self, name: str, row: int):
        """One cell; row counts from 0."""
        found = self.df.where(F.col(ROW) == row).select(name).first()
        if found is None:
            raise IndexError(f"no row {row}")
        return found[0]

    def rawblock(self, name: str):
        """All cells of a column as one numpy array, rows last."""
        import numpy as np

        rows = self.df.select(ROW, name).toArrow().sort_by(ROW)
        return np.moveaxis(np.array(rows[name].to_pylist()), 0, -1)

    def columndesc(self, name: str) -> dict:
        f = self.df.schema[name]
        return {"type": f.dataType.simpleString(), "keywords": self.keywords.get("columns", {}).get(name, {}), **f.metadata}


def numbered(df: DataFrame) -> DataFrame:
    """df with contiguous row numbers in the order of its partitions: the sizes of partitions are counted first."""
    df = _kept(df)
    base = df.drop(ROW).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    sizes = base.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).collect()  # a row for each partition
    start, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["__part"]):
        offsets.append((r["__part"], start - r["first"]))
        start += r["n"]
    if not offsets:
        return df.drop(ROW).withColumn(ROW, F.lit(0).cast("bigint"))
    moves = _offsets(df.sparkSession, offsets, "__part int, __move long")
    columns = [c for c in df.columns if c != ROW]
    return base.join(moves, "__part").withColumn(ROW, F.col("__at") + F.col("__move")).select(*columns, ROW)


def _kept(df: DataFrame) -> DataFrame:
    """df, so that every job sees the same rows in the same partitions.

    What a shuffle gives may be cut into other partitions in each job: their bounds are sampled, and small ones are
    put together by the size of the columns that the job asks for.  So that is written first.
    """
    if not re.search(r"(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df
    shared = df.sparkSession.sparkContext.getCheckpointDir() is not None
    return df.checkpoint() if shared else df.localCheckpoint()


#: Offsets that are sent to every executor; more are joined by a shuffle.
MOST_OFFSETS = 1_000_000


def _offsets(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MOST_OFFSETS else df
