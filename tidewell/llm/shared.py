"""Tables and folders that every executor can see."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import shared_folder


class Scratch:
    """Written tables that cut lineage. drop() removes them when no returned frame reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Removes all tables but the named ones, which a returned frame still reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(root):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)

    def drop(self, *names: str) -> None:
        """Removes the named tables, or everything. What a returned frame reads stays until its user drops the scratch folders
        of a finished job (they lie under spark.checkpoint.dir, named after their operator)."""
        for place in [self.path(n) for n in names] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others. Spark's names ignore case; of columns that differ in case alone the one that is
    written exactly so is taken, else the first."""
    have = df.columns
    at = {n: have.index(n) if n in have else [c.lower() for c in have].index(n.lower()) for n in names}
    return df.toDF(*[f"_{k}" for k in range(len(have))]).select(*[F.col(f"_{k}").alias(n) for n, k in at.items()])


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], tuple[list, ...]]], schema: str, rows: int = 2000) -> DataFrame:
    """doc_id (as a long) beside the columns of `schema` that make()(texts) gives for the texts of at most `rows` rows.
    Ids pass by as Arrow columns, so nulls among them change nothing; no other column goes to Python; no shuffle."""
    arrow = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                some = batch.slice(i, rows)
                made = of(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(v, f.type) for v, f in zip(made, list(arrow)[1:], strict=True)]], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {schema}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
