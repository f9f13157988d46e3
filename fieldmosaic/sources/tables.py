"""Readers for the survey's file formats, and results kept as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv2(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolons between fields, commas in numbers. Fields that aren't numbers, those with separators of thousands ("1.234,5") too, are null where schema asks for numbers."""
    want = T._parse_datatype_string(schema)
    text = spark.read.csv(path, sep=";", header=True, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in want]))
    number = lambda f: F.expr(f"try_cast(replace(`{f.name}`, ',', '.') AS {f.dataType.simpleString()})").alias(f.name)
    return text.select(*[number(f) if isinstance(f.dataType, T.NumericType) else F.col(f.name).cast(f.dataType) for f in want])


def read_int16_grid(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Cells (r, c, v) of a raw little-endian 16-bit grid. A record is a row of the grid, so a large file is split between tasks."""
    rows = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(2 * columns)},
    ).map(lambda x: (x[0], bytes(x[1])))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, data in zip(b["r"], b["data"], strict=True):
                yield pd.DataFrame({"r": r, "c": np.arange(columns, dtype=np.int64), "v": np.frombuffer(data, "<i2").astype(np.int32)})

    return spark.createDataFrame(rows, "r long, data binary").mapInPandas(cells, "r long, c long, v int")


def cache_or_compute(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; made and written first where there is none.

    It is written beside the path and then renamed, so a reader never sees half of it; of two callers at the same time both make it, the first one's stays and is
    what both return.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df = make()
    own = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(own)
    to, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, own))
    store = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(to) or not store.rename(at, to):
        store.delete(at, True)
    inner = spark._jvm.org.apache.hadoop.fs.Path(to, at.getName())  # where the path came to be just before the rename
    if store.exists(inner):
        store.delete(inner, True)
    return spark.read.schema(df.schema).parquet(path)


def symmetric_links(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """A graph's links (src, dst) both ways round, once each, without loops and nulls."""
    held = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return held.unionByName(held.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph kept as links; raises where one lacks its other way round or is a loop."""
    links = spark.read.parquet(path).select("src", "dst")
    lone = links.join(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").unionByName(links.where("src = dst"))
    if lone.limit(1).count():
        raise ValueError(f"links at {path} aren't symmetric or have loops")
    return links


def write_graph(links: DataFrame, path: str) -> None:
    symmetric_links(links).write.mode("overwrite").parquet(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Raster cells (layer, r, c, v), a folder for each layer."""
    cells.select("layer", "r", "c", "v").write.mode("overwrite").partitionBy("layer").parquet(path)


def write_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("model", "fold")) -> None:
    """Results in a folder for each model and fold, so that one fold's are written and read alone."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
