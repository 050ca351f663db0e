"""Readers.  Declared schemas where the layout is known; pruning and
pushdown come from the file formats (parquet), not from code here."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import ranges

LINK_INDEX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("link", T.StringType()),
    T.StructField("publication_year", T.StringType()),
    T.StructField("answer_idx", T.StringType()),
    T.StructField("answer", T.StringType()),
])


def load_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S1."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header row, quoted multi-line fields (case texts contain newlines), one large file in many tasks.

    Without a schema numbers and booleans are recognised by one aggregate over all values.
    """
    return ranges.read_csv(spark, path, schema)


def load_snapshot(spark: SparkSession, root: str, dataset: str, config: str | None = None,
                  split: str = "train", schema: T.StructType | None = None) -> DataFrame:
    """A staged dataset snapshot ``root/<dataset>/<config>/<split>/*.parquet`` (no network)."""
    parts = [root, dataset.replace("/", "__")] + ([config] if config else []) + [split]
    return load_parquet(spark, os.path.join(*parts), schema)


def load(spark: SparkSession, source: str, config: str | None = None, split: str = "train", *,
         snapshot_root: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """S3: dispatch on the suffix; a name with another suffix is an error, one without a suffix a snapshot id."""
    low = source.lower()
    if low.endswith(".parquet"):
        return load_parquet(spark, source, schema)
    if low.endswith(".csv"):
        return load_csv(spark, source, schema)
    suffix = os.path.splitext(source)[1]
    if suffix and snapshot_root is None:
        raise ValueError(f"no reader for files named *{suffix}")
    if snapshot_root is None:
        raise ValueError(f"{source!r} has no suffix that names a format, and no snapshot_root was given")
    return load_snapshot(spark, snapshot_root, source, config, split, schema)


def read_link_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of {id, link, publication_year, answer_idx, answer}, one array a file, read in byte ranges."""
    return ranges.read_json_array(spark, path, LINK_INDEX_SCHEMA)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal the rows round-robin over ``partitions`` (a shuffle of the raw rows).

    For a caller that knows its input scans as too few tasks, such as a file
    written as one large row group; nothing calls it on its own account.
    """
    return df.repartition(partitions)
