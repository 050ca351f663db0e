"""Sinks.  All writes are distributed (one file set per task), never
through the driver; output folders are parameters (shared storage on a cluster)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CONCURRENT_FILES, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 8


def write_variants(df: DataFrame, path: str, *, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; optionally partitioned by e.g. ``ethnicity`` for partition pruning downstream.

    A task keeps a file open for each of its partition values, up to
    ``OPEN_FILES`` of them, instead of sorting (and spilling) all its rows by
    value; beyond that it sorts.  The variants of a case are next to each
    other in a file and differ in a few words, which zstd stores once.
    """
    w = df.write.mode(mode).option("compression", "zstd")
    if not partition_by:
        w.parquet(path)
        return
    conf = df.sparkSession.conf
    before = conf.get(CONCURRENT_FILES)
    conf.set(CONCURRENT_FILES, str(max(OPEN_FILES, int(before))))
    try:
        w.partitionBy(partition_by).parquet(path)
    finally:
        conf.set(CONCURRENT_FILES, before)


def write_raw_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; quoted multi-line fields."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_raw_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5's layout: a JSON array a file (NULL fields written), one object a line."""
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        import pyarrow as pa
        before = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(before if i == 0 else ",") + x for i, x in enumerate(lines)], pa.string())], names=["value"])
            before = "," if lines else before
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    rows.mapInArrow(run, "value string").write.mode(mode).text(path)


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_results(results: dict, path: str, mode: str = "overwrite") -> None:
    """Every metric DataFrame of an evaluation bundle as JSON under ``path/<metric>/`` (NaN -> null)."""
    for name, df in results.items():
        if isinstance(df, DataFrame):
            _nan_to_null(df).write.mode(mode).json(f"{path}/{name}")


def results_document(results: dict) -> DataFrame:
    """S8 (one document): a row ``(metric, value)`` per result row, the value as JSON (NaN -> null).

    Bounded tables and per-case series go side by side, each written by the
    tasks that computed it.
    """
    parts = [_nan_to_null(df).select(F.lit(name).alias("metric"), F.to_json(F.struct(*df.columns)).alias("value"))
             for name, df in results.items() if isinstance(df, DataFrame)]
    return reduce(DataFrame.unionAll, parts)
