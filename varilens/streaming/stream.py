"""Structured Streaming use of the operators on arriving files.

* Narrow operators (mapping, the ethnicity filter, the variant expansion) run
  unchanged on a stream: ``stream_variants``.
* The answer cube behind A1 and A2 is a stateful aggregate in update mode:
  ``stream_answer_cube`` keeps its counts in the state store and writes the
  cells that a batch changed; ``read_cube`` takes the latest row of each cell.
* V1-V6 check every arriving row: ``stream_validated`` splits a batch into
  valid rows and a quarantine table with reasons.

Sinks are folders by batch id, replaced as a whole, so a batch that is run
again after a failure changes nothing.  Multi-level metrics (disparity,
SkewSize, medians, pair metrics) stay batch jobs over the written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators import answers as A
from ..operators import quality as Q
from ..operators import variants as V
from ..session import ensure_checkpoint_dir

BATCH = "batch"


def _started(writer: DataStreamWriter, spark: SparkSession, name: str, checkpoint: str | None, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint or f"{ensure_checkpoint_dir(spark)}/{name}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _arriving(spark: SparkSession, source_dir: str, schema, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source_dir)


def _replace_batch(df: DataFrame, folder: str, batch: int) -> None:
    """Write the rows of one batch as ``folder/batch=<id>``, in place of what an earlier try left there."""
    df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")


def stream_variants(spark: SparkSession, source_dir: str, sink_dir: str, *, schema, fallback_prepend: bool = False,
                    checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Expand cases arriving as parquet files in ``source_dir`` into variants written to ``sink_dir``."""
    out = V.build_variants(_arriving(spark, source_dir, schema, None), fallback_prepend=fallback_prepend)
    writer = out.writeStream.format("parquet").option("path", sink_dir)
    return _started(writer, spark, "stream_variants", checkpoint, available_now)


def stream_answer_cube(spark: SparkSession, source_dir: str, sink_dir: str, *, schema, llm_col, extra_keys=(),
                       checkpoint: str | None = None, files_per_batch: int | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """A1/A2 on a stream: the answer cube of all files that have arrived so far.

    Counts are kept in the checkpointed state store, one entry a cell, so the
    state is as small as the cube whatever the stream's length and needs no
    watermark.  Update mode hands every batch the cells that it changed, with
    their counts over the whole stream.
    """
    cube = A.answer_cube(_arriving(spark, source_dir, schema, files_per_batch), llm_col, extra_keys)
    writer = cube.writeStream.outputMode("update").foreachBatch(lambda df, batch: _replace_batch(df.coalesce(1), sink_dir, batch))
    return _started(writer, spark, "stream_answer_cube", checkpoint, available_now)


def read_cube(spark: SparkSession, sink_dir: str, extra_keys=()) -> DataFrame:
    """The cube that ``stream_answer_cube`` has written: the latest row of each cell, as ``answers.answer_cube`` gives it."""
    keys = [*A.CUBE_KEYS, *(k for k in extra_keys if k not in A.CUBE_KEYS)]
    rows = spark.read.parquet(sink_dir)
    last = Window.partitionBy(*keys).orderBy(F.col(BATCH).desc())
    return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last", BATCH)


def stream_validated(spark: SparkSession, source_dir: str, valid_dir: str, quarantine_dir: str, *, schema,
                     allow_null_option_d: bool = False, ethnicities=None, checkpoint: str | None = None,
                     files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """V2-V6 on arriving variant files: valid rows to one table, the others with their ``violations`` to another.

    Both are written by batch id, quarantine first; the checkpoint commits a
    batch after both, so a batch interrupted in between is written again in
    full and replaces its parts.
    """
    def split(df: DataFrame, batch: int) -> None:
        judged = df.withColumn("violations", Q.row_violations(df, allow_null_option_d, ethnicities)).persist()
        try:
            _replace_batch(judged.where(F.size("violations") > 0), quarantine_dir, batch)
            _replace_batch(judged.where(F.size("violations") == 0).drop("violations"), valid_dir, batch)
        finally:
            judged.unpersist()

    writer = _arriving(spark, source_dir, schema, files_per_batch).writeStream.foreachBatch(split)
    return _started(writer, spark, "stream_validated", checkpoint, available_now)


def quarantine_report(spark: SparkSession, quarantine_dir: str) -> DataFrame:
    """The quarantine as ``(check, item, n)``, the counts that ``quality.schema_violations`` gives for the whole table."""
    rows = spark.read.parquet(quarantine_dir).select(F.inline("violations"))
    return rows.groupBy("check", "item").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["stream_variants", "stream_answer_cube", "read_cube", "stream_validated", "quarantine_report"]
