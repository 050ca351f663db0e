"""Multi-line CSV and JSON arrays read in byte ranges: many tasks for one large file.

Spark's text source deals a file out as byte ranges and gives every piece (a
line; for JSON what stands before a closing brace) to exactly one of them, in
order, on any file system that Spark reads.  What a range can't know is
whether it starts inside a quoted field or an object.  Three steps settle it:

1. Every range reports how it changes the state: the parity of its quotes
   and, for JSON, its change of depth both if it starts outside and if it
   starts inside a string.  That is one row a range.
2. A prefix scan over the ranges of a file (window sums over these rows)
   gives each range the state it starts in.
3. Every range cuts its pieces into records.  Records that lie in one range
   are done; a record that crosses ranges comes out as a tail, middles and a
   head, and these few fragments are put together by a second prefix scan.

The driver holds one entry for each range that starts inside a record (at
most one for ``spark.sql.files.maxPartitionBytes`` of input), which goes to
the tasks.  Records are parsed by Spark's ``from_csv`` and ``from_json``.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD, HEAD, TAIL, MIDDLE = range(4)
ESCAPED = re.compile(r"\\.", re.S)
State = tuple[int, int]  # inside quotes (0 or 1), depth


def _pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """``file, start, text``: the pieces between separators, with the byte range that they were read by."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").alias("text"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array, bool]]:
    """((file, start), texts, whether these begin the range) for runs of rows of one range."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0]
        for column in (batch.column(0), batch.column(1)):
            if batch.num_rows > 1:
                changed = pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)))
                cuts += [i + 1 for i in changed.to_pylist()]
        cuts = sorted({*cuts, batch.num_rows})
        for a, b in zip(cuts, cuts[1:]):
            key = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            yield key, batch.column(2).slice(a, b - a), key != last
            last = key


# ------------------------------------------------------------- formats ----

class Csv:
    """Records end at a line end outside quotes; a doubled quote counts twice and changes nothing."""

    separator = "\n"

    @staticmethod
    def change(texts: pa.Array) -> tuple[int, int, int]:
        """(parity of the quotes, change of depth from outside, from inside a string)."""
        return int(pc.sum(pc.count_substring(texts, '"')).as_py() or 0) % 2, 0, 0

    @staticmethod
    def records(texts: pa.Array, state: State) -> Iterator[tuple[str, State, bool]]:
        """(piece, state behind it, whether a record ends with it)."""
        inside = state[0]
        for text, quotes in zip(texts.to_pylist(), pc.count_substring(texts, '"').to_pylist()):
            inside = (inside + quotes) % 2
            yield text, (inside, 0), not inside

    @staticmethod
    def between(state: State) -> bool:
        return not state[0]

    glue = "\n"

    @staticmethod
    def cleaned(record: str) -> str:
        return record[:-1] if record.endswith("\r") else record


class JsonArray:
    """Records are the objects at depth 1 of an array; every piece lost its closing brace to the separator."""

    separator = "}"

    @staticmethod
    def _scan(text: str, inside: int) -> tuple[int, int]:
        """(state of quotes, change of depth) behind the piece and its brace."""
        parts = ESCAPED.sub("", text).split('"')
        outside = "".join(parts[inside::2])
        depth = outside.count("{") + outside.count("[") - outside.count("]")
        inside = (inside + len(parts) - 1) % 2
        return inside, depth - (not inside)

    @classmethod
    def change(cls, texts: pa.Array) -> tuple[int, int, int]:
        states, depths = [0, 1], [0, 0]
        for text in texts.to_pylist():
            for k in (0, 1):
                states[k], d = cls._scan(text, states[k])
                depths[k] += d
        return states[0], *depths

    @classmethod
    def records(cls, texts: pa.Array, state: State) -> Iterator[tuple[str, State, bool]]:
        inside, depth = state
        for text in texts.to_pylist():
            fresh = not inside and depth <= 1
            inside, d = cls._scan(text, inside)
            depth += d
            if fresh:  # what stands before an object: the array's bracket, commas, blanks
                text = text[text.find("{"):] if "{" in text else ""
            done = not inside and depth == 1 and not (fresh and not text)
            yield text + "}" if text or not fresh else "", (inside, depth), done

    @staticmethod
    def between(state: State) -> bool:
        return not state[0] and state[1] <= 1

    glue = ""

    @staticmethod
    def cleaned(record: str) -> str:
        return record


# --------------------------------------------------------------- passes ----

def range_states(pieces: DataFrame, form) -> DataFrame:
    """``file, start, inside, depth``: the state each range starts in, by a prefix scan over the ranges of a file."""
    schema = "file string, start bigint, flips int, plain int, quoted int"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), texts, _ in _by_range(batches):
            row = [[file], [start], *([x] for x in form.change(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (
                pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["file", "start", "flips", "plain", "quoted"])

    # A range may report several times, once a batch: batches count as ranges of their own, in reading order.
    order = Window.partitionBy("file").orderBy("start", "batch").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.mapInArrow(report, schema).withColumn("batch", F.monotonically_increasing_id())
    inside = F.coalesce(F.sum("flips").over(order), F.lit(0)) % 2
    depth = F.coalesce(F.sum("delta").over(order), F.lit(0))
    return (parts.withColumn("inside", inside).withColumn("delta", F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain")))
            .withColumn("depth", depth).groupBy("file", "start")
            .agg(F.min_by(F.struct("inside", "depth"), "batch").alias("s")).select("file", "start", "s.inside", "s.depth"))


def _cut(pieces: DataFrame, form, states: dict) -> DataFrame:
    """``file, start, kind, first, text``: records and fragments of all ranges; ``first``: it opens its file."""
    content = pieces.sparkSession.sparkContext.broadcast(states)
    fields = [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held, headless, rows = None, (0, 0), [], False, []

        def close(kind: int) -> None:
            text = form.glue.join(held)
            rows.append((*key[:2], kind, key[2], form.cleaned(text) if kind == RECORD else text))
            held.clear()

        def finish() -> None:
            if key is not None and held:
                close(MIDDLE if headless else TAIL)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])
            rows.clear()
            return out

        for own, texts, fresh in _by_range(batches):
            if fresh:
                finish()
                state = content.value.get(own, (0, 1) if own[1] else (0, 0)) if form is JsonArray else content.value.get(own, (0, 0))
                key, headless = [*own, own[1] == 0], not form.between(state)
            for text, state, ends in form.records(texts, state):
                if held or text or headless:
                    held.append(text)
                if ends:
                    close(HEAD if headless else RECORD)
                    headless, key[2] = False, False
            if rows:
                yield batch()
        finish()
        if rows:
            yield batch()

    return pieces.mapInArrow(run, "file string, start bigint, kind int, first boolean, text string")


def records(spark: SparkSession, path, form) -> DataFrame:
    """``file, first, text`` of every record of the files at ``path``; the first pass over the file runs at once."""
    pieces = _pieces(spark, path, form.separator)
    known = range_states(pieces, form).where(
        F.col("inside").cast("boolean") | (F.col("depth") > (1 if form is JsonArray else 0)))
    states = {(r["file"], r["start"]): (r["inside"], r["depth"]) for r in known.toLocalIterator()}
    rows = _cut(pieces, form, states)
    whole = rows.where(F.col("kind") == RECORD).select("file", "first", "text")
    if not states:
        return whole.unionByName(rows.where(F.col("kind") == TAIL).select("file", "first", "text"))  # an unfinished last record
    opens = (F.col("kind") == TAIL).cast("int")
    order = Window.partitionBy("file").orderBy("start", opens)
    chained = rows.where(F.col("kind") != RECORD).withColumn("chain", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chained.groupBy("file", "chain").agg(
        F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", opens.alias("opens"), "text"))).alias("parts"))
    text = F.array_join(F.col("parts.text"), form.glue)
    if form is Csv:
        text = F.regexp_replace(text, "\r$", "")
    return whole.unionByName(joined.select("file", "first", text.alias("text")))


# -------------------------------------------------------------- readers ----

CSV_OPTIONS = {"escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    """CSV with a header and quoted multi-line fields; columns by position, as declared in ``schema``.

    Without a schema the names come from the header and the types (bigint,
    double, boolean, string) from one aggregate over all values.
    """
    rows = records(spark, path, Csv)
    body = rows.where(~F.col("first") & (F.length("text") > 0))
    if schema is not None:
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return body.select(F.from_csv("text", ddl, CSV_OPTIONS).alias("r")).select("r.*")
    head = rows.where("first").select("text").first()
    if head is None:
        raise ValueError(f"no header in {path!r}")
    names = next(csv.reader([head["text"]]))
    parsed = body.select(F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), CSV_OPTIONS).alias("r"))
    cols = [F.col(f"r.c{i}") for i in range(len(names))]
    kinds = [("bigint", lambda c: c.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")),
             ("double", lambda c: c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")),
             ("boolean", lambda c: F.lower(F.trim(c)).isin("true", "false"))]
    found = parsed.agg(*[F.bool_and(fits(c)).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, fits in kinds]).first()
    kind = [next((k for k, _ in kinds if found[f"{k}_{i}"]), "string") for i in range(len(names))]
    return parsed.select([(c if k == "string" else F.trim(c).cast(k)).alias(n) for c, k, n in zip(cols, kind, names)])


def read_json_array(spark: SparkSession, path, schema) -> DataFrame:
    """The objects of JSON arrays, one array a file."""
    rows = records(spark, path, JsonArray).where(F.length("text") > 0)
    return rows.select(F.from_json("text", schema).alias("r")).select("r.*")
