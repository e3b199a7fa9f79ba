"""Raw JSONL logs with pointers to every line.

Logs are listed first and read in ranges of RANGE bytes, so a log of any size is read by many tasks and none holds more than some
lines of it. Files are opened by pyarrow's file systems: local paths, hdfs, s3 and gs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NotFoundError
from ..schema import ENVELOPE, envelope_faults

#: Bytes of a log that one row of work stands for, and bytes read at once.
RANGE, BLOCK = 64 << 20, 1 << 20

LISTED = "raw_file string, size long, modified timestamp"
LINES = "raw_file string, raw_line long, raw_offset long, line string, complete boolean"


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw_file, size, modified) of the files that paths and patterns name; contents are not read."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select(F.col("path").alias("raw_file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def opened(path: str):
    """A file to read at any place."""
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem().open_input_file(local)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _starts(f, a: int, b: int) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, ended) of the lines that start in [a, b); a line starts at 0 or after a newline."""
    at = max(a - 1, 0)
    f.seek(at)
    held, skip, size = b"", a > 0, f.size()
    while at < size:
        if at >= b and not held:
            return
        block = f.read(BLOCK)
        if not block:
            break
        data, start = held + block, at - len(held)
        at += len(block)
        *lines, held = data.split(b"\n")
        for line in lines:
            if skip:
                skip = False
            elif start >= b:
                return
            else:
                yield start, line, True
            start += len(line) + 1
        if skip:  # still inside the line of the range before
            held, skip = b"", True
            if at > b:
                return
        elif at - len(held) >= b:
            return
    if held and not skip and at - len(held) < b:
        yield at - len(held), held, False


def _spread(rows: DataFrame) -> DataFrame:
    """Ranges dealt over tasks in turn. Their number is given: rows that are so small would else be taken for the work of one task. A shuffle by
    columns is left out behind a join on them, whose few rows come in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for path, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            with opened(path) as f:
                n.append(sum(1 for _ in _starts(f, a, b)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], ["raw_file", "a", "b", "n"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["raw_file", "raw_line", "raw_offset", "line", "complete"])

    for batch in batches:
        for path, a, b, before in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows, held = [], 0
            with opened(path) as f:
                for i, (start, line, ended) in enumerate(_starts(f, a, b)):
                    rows.append((path, before + i + 1, start, line.decode("utf-8", "replace"), ended))
                    held += len(line) + 64
                    if held > 4 * BLOCK:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)


def lines_from(files: DataFrame) -> DataFrame:
    """Lines of (raw_file, size, resume_offset, last_line): those from resume_offset on, numbered after last_line. Only files of more than
    one range are read twice, once to count the lines before each range."""
    step = F.sequence(F.col("resume_offset"), F.greatest("resume_offset", F.col("size") - 1), F.lit(RANGE).cast("long"))
    ranges = files.where("size > resume_offset").select("raw_file", "size", "last_line", F.posexplode(step).alias("k", "a"))
    ranges = ranges.withColumn("b", F.least(F.col("a") + RANGE, F.col("size"))).withColumn("many", F.col("size") > F.col("a") - F.col("k") * RANGE + RANGE)
    spread = _spread(ranges)
    counted = spread.where("many").select("raw_file", "a", "b").mapInArrow(_counted, "raw_file string, a long, b long, n long")
    w = Window.partitionBy("raw_file").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    upto = counted.select("raw_file", "a", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("upto"))
    first = ranges.join(upto, ["raw_file", "a"], "left").select("raw_file", "a", "b", (F.col("last_line") + F.coalesce("upto", F.lit(0))).cast("long").alias("before"))
    return _spread(first).mapInArrow(_read, LINES).where("complete or line <> ''")


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw_file, raw_line from 1, raw_offset in bytes, line, complete). Only lines that end in a newline are complete, so a line that is
    being written is seen but not consumed."""
    return lines_from(listing(spark, *paths).withColumns({"resume_offset": F.lit(0).cast("long"), "last_line": F.lit(0).cast("long")}))


def lines_before(files: DataFrame) -> DataFrame:
    """(raw_file, n): how many lines start before the place `upto` of each file, counted by ranges."""
    step = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("upto") - 1, F.lit(0)), F.lit(RANGE).cast("long"))
    ranges = files.select("raw_file", "upto", F.explode(step).alias("a")).select("raw_file", "a", F.least(F.col("a") + RANGE, F.col("upto")).alias("b"))
    return _spread(ranges).mapInArrow(_counted, "raw_file string, a long, b long, n long").groupBy("raw_file").agg(F.sum("n").alias("n"))


def folder_tool(path: "F.Column") -> "F.Column":
    """The tool in whose folder a log lies."""
    return F.regexp_extract(path, "/raw/([^/]+)/[^/]+$", 1)


def line_hash(line: bytes) -> str:
    return hashlib.sha256(line.rstrip()).hexdigest()


def _still_there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for path, a, b, known in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            with opened(path) as f:
                f.seek(max(a - 1, 0))
                raw = f.read(b - max(a - 1, 0))
            before, line = (raw[:1], raw[1:]) if a else (b"\n", raw)
            same.append(before == b"\n" and line.endswith(b"\n") and len(line) == b - a and line_hash(line[:-1]) == known)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], ["raw_file", "same"])


def still_there(files: DataFrame) -> DataFrame:
    """(raw_file, same) of (raw_file, last_offset, byte_offset, last_line_hash): whether the line known last still stands where it did."""
    return files.select("raw_file", "last_offset", "byte_offset", "last_line_hash").mapInArrow(_still_there, "raw_file string, same boolean")


def same_file(column: "F.Column", name: str) -> "F.Column":
    """Whether a path is that file: the whole path, or its end after a slash where the name is relative."""
    plain = F.regexp_replace(column, "^file:/+", "/")
    wanted = name if "://" in name else "/" + name.removeprefix("file:").lstrip("/") if name.startswith(("/", "file:")) else name
    if wanted.startswith("/") or "://" in wanted:
        return (plain == wanted) | (column == wanted)
    return (plain == wanted) | plain.endswith("/" + wanted)


def scan_home(spark: SparkSession, home: str) -> DataFrame:
    """Lines of every tool's log below home/raw, with the tool from the path."""
    found = lines(spark, f"{home}/raw/*/*.jsonl")
    return found.withColumn("folder_tool", F.regexp_extract("raw_file", "/raw/([^/]+)/[^/]+$", 1))


def envelopes(found: DataFrame) -> DataFrame:
    """Parsed envelopes with `fault`: why a line is none, or null. The envelope's own offset wins over the scanned one."""
    # a filter on the fault is not moved below an explode, where it would parse the line again for each column that it names
    rows = found.where(F.trim("line") != "").select("*", F.explode(F.array(F.from_json("line", ENVELOPE))).alias("e"))
    own = [c for c in ENVELOPE.names if c not in ("raw_file", "raw_offset")]
    flat = rows.select("raw_file", "raw_line", F.coalesce("e.raw_offset", "raw_offset").alias("raw_offset"), *(F.col(f"e.{c}").alias(c) for c in own), *(c for c in found.columns if c in ("folder_tool", "line")))
    out = envelope_faults(flat)
    if "folder_tool" in found.columns:
        out = out.withColumn("fault", F.coalesce("fault", F.when(F.col("tool") != F.col("folder_tool"), "tool folder")))
    return out


def line_at(found: DataFrame, raw_file: str, raw_line: int | None = None, raw_offset: int | None = None) -> DataFrame:
    """The line that a pointer names. The offset must agree with the line's own; where it does not, the line number decides."""
    own = found.where(same_file(F.col("raw_file"), raw_file))
    if raw_offset is not None:
        by_offset = own.where((F.col("raw_offset") == raw_offset) & (F.lit(True) if raw_line is None else F.col("raw_line") == raw_line))
        if raw_line is None or not by_offset.isEmpty():
            return by_offset
    return own.where(F.col("raw_line") == raw_line)


def session_file(sessions: DataFrame, tool: str, session_id: str) -> str:
    row = sessions.where((F.col("tool") == tool) & (F.col("session_id") == session_id)).select("raw_file").head()
    if row is None:
        raise NotFoundError(f"no session {session_id} of {tool}")
    return row.raw_file


def raw_path(home: str, tool: str, session_id: str) -> str:
    return f"{home}/raw/{tool}/{tool}_{re.sub('[^A-Za-z0-9._-]', '_', session_id) or '_'}.jsonl"
