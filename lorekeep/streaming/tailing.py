"""A streaming source of growing logs, and a store kept up by it.

The source `growing_logs` lists a home's logs and finds for each how far its complete lines reach and what became of it: a log goes on where
the line consumed last still stands, else it was truncated or rotated and is read from the top. What it finds is noted as a numbered version in
the folder `positions`, only of logs that changed, and the number is the offset that Spark keeps. The driver reads of a log its last line and
the block that its new end lies in; bytes between two versions are read by tasks in ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators import document
from ..paths import staged
from ..sources import raw
from .incremental import Store, discontinuities, path_session

#: Versions after which all positions are written down together.
SNAPSHOT = 64
#: Seconds that a batch waits for the store's lock.
WAIT = 600

SCHEMA = "raw_file string, version long, range_start long, nth long, raw_offset long, line string, state string, previous long, size long"
_ARROW = pa.schema([(c, pa.string() if c in ("raw_file", "line", "state") else pa.int64()) for c in (x.split()[0] for x in SCHEMA.split(", "))])


class Range(InputPartition):
    def __init__(self, value: tuple):
        self.value = value


def _newline_before(f, upto: int, least: int) -> int:
    """The place behind the last newline in [least, upto), or least."""
    while upto > least:
        at = max(least, upto - raw.BLOCK)
        f.seek(at)
        k = f.read(upto - at).rfind(b"\n")
        if k >= 0:
            return at + k + 1
        upto = at
    return least


def _newline_after(f, at: int, size: int) -> int:
    """The place behind the first newline at or after a place, or that place."""
    f.seek(at)
    went = at
    while went < size:
        block = f.read(min(raw.BLOCK, size - went))
        if not block:
            break
        k = block.find(b"\n")
        if k >= 0:
            return went + k + 1
        went += len(block)
    return at


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.positions = options["path"].rstrip("/"), options["positions"].rstrip("/")
        self.most = int(options.get("maxBytesPerTrigger", 1 << 62))
        self.range = int(options.get("rangeBytes", raw.RANGE))
        self.version: int | None = None
        self.known: dict[str, dict] = {}

    # versions

    def _folder(self, path: str):
        from pyarrow import fs

        local = re.sub("^file:/+", "/", path)
        return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)

    def _load(self) -> None:
        from pyarrow import fs

        system, inner = self._folder(self.positions)
        system.create_dir(inner, recursive=True)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(inner))]
        changes, whole = (sorted(int(n.split(".")[0]) for n in names if n.endswith(e)) for e in (".changes", ".all"))
        self.version, self.known = 0, {}
        if whole:
            self.version = whole[-1]
            self.known = {r["file"]: r for r in self._lines(f"{whole[-1]}.all")}
        for v in changes:
            if v > self.version:
                self._apply(self._lines(f"{v}.changes"))
                self.version = v

    def _lines(self, name: str) -> list[dict]:
        system, inner = self._folder(self.positions)
        with system.open_input_stream(f"{inner}/{name}") as f:
            return [json.loads(x) for x in f.read().splitlines()]

    def _note(self, name: str, rows: list[dict]) -> None:
        """Seen whole or not at all: written aside and moved."""
        system, inner = self._folder(self.positions)
        with system.open_output_stream(f"{inner}/{name}.part") as f:
            f.write("\n".join(json.dumps(r) for r in rows).encode())
        system.move(f"{inner}/{name}.part", f"{inner}/{name}")

    def _apply(self, rows: list[dict]) -> None:
        for r in rows:
            if r["state"] == "deleted":
                self.known.pop(r["file"], None)
            else:
                self.known[r["file"]] = r

    # what became of the logs

    def _look(self) -> list[dict]:
        from pyarrow import fs

        system, inner = self._folder(self.root)
        listed = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
        logs = {self.root + i.path[len(inner.rstrip("/")) :]: i for i in listed if i.is_file and re.fullmatch(r"/[^/]+/[^/]+\.jsonl", i.path[len(inner.rstrip("/")) :])}
        left, out = self.most, []
        for name in sorted(logs):
            info, old = logs[name], self.known.get(name)
            stamp = [info.size, info.mtime_ns]
            if old and old["stamp"] == stamp:
                continue
            with raw.opened(name) as f:
                size, start, state = f.size(), old["to"] if old else 0, None
                if old and start > size:
                    state = "truncated"
                elif old and start and not self._stands(f, old):
                    state = "rotated"
                begin = 0 if state else start
                end, limited = begin, begin + left < size
                if left > 0 and begin < size:
                    end = _newline_before(f, min(size, begin + left), begin)
                    if end == begin and limited:  # a line longer than what is left goes whole
                        end = _newline_after(f, begin + left, size)
                        end = begin if end == begin + left else end
                if end == begin and not state:
                    continue
                last = _newline_before(f, end - 1, begin) if end > begin else 0
                f.seek(last)
                digest = raw.line_hash(f.read(end - 1 - last)) if end > begin else ""
            left -= end - begin
            out.append({"file": name, "from": begin, "to": end, "last": last, "hash": digest, "state": state, "previous": start, "size": size, "stamp": None if limited else stamp})
        for name in sorted(set(self.known) - set(logs)):
            out.append({"file": name, "from": 0, "to": 0, "state": "deleted", "previous": self.known[name]["to"], "size": 0})
        return out

    def _stands(self, f, old: dict) -> bool:
        f.seek(max(old["last"] - 1, 0))
        data = f.read(old["to"] - max(old["last"] - 1, 0))
        before, line = (data[:1], data[1:]) if old["last"] else (b"\n", data)
        return before == b"\n" and line.endswith(b"\n") and raw.line_hash(line[:-1]) == old["hash"]

    # what Spark asks

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        if self.version is None:
            self._load()
        changes = self._look()
        if changes:
            self._note(f"{self.version + 1}.changes", changes)
            self.version += 1
            self._apply(changes)
            if self.version % SNAPSHOT == 0:
                self._note(f"{self.version}.all", list(self.known.values()))
        return {"version": self.version}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for v in range(start["version"] + 1, end["version"] + 1):
            for c in self._lines(f"{v}.changes"):
                if c["state"]:
                    out.append(Range((c["file"], v, 0, 0, c["state"], c["previous"], c["size"])))
                out += [Range((c["file"], v, a, min(a + self.range, c["to"]), None, None, None)) for a in range(c["from"], c["to"], self.range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path, version, a, b, state, previous, size = partition.value
        if state:
            yield pa.RecordBatch.from_pylist([{"raw_file": path, "version": version, "state": state, "previous": previous, "size": size}], _ARROW)
            return
        rows, held = [], 0
        try:
            f = raw.opened(path)
        except FileNotFoundError:  # went since it was listed; the next version says so
            return
        with f:
            for i, (at, line, ended) in enumerate(raw._starts(f, a, b)):
                if ended:
                    rows.append({"raw_file": path, "version": version, "range_start": a, "nth": i, "raw_offset": at, "line": line.decode("utf-8", "replace")})
                    held += len(line) + 64
                if held > 4 * raw.BLOCK:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class GrowingLogs(DataSource):
    """Options: path (the folder with a folder of logs for each tool), positions, maxBytesPerTrigger, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:  # noqa: ARG002
        return LogReader(dict(self.options))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names its files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_logs(spark: SparkSession, home: str, positions: str, most: int | None = None, range_bytes: int | None = None) -> DataFrame:
    """A stream of SCHEMA: lines with their place in a range, and a row with a state for each log that was truncated, rotated or deleted."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("path", qualified(spark, f"{home}/raw")).option("positions", qualified(spark, positions))
    for name, value in (("maxBytesPerTrigger", most), ("rangeBytes", range_bytes)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def numbered(lines: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Lines of a batch with raw_line. Lines of each range are counted; a log that goes on adds what its checkpoint counted, or, where the
    checkpoint stands elsewhere (a batch that is run again), the lines before it counted anew."""
    counted = lines.groupBy("raw_file", "version", "range_start").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("raw_file").orderBy("version", "range_start")
    counted = counted.withColumn("turn", F.sum((F.col("range_start") == 0).cast("int")).over(order))
    before = Window.partitionBy("raw_file", "turn").orderBy("version", "range_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(counted.withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranges")
    starts = placed.where("turn = 0").groupBy("raw_file").agg(F.min("range_start").alias("start"))
    known = checkpoints.select(F.col("source_path").alias("raw_file"), F.col("byte_offset").alias("start"), F.coalesce("last_line", F.lit(0)).alias("base"))
    told = starts.join(known, ["raw_file", "start"])
    recounted = raw.lines_before(starts.join(known, ["raw_file", "start"], "left_anti").withColumnRenamed("start", "upto"))
    bases = told.select("raw_file", F.lit(0).cast("long").alias("turn"), "base").unionByName(recounted.select("raw_file", F.lit(0).cast("long").alias("turn"), F.col("n").alias("base")))
    ranges = placed.join(bases, ["raw_file", "turn"], "left").select("raw_file", "version", "range_start", "turn", (F.col("upto") + F.coalesce("base", F.lit(0))).alias("before"))
    return lines.join(ranges, ["raw_file", "version", "range_start"]).withColumn("raw_line", F.col("before") + F.col("nth") + 1)


def consume(batch: DataFrame, store: Store) -> int:
    """One batch of read_logs() into a store: new events, discontinuities, checkpoints. The same batch twice adds nothing. How many events."""
    rows = staged(batch, "tailed")
    with store.lock(WAIT):
        checkpoints = store.checkpoints()
        lines = staged(numbered(rows.where("state is null"), checkpoints), "numbered")
        found = lines.select("raw_file", "raw_line", "raw_offset", "line", F.lit(True).alias("complete"), raw.folder_tool(F.col("raw_file")).alias("folder_tool"))
        good = raw.envelopes(found).where("fault is null").drop("fault", "line", "folder_tool")
        events = document.with_documents(good.withColumnRenamed("dedupe_key", "__key")).withColumn("dedupe_key", F.coalesce("__key", "dedupe_key")).drop("__key")
        broken = rows.where("state is not null").select("raw_file", path_session("raw_file").alias("known_session"), F.col("previous").alias("byte_offset"), "size", "state")
        gone = broken.where("state = 'deleted'").select(F.col("raw_file").alias("source_path"), F.col("known_session").alias("session_id"), "byte_offset")
        added = store.append(events.unionByName(document.with_documents(discontinuities(broken, gone)), allowMissingColumns=True))
        place = F.struct("version", "raw_offset")
        last = lines.groupBy("raw_file").agg(F.max_by(F.struct("version", "raw_line", "raw_offset", F.sha2(F.rtrim("line"), 256).alias("h"), (F.col("raw_offset") + F.octet_length("line") + 1).alias("end")), place).alias("l"))
        fell = rows.where("state is not null").groupBy("raw_file").agg(F.max_by(F.struct("version", "state"), "version").alias("s"))
        now = last.join(fell, "raw_file", "full")
        fresh = now.where("s is null or l.version >= s.version or s.state <> 'deleted'").withColumn("l", F.when(F.col("s").isNull() | (F.col("l.version") >= F.col("s.version")), F.col("l")))
        own = fresh.select(
            raw.folder_tool(F.col("raw_file")).alias("tool"), F.lit("raw_jsonl").alias("source_kind"), F.col("raw_file").alias("source_path"), path_session("raw_file").alias("session_id"), F.coalesce("l.end", F.lit(0)).cast("long").alias("byte_offset"),
            F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("timestamp").alias("source_mtime"), F.coalesce("l.raw_line", F.lit(0)).cast("long").alias("last_line"), F.col("l.raw_offset").alias("last_offset"),
            F.col("l.h").alias("last_line_hash"), F.current_timestamp().alias("imported_at"),
        )
        rest = checkpoints.join(now.select(F.col("raw_file").alias("source_path")), "source_path", "left_anti")
        store.checkpoint(rest.unionByName(own))
    return added


def watch(spark: SparkSession, home: str, store: Store, checkpoint: str, once: bool = False, most: int | None = None, range_bytes: int | None = None, seconds: float = 2):
    """The started query of a stream that keeps a store up with the logs of a home; once: what is there now, or `most` bytes of it."""
    rows = read_logs(spark, home, f"{checkpoint}/positions", most, range_bytes)
    writer = rows.writeStream.foreachBatch(lambda batch, _epoch: consume(batch, store) and None).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
