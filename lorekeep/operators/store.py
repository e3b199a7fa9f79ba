"""The home of a store: its folders, appends to raw logs, keys beside them, purges and health.

All file work goes through the file systems of Hadoop on the driver (names and sizes) and pyarrow on the executors (contents).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import paths
from ..errors import ValidationError
from ..functions import times
from ..schema import ENVELOPE, TOOLS
from ..sources import raw
from ..streaming import incremental
from . import maintain, search
from .index import Index
from .ledger import Ledger

#: What lies in a home, and what losing it means: authoritative cannot be made again, derived can, model and config are set up.
ENTRIES = {"raw": "authoritative", "blobs": "authoritative", "index": "derived", "spool": "derived", "logs": "derived", "backups": "derived", "models": "model", "config.json": "config"}
FOLDERS = (*(f"raw/{t}" for t in TOOLS), "blobs/sha256", "index", "spool/dedupe", "logs", "backups", "models")
WRITTEN = "raw_file string, lines long, bytes long, last_offset long, last_hash string, end long, torn boolean"
#: Seconds that an append or a purge waits for another writer.
WAIT = 60


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _local(path: str) -> bool:
    return path.startswith(("/", "file:"))


class _Tail:
    """The end of a log from `base` on, written by one task. Whatever an earlier attempt has written there is written over by the same bytes;
    a file system that cannot do that gets the log as a new file, moved into place when it is whole."""

    def __init__(self, path: str, base: int, torn: bool):
        self.system, self.inner = _filesystem(path)
        self.lines = self.size = self.last = 0
        self.base, self.torn, self.line = base + torn, torn, b""
        if _local(path):
            self.out = open(self.inner, "r+b" if base else "wb")  # noqa: SIM115
            self.out.seek(base)
        else:
            self.aside = f"{self.inner}.{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(self.aside)
            if base:
                with self.system.open_input_file(self.inner) as old:
                    for at in range(0, base, 1 << 20):
                        self.out.write(old.read(min(1 << 20, base - at)))
        if torn:  # a line that was never ended stays a line of its own
            self.out.write(b"\n")

    def write(self, line: str) -> None:
        body = line.encode() + b"\n"
        self.out.write(body)
        self.last, self.line = self.base + self.size, body
        self.lines, self.size = self.lines + 1, self.size + len(body)

    def close(self) -> None:
        if hasattr(self, "aside"):
            self.out.close()
            self.system.move(self.aside, self.inner)
        else:
            self.out.truncate()
            self.out.close()


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of file go to the end of their files."""
    tail, now = None, None

    def close() -> pa.RecordBatch:
        tail.close()
        row = (now, tail.lines, tail.size, tail.last, raw.line_hash(tail.line), tail.base + tail.size, tail.torn)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in WRITTEN.split(", ")])

    for batch in batches:
        for path, base, torn, line in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if path != now:
                if tail is not None:
                    yield close()
                tail, now = _Tail(path, base, torn), path
            tail.write(line)
    if tail is not None:
        yield close()


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files in order, each with the lines that stay: written aside and moved into place; a file without lines goes. A row without a line
    only names its file."""
    now, out, lines, aside = None, None, 0, None

    def close():
        system, inner = _filesystem(now)
        out.close()
        if lines:
            system.move(aside, inner)
        else:
            system.delete_file(aside)
            if system.get_file_info(inner).is_file:  # an earlier attempt may have done it
                system.delete_file(inner)
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([lines], pa.int64())], ["raw_file", "lines"])

    for batch in batches:
        for path, line, ended in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if path != now:
                if now is not None:
                    yield close()
                system, inner = _filesystem(path)
                aside = f"{inner}.{uuid.uuid4().hex}.purging"
                now, out, lines = path, system.open_output_stream(aside), 0
            if line is not None:
                out.write(line.encode() + b"\n" * ended)
                lines += 1
    if now is not None:
        yield close()


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = _filesystem(path)
            if system.get_file_info(inner).is_file:
                system.delete_file(inner)
        yield batch


@dataclass
class Home:
    spark: SparkSession
    path: str

    def __post_init__(self):
        self.path = re.sub("^file:/+", "file:/", self.path.rstrip("/"))  # as listings name local files
        self.store = incremental.Store(self.spark, f"{self.path}/index")
        self.ledger = Ledger(self.spark, f"{self.path}/spool/dedupe")

    def _fs(self, name: str = ""):
        return self.store._fs(f"{self.path}/{name}".rstrip("/"))

    def init(self) -> list[str]:
        """Make what is missing, for the owner alone; what was made."""
        permission = self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700")
        made = []
        for name in FOLDERS:
            fs, p = self._fs(name)
            if not fs.exists(p):
                fs.mkdirs(p, permission)
                made.append(name)
        fs, p = self._fs("config.json")
        if not fs.exists(p):
            out = fs.create(p)
            out.write(bytearray(json.dumps({"version": 1}).encode()))
            out.close()
            made.append("config.json")
        return made

    def raw_file(self, tool: "F.Column", filename_session_id: "F.Column") -> "F.Column":
        return F.concat(F.lit(f"{self.path}/raw/"), tool, F.lit("/"), tool, F.lit("_"), filename_session_id, F.lit(".jsonl"))

    def append(self, envelopes: DataFrame) -> DataFrame:
        """(raw_file, lines, bytes): keyed envelopes whose key no log of their session holds, each session's at the end of its log in order of
        sequence. Sessions are dealt to tasks, so a log has one writer, and one append or pass runs at a time. Logs are read only where they
        grew since the ledger saw them."""
        columns = [F.col(c) if c in envelopes.columns else F.lit(None).cast(ENVELOPE[c].dataType).alias(c) for c in ENVELOPE.names if c not in ("raw_file", "raw_offset")]
        rows = envelopes.select(*columns).withColumn("raw_file", self.raw_file(F.col("tool"), F.col("filename_session_id")))
        with paths.Scratch(self.spark) as scratch:
            return self._append(rows, scratch)

    def _append(self, rows: DataFrame, scratch: paths.Scratch) -> DataFrame:
        rows = scratch.staged(rows, "envelopes")  # shaping them may be dear
        # the first of a key, combined before the shuffle
        row = F.struct(*rows.columns)
        arrival = F.struct(F.col("sequence").isNull(), "sequence", "captured_at", F.xxhash64(*(c for c in rows.columns)))
        keyed = rows.where("dedupe_key is not null").groupBy("raw_file", "dedupe_key").agg(F.min_by(row, arrival).alias("__row")).select("__row.*")
        rows = keyed.unionByName(rows.where("dedupe_key is null"))
        with self.store.lock(WAIT):
            logs = self.logs()
            self.ledger.refresh(logs)
            rows = self.ledger.unseen(rows, logs, scratch)
            # the payload goes into the line as it is, not as text
            names = [c for c in rows.columns if c not in ("raw_file", "payload")]
            head = F.to_json(F.struct(*names))
            line = F.when(F.col("payload").isNull(), head).otherwise(F.concat(F.expr("substring(__head, 1, length(__head) - 1)"), F.lit(',"payload":'), F.col("payload"), F.lit("}")))
            ends = self.ledger.covered().where("source_size >= 0").select(F.col("source_path").alias("raw_file"), "source_size", "byte_offset")
            rows = rows.withColumn("__head", head).withColumn("__line", line).join(ends, "raw_file", "left")
            base = F.coalesce("source_size", F.lit(0)).alias("base")
            lines = rows.select("raw_file", base, F.coalesce(F.col("source_size") > F.col("byte_offset"), F.lit(False)).alias("torn"), "__line", "sequence", "captured_at", "dedupe_key", "tool", "session_id", "payload_ref")
            lines = scratch.staged(lines, "lines")
            scratch.drop("envelopes", "asked")
            if lines.isEmpty():
                return self.spark.createDataFrame([], "raw_file string, lines long, bytes long")
            ordered = lines.repartition("raw_file").sortWithinPartitions("raw_file", F.asc_nulls_last("sequence"), "captured_at", "dedupe_key", "__line").select("raw_file", "base", "torn", "__line")
            report = paths.staged(ordered.mapInArrow(_appended, WRITTEN), "appended")
            self.ledger.record(lines, report, self.logs())
        return report.select("raw_file", "lines", "bytes")

    # keys beside the logs

    def keys(self) -> DataFrame:
        """(raw_file, dedupe_key) of every log; logs that grew or changed are looked at first."""
        self.ledger.refresh(self.logs())
        return self.ledger.keys()

    def keys_fit(self) -> bool:
        """Whether the ledger covers the logs as they are."""
        return self.ledger.fits(self.logs())

    def logs(self) -> DataFrame:
        """(raw_file, size, modified) of the logs, with names as append() writes them."""
        try:
            listed = raw.listing(self.spark, f"{self.path}/raw/*/*.jsonl")
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            listed = self.spark.createDataFrame([], raw.LISTED)
        plain = F.regexp_replace("raw_file", "^file:/+", "/") if self.path.startswith("/") else F.col("raw_file")
        return listed.withColumn("raw_file", plain)

    # search

    def search_index(self) -> Index:
        """The inverted index of the store's events, kept beside them. It follows the store: batches that it has not seen become a segment, events
        that a purge took away or moved are marked as gone, and tiers are merged."""
        index = Index(self.spark, f"{self.store.path}/search")
        state, notes = self.store.state(), {"seen": [], "purges": []} | index.manifest()[2]
        for number in (p for p in state["purges"] if p not in notes["purges"]):
            changed = self.store.purged(number)
            index.delete(changed)
            moved = self.store.events().join(changed.where("not gone"), "dedupe_key", "left_semi") if state["batches"] else None
            # of batches that the index is yet to see, moved events come with them
            moved = None if moved is None or not notes["seen"] else moved
            if moved is not None and not moved.isEmpty():
                index.add(moved)
            index.note(purges=[*index.manifest()[2].get("purges", []), number])
        new, mixed = self.store.unseen(notes["seen"])
        if mixed is not None:
            mixed = mixed.join(index.rows().select("dedupe_key"), "dedupe_key", "left_anti") if index.stats() else mixed
            new = mixed if new is None else new.unionByName(mixed, allowMissingColumns=True)
        seen = sorted({*notes["seen"], *state["batches"], *(x for b in state["batches"].values() for x in b["from"])}, key=int)
        if new is not None and not new.isEmpty():
            index.add(new, {"seen": seen})
            index.compact()
        elif seen != notes["seen"]:
            index.note(seen=seen)
        return index

    def tables(self) -> search.Tables:
        """The store's events with what passes derived from them, and the index."""
        view = self.store.view
        return search.Tables(self.store.events(), view("sessions"), view("event_files"), view("tool_events"), view("event_refs"), index=self.search_index())

    # purges

    def purge(self, tool: str | None = None, session_id: str | None = None, before: str | None = None) -> dict[str, int]:
        """Remove a session, or what was captured before an instant, from the logs, the store and the blobs. Only logs are opened whose zones
        may hold such lines. The lines that stay are kept aside before any file changes; logs left without lines go; in the store, batches
        that hold events of such logs are written anew, with the new places of the events that stay."""
        if (session_id is None) == (before is None) or (session_id is not None and tool not in TOOLS):
            raise ValidationError("name a session of a tool, or an instant")
        with self.store.lock(WAIT):
            with paths.Scratch(self.spark) as scratch:
                report = self._cut(tool, session_id, before, scratch)
            if report["lines"]:
                incremental._pass(self.spark, self.path, self.store)
            return report | {"blobs": self.collect_blobs()}

    def _cut(self, tool: str | None, session_id: str | None, before: str | None, scratch: paths.Scratch) -> dict[str, int]:
        logs = self.logs()
        self.ledger.refresh(logs)
        limit = None if before is None else times.threshold(before, "before")
        may = F.array_contains("sessions", f"{tool}\0{session_id}") if session_id is not None else F.col("least") < limit
        opened = self.ledger.zones().where(may).select("raw_file").distinct()
        found = raw.lines_from(logs.join(opened, "raw_file", "left_semi").withColumns({"resume_offset": F.lit(0).cast("long"), "last_line": F.lit(0).cast("long")}))
        e = F.from_json("line", ENVELOPE)
        doomed = (e["tool"] == tool) & (e["session_id"] == session_id) if session_id is not None else e["captured_at"] < limit
        marked = found.withColumn("doomed", F.coalesce(doomed, F.lit(False))).withColumn("dedupe_key", e["dedupe_key"])
        marked = scratch.staged(marked.withColumn("line", F.when(~F.col("doomed"), F.col("line"))), "marked")
        touched = marked.where("doomed").select("raw_file").distinct()
        gone = marked.where("doomed").count()
        if not gone:
            return {"lines": 0, "files": 0, "emptied": 0}
        staying = marked.where("not doomed").join(touched, "raw_file", "left_semi").select("raw_file", "raw_line", "line", "complete")
        named = touched.select("raw_file", F.lit(0).cast("long").alias("raw_line"), F.lit(None).cast("string").alias("line"), F.lit(False).alias("complete"))
        # dealt by a hash of the name: a shuffle by the name itself is left out behind a join on it, whose tasks may share a log
        rows = staying.unionByName(named).repartition(F.xxhash64("raw_file")).sortWithinPartitions("raw_file", "raw_line").select("raw_file", "line", "complete")
        files = paths.staged(rows.mapInArrow(_rewritten, "raw_file string, lines long"), "rewritten")
        self.ledger.refresh(self.logs())
        # of the lines only the keys of those that went are needed on
        went = scratch.staged(marked.where("doomed").select("raw_file", "dedupe_key"), "went")
        touched = scratch.staged(touched, "touched")
        scratch.drop("marked")
        self._forget(went, touched, scratch)
        return {"lines": gone, "files": files.count(), "emptied": files.where("lines = 0").count()}

    def _plain(self, column: str) -> "F.Column":
        return F.regexp_replace(F.col(column), "^file:/+", "/") if self.path.startswith("/") else F.col(column)

    def _forget(self, went: DataFrame, touched: DataFrame, scratch: paths.Scratch) -> None:
        """Take events of lines that went (raw_file, dedupe_key) out of the store, and give those behind them their new places."""
        batches = list(self.store.state()["batches"])
        if not batches:
            return
        touched = touched.withColumnRenamed("raw_file", "__file")
        # an event that another log holds too may be stored from that one
        gone = went.select(F.col("raw_file").alias("__file"), "dedupe_key").distinct()
        own = [b for b in batches if not self.store.events([b]).select(self._plain("raw_file").alias("__file")).join(touched, "__file", "left_semi").isEmpty()]
        if own:
            again = raw.lines_from(self.logs().join(touched.withColumnRenamed("__file", "raw_file"), "raw_file", "left_semi").withColumns({"resume_offset": F.lit(0).cast("long"), "last_line": F.lit(0).cast("long")}))
            places = again.select(F.col("raw_file").alias("__file"), F.get_json_object("line", "$.dedupe_key").alias("dedupe_key"), F.col("raw_line").alias("__line"), F.coalesce(F.get_json_object("line", "$.raw_offset").cast("long"), "raw_offset").alias("__offset"))
            places = places.where("dedupe_key is not null").groupBy("__file", "dedupe_key").agg(F.min(F.struct("__line", "__offset")).alias("__place"))
            events = self.store.events(own).withColumn("__file", self._plain("raw_file"))
            kept = events.join(gone, ["__file", "dedupe_key"], "left_anti").join(places, ["__file", "dedupe_key"], "left")
            kept = scratch.staged(kept.withColumn("__moved", F.coalesce(F.col("__place.__line") != F.col("raw_line"), F.lit(False))), "kept")
            changed = events.join(gone, ["__file", "dedupe_key"], "left_semi").select("dedupe_key", F.lit(True).alias("gone")).unionByName(kept.where("__moved").select("dedupe_key", F.lit(False).alias("gone")))
            now = kept.withColumn("raw_line", F.when(F.col("__moved"), F.col("__place.__line")).otherwise(F.col("raw_line"))).withColumn("raw_offset", F.when(F.col("__moved"), F.col("__place.__offset")).otherwise(F.col("raw_offset")))
            self.store.rewrite(own, now.drop("__file", "__place", "__moved"), scratch.staged(changed, "changed"))
        left = self.store.checkpoints().withColumn("__file", self._plain("source_path")).join(touched, "__file", "left_anti").drop("__file")
        self.store.checkpoint(left)

    def collect_blobs(self) -> int:
        """Delete the blobs that no line of a log refers to, as the ledger's zones tell; how many."""
        try:
            blobs = self.spark.read.format("binaryFile").load(f"{self.path}/blobs/sha256/*").select("path", F.concat(F.lit("sha256:"), F.regexp_extract("path", "([^/]*)$", 1)).alias("payload_ref"))
        except Exception as e:  # none there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0
        self.ledger.refresh(self.logs())
        orphans = maintain.orphans(blobs, self.ledger.zones().select(F.explode("refs").alias("payload_ref")))
        return paths.staged(orphans.select("path").mapInArrow(_deleted, "path string"), "blobs").count()

    def purge_all(self, dry_run: bool = True, keep: tuple[str, ...] = ()) -> list[dict]:
        """What lies in the home by entry: its tier, bytes and what happened to it. Entries of the tiers in keep, and what is not the
        store's own, stay. A folder that is no home is refused."""
        fs, home = self._fs()
        if not fs.exists(home):
            return []
        there = {s.getPath().getName() for s in fs.listStatus(home)}
        if not there & {"raw", "index", "config.json"}:
            raise ValidationError(f"{self.path} does not look like a home")
        out = []
        for name in sorted(there | set(ENTRIES)):
            tier, p = ENTRIES.get(name, "foreign"), self._fs(name)[1]
            size = fs.getContentSummary(p).getLength() if name in there else 0
            action = "absent" if name not in there else "kept" if tier == "foreign" or tier in keep else "would remove" if dry_run else "removed"
            if action == "removed":
                fs.delete(p, True)
            out.append({"name": name, "tier": tier, "bytes": size, "action": action})
        return out

    # health

    def health(self, deep: bool = False) -> dict[str, bool]:
        """Whether the folders are there, the store's tables are and have their columns, logs have been indexed, and, deep, every line of the
        logs is a valid envelope and every key stands once in the store."""
        fs, _ = self._fs()
        out = {"storage": all(fs.exists(self._fs(name)[1]) for name in FOLDERS)}
        events = self.store.events()
        out["structure"] = events is not None and {"dedupe_key", "tool", "session_id", "canonical_type", "raw_file", "raw_line"} <= set(events.columns)
        out["indexed"] = not self.store.checkpoints().isEmpty()
        if deep:
            found = raw.scan_home(self.spark, self.path) if not self.logs().isEmpty() else None
            out["lines"] = found is None or raw.envelopes(found.where("complete")).where("fault is not null").isEmpty()
            out["keys"] = events is not None and events.groupBy("dedupe_key").count().where("count > 1").isEmpty()
        return out
