"""What a home knows of its logs without reading them again: how far each was covered, its keys, and what lies where.

Folder: covered/<v>/ (a row for each log: the position behind its last complete line, its hash, an epoch), keys/ and filters/ (keys by log
and epoch), zones/<v>/ (for each range of a log the bounds of captured_at, its sessions and the blobs it refers to) and manifest/. A log that shrank or was
replaced gets a new epoch, so what was known of it counts no more; refresh() reads only what logs gained since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import paths
from ..errors import DamagedError
from ..manifests import Manifest
from ..sources import raw
from ..streaming import incremental
from .keys import KeyTable

#: Bytes of a log that a zone stands for.
ZONE = 64 << 20
COVERED = incremental.CHECKPOINT + ", epoch int"
ZONES = "raw_file string, epoch int, zone long, least string, most string, untimed long, sessions array<string>, refs array<string>"
KEPT = "key string, raw_file string, epoch int, dedupe_key string"


def log_key(raw_file: Column, epoch: Column, dedupe_key: Column) -> Column:
    """A key of one log: the same event may stand in the logs of two sessions."""
    return F.md5(F.concat_ws("\0", raw_file, epoch.cast("string"), dedupe_key))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self.table = KeyTable(spark, self.path, KEPT)

    def state(self) -> dict:
        return {"covered": 0, "zones": [], "gens": {}} | self.manifest.read()[1]

    def covered(self) -> DataFrame:
        v = self.state()["covered"]
        return self.spark.read.schema(COVERED).parquet(f"{self.path}/covered/{v}") if v else self.spark.createDataFrame([], COVERED)

    def fits(self, logs: DataFrame) -> bool:
        """Whether all complete lines of the logs are covered, as far as sizes tell."""
        both = logs.join(self.covered().where("source_size >= 0").select(F.col("source_path").alias("raw_file"), "source_size"), "raw_file", "full")
        return both.where("size is null or source_size is null or size <> source_size").isEmpty()

    def keys(self) -> DataFrame:
        """(raw_file, dedupe_key) of the logs as they are."""
        now = self.covered().select(F.col("source_path").alias("raw_file"), "epoch")
        return self.table.rows(self.state()["gens"]).join(now, ["raw_file", "epoch"], "left_semi").select("raw_file", "dedupe_key")

    def zones(self) -> DataFrame:
        """Zones of the logs as they are."""
        own = [f"{self.path}/zones/{v}" for v in self.state()["zones"]]
        found = self.spark.read.schema(ZONES).parquet(*own) if own else self.spark.createDataFrame([], ZONES)
        now = self.covered().where("source_size >= 0").select(F.col("source_path").alias("raw_file"), "epoch")
        return found.join(now, ["raw_file", "epoch"], "left_semi")

    def refresh(self, logs: DataFrame) -> int:
        """Cover what logs gained; how many lines that were."""
        with paths.Scratch(self.spark) as scratch:
            return self._refresh(logs, scratch)

    def _refresh(self, logs: DataFrame, scratch: paths.Scratch) -> int:
        version, state = self.manifest.read()[0], self.state()
        known = self.covered()
        was = known.where("source_size >= 0").select(F.col("source_path").alias("raw_file"), "source_size", "source_mtime")
        if logs.join(was, "raw_file", "full").where("size is null or source_size is null or size <> source_size or modified <> source_mtime").isEmpty():
            return 0
        placed = incremental.positions(logs, known).join(known.select(F.col("source_path").alias("raw_file"), F.col("epoch").alias("old_epoch")), "raw_file", "left")
        epoch = F.coalesce("old_epoch", F.lit(0)) + F.col("state").isin("truncated", "rotated").cast("int")
        files = scratch.staged(placed.withColumn("epoch", epoch), "files")
        work = files.where("state not in ('skipped', 'current')")
        found = raw.lines_from(work.select("raw_file", "size", "resume_offset", "last_line")).where("complete")
        get = lambda name: F.get_json_object("line", f"$.{name}").alias(name)
        end = F.col("raw_offset") + F.octet_length("line") + 1
        lines = found.select("raw_file", "raw_line", "raw_offset", end.alias("end"), F.sha2(F.rtrim("line"), 256).alias("h"), *map(get, ("dedupe_key", "tool", "session_id", "captured_at", "payload_ref")))
        lines = scratch.staged(lines.join(files.select("raw_file", "epoch"), "raw_file"), "lines")
        n = lines.count()
        if n:
            state |= self._held(lines.withColumn("zone", F.floor(F.col("raw_offset") / ZONE).cast("long")), state, n)
        last = lines.groupBy("raw_file").agg(F.max(F.struct("raw_line", "raw_offset", "h", "end")).alias("l"))
        old = known.select(F.col("source_path").alias("raw_file"), F.col("last_offset").alias("old_offset"), F.col("last_line_hash").alias("old_hash"), F.col("last_line").alias("old_line"))
        now = files.select("raw_file", "size", "modified", "state", "resume_offset", "epoch").join(last, "raw_file", "left").join(old, "raw_file", "left")
        stays = F.col("state").isin("grown", "current", "skipped")
        pick = lambda fresh, before: F.coalesce(F.col(fresh), F.when(stays, F.col(before)))
        rows = now.select(
            F.lit(None).cast("string").alias("tool"), F.lit("raw_jsonl").alias("source_kind"), F.col("raw_file").alias("source_path"), F.lit(None).cast("string").alias("session_id"), F.coalesce("l.end", "resume_offset").alias("byte_offset"), F.col("size").alias("source_size"),
            F.col("modified").alias("source_mtime"), pick("l.raw_line", "old_line").alias("last_line"), pick("l.raw_offset", "old_offset").alias("last_offset"), pick("l.h", "old_hash").alias("last_line_hash"), F.current_timestamp().alias("imported_at"), "epoch",
        )
        # a log that went keeps its row, so that one of its name starts a new epoch
        left = known.join(files.select(F.col("raw_file").alias("source_path")), "source_path", "left_anti")
        nothing = lambda c: F.lit(None).cast(known.schema[c].dataType).alias(c)
        stood = F.col("source_size") >= 0
        left = left.select(*(F.lit(0).cast("long").alias(c) if c == "byte_offset" else F.lit(-1).cast("long").alias(c) if c == "source_size" else (F.col("epoch") + stood.cast("int")).alias(c) if c == "epoch" else nothing(c) if c.startswith("last_") or c == "source_mtime" else F.col(c) for c in known.columns))
        covered = state["covered"] + 1
        rows.unionByName(left.select(*rows.columns)).write.mode("overwrite").parquet(f"{self.path}/covered/{covered}")
        self.manifest.write(version, state | {"covered": covered})
        return n

    def _held(self, lines: DataFrame, state: dict, n: int) -> dict:
        """Keys and zones of n lines (raw_file, epoch, zone, dedupe_key, tool, session_id, captured_at, payload_ref), which are staged."""
        keyed = lines.where("dedupe_key is not null").select(log_key(F.col("raw_file"), F.col("epoch"), F.col("dedupe_key")).alias("key"), "raw_file", "epoch", "dedupe_key")
        session = F.concat_ws("\0", "tool", "session_id")
        bounds = lines.groupBy("raw_file", "epoch", "zone").agg(F.min("captured_at").alias("least"), F.max("captured_at").alias("most"), F.count_if(F.col("captured_at").isNull()).alias("untimed"), F.collect_set(session).alias("sessions"), F.collect_set("payload_ref").alias("refs"))
        number = 1 + max([0, *state["zones"]])
        bounds.write.mode("overwrite").parquet(f"{self.path}/zones/{number}")
        return {"gens": self.table.add(keyed, state["gens"]), "zones": [*state["zones"], number]}

    def record(self, lines: DataFrame, report: DataFrame, logs: DataFrame) -> None:
        """Lines that their writer has put behind the covered ends of their logs: nothing is read back. report: (raw_file, lines, bytes, last_offset,
        last_hash, size, torn); a log whose size is not what its writer left is read as any other, by the next refresh()."""
        version, state = self.manifest.read()[0], self.state()
        known = self.covered()
        whole = report.join(logs, "raw_file").where(F.col("end") == F.col("size"))
        old = known.select(F.col("source_path").alias("raw_file"), F.col("last_line").alias("old_line"), "epoch")
        now = whole.join(old, "raw_file", "left").withColumn("epoch", F.coalesce("epoch", F.lit(0)))
        rows = now.select(
            F.lit(None).cast("string").alias("tool"), F.lit("raw_jsonl").alias("source_kind"), F.col("raw_file").alias("source_path"), F.lit(None).cast("string").alias("session_id"), F.col("end").alias("byte_offset"), F.col("size").alias("source_size"),
            F.col("modified").alias("source_mtime"), (F.coalesce("old_line", F.lit(0)) + F.col("torn").cast("int") + F.col("lines")).alias("last_line"), "last_offset", F.col("last_hash").alias("last_line_hash"), F.current_timestamp().alias("imported_at"), "epoch",
        )
        rows = paths.staged(rows, "covered")
        zone = F.floor(F.col("base") / ZONE).cast("long").alias("zone")
        held = lines.join(rows.select(F.col("source_path").alias("raw_file"), "epoch"), "raw_file").select("raw_file", "epoch", zone, "dedupe_key", "tool", "session_id", "captured_at", "payload_ref")
        state |= self._held(held, state, 1)
        covered = state["covered"] + 1
        known.join(rows.select("source_path"), "source_path", "left_anti").select(*known.columns).unionByName(rows).write.mode("overwrite").parquet(f"{self.path}/covered/{covered}")
        self.manifest.write(version, state | {"covered": covered})

    def unseen(self, rows: DataFrame, logs: DataFrame, scratch: paths.Scratch) -> DataFrame:
        """Rows (raw_file, dedupe_key, ...) that no log of theirs holds, as long as scratch is there. Damaged keys are made anew from the logs."""
        now = self.covered().select(F.col("source_path").alias("raw_file"), "epoch")
        keyed = rows.join(now, "raw_file", "left").withColumn("__key", log_key(F.col("raw_file"), F.coalesce("epoch", F.lit(0)), F.col("dedupe_key"))).drop("epoch")
        gens = self.state()["gens"]
        if not gens:
            return keyed.drop("__key")
        keyed = scratch.staged(keyed, "asked")
        try:
            out = self.table.unseen(keyed, gens, "__key")
        except DamagedError:
            self.rebuild(logs)
            scratch.drop("asked")
            return self.unseen(rows, logs, scratch)
        return out.drop("__key")

    def rebuild(self, logs: DataFrame) -> None:
        """Cover all logs anew."""
        version = self.manifest.read()[0]
        self.manifest.write(version, {})
        self.refresh(logs)
