"""Incremental indexing: a store of events and checkpoints, passes over growing logs, and streams of landed files.

A store is a folder: events/batch=<n>/, views/<name>/batch=<n>/ (what is derived from each batch: sessions, event_files, event_refs, tool_events),
keys/ and filters/ (keys of all events), purged/<n>/ (keys of events that went or moved), checkpoints/<n>/ (the newest complete one counts)
and manifest/. A manifest names the batches, generations of keys and purges that count, so a pass is seen whole or not at all, and readers keep
what they read from while it is replaced.

A pass lists the logs and leaves those alone whose size and time of change are the checkpoint's; of the others it looks at the line
consumed last, reads on behind it if it is still there, else from the top, and appends the events whose key is new as one batch, with what
is derived from them. Nothing that was written before is read but the keys' buckets that may hold a new one. Passing twice changes
nothing. A lock keeps passes, appends and purges apart.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DamagedError, UnavailableError
from ..manifests import Manifest
from ..operators import derive, document, sessions
from ..operators.keys import KeyTable
from ..schema import SCHEMA_VERSION, sanitize_session_id
from ..sources import raw

CHECKPOINT = (
    "tool string, source_kind string, source_path string, session_id string, byte_offset long, source_size long, source_mtime timestamp, last_line long, last_offset long, last_line_hash string, imported_at timestamp"
)
#: Seconds after which a lock is taken to be left over from a pass that died.
STALE = 3600


#: Batches of a tier that are merged, and events that batches of the first tier have at most.
FAN, TIER = 8, 10_000


def derived(events: DataFrame) -> dict[str, DataFrame]:
    """What is kept for each batch of events."""
    return {"sessions": sessions.partials(events), "event_files": derive.event_files(events), "event_refs": derive.event_refs(events), "tool_events": derive.tool_events(events)}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")
        self.keys = KeyTable(spark, self.path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/checkpoints")
        if not fs.exists(p):
            return []
        own = [s.getPath() for s in fs.listStatus(p)]
        done = [q for q in own if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))]
        return sorted(int(q.getName()) for q in done)

    def state(self) -> dict:
        """batches: by number, how many events and from which batches they were taken; gens: keys; purges: numbers."""
        return {"batches": {}, "gens": {}, "purges": []} | self.manifest.read()[1]

    def _batches(self, name: str, batches: list[str]) -> DataFrame | None:
        own = [f"{self.path}/{name}/batch={b}" for b in batches]
        return self.spark.read.option("mergeSchema", len(own) > 1).option("basePath", f"{self.path}/{name}").parquet(*own) if own else None

    def events(self, batches: list[str] | None = None) -> DataFrame | None:
        """The events, or those of some batches."""
        found = self._batches("events", list(self.state()["batches"]) if batches is None else batches)
        return None if found is None else found.drop("batch")

    def view(self, name: str) -> DataFrame | None:
        """A derived table as the passes left it: event_files, event_refs, tool_events, or sessions with their facts."""
        found = self._batches(f"views/{name}", list(self.state()["batches"]))
        if found is None:
            return None
        return sessions.merged(found.drop("batch")) if name == "sessions" else found.drop("batch")

    def checkpoints(self) -> DataFrame:
        """Checkpoints in today's columns; those that an older store lacks are null, so its logs are looked at again."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], CHECKPOINT)
        return self.spark.read.schema(CHECKPOINT).parquet(f"{self.path}/checkpoints/{found[-1]}")

    def under(self, prefix: str) -> DataFrame:
        """Checkpoints of the files below a folder."""
        return self.checkpoints().where(F.col("source_path").startswith(prefix.rstrip("/") + "/"))

    def put(self, rows: DataFrame) -> None:
        """Checkpoints added, or put in place of those of the same tool and file."""
        self.checkpoint(self.checkpoints().join(rows.select("tool", "source_path"), ["tool", "source_path"], "left_anti").unionByName(rows))

    def drop(self, tool: str, source_path: str) -> None:
        self.checkpoint(self.checkpoints().where(~((F.col("tool") == tool) & (F.col("source_path") == source_path))))

    def lock(self, wait: float = 0) -> Lock:
        return Lock(self, wait)

    def _fresh(self) -> str:
        fs, p = self._fs(f"{self.path}/events")
        return str(1 + max([0, *(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(p))] if fs.exists(p) else [0]))

    def _write(self, events: DataFrame, batch: str) -> int:
        """A batch and what is derived from it; how many events."""
        path = f"{self.path}/events/batch={batch}"
        events.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(events.schema).parquet(path)
        for name, rows in derived(written).items():
            rows.write.option("compression", "zstd").parquet(f"{self.path}/views/{name}/batch={batch}")
        return written.count()

    def append(self, events: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda new: new) -> int:
        """Events whose key is not in the store, the first of each key, as a batch; how many these were. They are written aside first, so that
        neither reading logs nor shaping documents is done twice. shape: what is done to new ones only, where keys are known before."""
        version, state = self.manifest.read()[0], self.state()
        aside = f"{self.path}/incoming-{uuid.uuid4().hex}"
        fresh = derive.first_wins(events)
        fresh.write.option("compression", "zstd").parquet(aside)
        rows = self.spark.read.schema(fresh.schema).parquet(aside)
        try:
            new = self.keys.unseen(rows, state["gens"], "dedupe_key")
        except DamagedError:
            state["gens"] = self.keys.add(self.events().select(F.col("dedupe_key").alias("key")), {})
            new = self.keys.unseen(rows, state["gens"], "dedupe_key")
        batch, added = self._fresh(), 0
        if not new.isEmpty():
            added = self._write(shape(new), batch)
            state["gens"] = self.keys.add(self.events([batch]).select(F.col("dedupe_key").alias("key")), state["gens"], added)
            state["batches"] |= {batch: {"n": added, "from": []}}
            self.manifest.write(version, state)
        fs, p = self._fs(aside)
        fs.delete(p, True)
        return added

    def rewrite(self, batches: list[str], events: DataFrame | None, changed: DataFrame | None = None) -> None:
        """One batch of these events in place of some batches. changed: keys of events that went or are not what they were, for those who
        follow the store."""
        version, state = self.manifest.read()[0], self.state()
        taken = {b: state["batches"].pop(b) for b in batches}
        if events is not None:
            batch = self._fresh()
            n = self._write(events, batch)
            if n:
                state["batches"] |= {batch: {"n": n, "from": sorted({*taken, *(x for t in taken.values() for x in t["from"])}, key=int)}}
        if changed is not None:
            number = 1 + max([0, *state["purges"]])
            changed.select("dedupe_key", "gone").distinct().write.mode("overwrite").parquet(f"{self.path}/purged/{number}")
            state["purges"] = [*state["purges"], number]
            gone = self.purged(number).where("gone").select(F.col("dedupe_key").alias("key"))
            state["gens"] = self.keys.without(gone, state["gens"])
        self.manifest.write(version, state)

    def purged(self, number: int) -> DataFrame:
        return self.spark.read.schema("dedupe_key string, gone boolean").parquet(f"{self.path}/purged/{number}")

    def compact(self) -> int:
        """Merge tiers that have FAN batches; how many batches that took away."""
        taken = 0
        while True:
            tiers: dict[int, list[str]] = {}
            for b, x in self.state()["batches"].items():
                tiers.setdefault(max(0, math.ceil(math.log(max(x["n"], 1) / TIER, FAN))), []).append(b)
            full = next((own for _, own in sorted(tiers.items()) if len(own) >= FAN), None)
            if full is None:
                return taken
            self.rewrite(full, self.events(full))
            taken += len(full) - 1

    def unseen(self, seen: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """Events of batches that a follower has not seen: those that are surely new, and those of merged batches of which it saw a part."""
        live, known = self.state()["batches"], set(seen)
        new, mixed = [], []
        for b, x in live.items():
            parts = set(x["from"]) or {b}
            if b in known or parts <= known:
                continue
            (mixed if parts & known else new).append(b)
        return (self.events(new) if new else None), (self.events(mixed) if mixed else None)

    def checkpoint(self, rows: DataFrame) -> None:
        """A new version beside the old one, which readers keep until the new one is complete."""
        found = self.versions()
        rows.write.mode("overwrite").parquet(f"{self.path}/checkpoints/{(found or [0])[-1] + 1}")


class Lock:
    """One writer at a time: a file that only one can create, waited for `wait` seconds, taken over when it is older than STALE seconds."""

    def __init__(self, store: Store, wait: float = 0):
        self.wait = wait
        self.fs, self.path = store._fs(f"{store.path}/index.lock")
        self.fs.mkdirs(self.path.getParent())

    def __enter__(self) -> Lock:
        if self.fs.exists(self.path) and time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000 > STALE:
            self.fs.delete(self.path, False)
        until = time.time() + self.wait
        while not self.fs.createNewFile(self.path):
            if time.time() >= until:
                raise UnavailableError("another pass is indexing this store")
            time.sleep(0.2)
        return self

    def __exit__(self, *_error) -> None:
        self.fs.delete(self.path, False)


def positions(listed: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For each listed file: where to go on (resume_offset, last_line), and what happened to it: new, skipped (size and time as they were),
    current, grown, truncated or rotated. Only files that are neither new nor skipped are opened, for one line."""
    own = checkpoints.select(F.col("source_path").alias("raw_file"), "byte_offset", "source_size", "source_mtime", "last_line", "last_offset", "last_line_hash", F.col("session_id").alias("known_session"))
    joined = listed.join(own, "raw_file", "left")
    skipped = (F.col("size") == F.col("source_size")) & (F.col("modified") == F.col("source_mtime"))
    joined = joined.withColumn("unchanged", F.coalesce(skipped, F.lit(False)))
    looked = joined.where("not unchanged and byte_offset > 0 and byte_offset <= size and last_offset is not null")
    joined = joined.join(raw.still_there(looked), "raw_file", "left")
    state = (
        F.when(F.col("byte_offset").isNull(), "new")
        .when(F.col("unchanged"), "skipped")
        .when(F.col("byte_offset") > F.col("size"), "truncated")
        .when((F.col("byte_offset") > 0) & ~F.coalesce("same", F.lit(False)), "rotated")
        .when(F.col("byte_offset") == F.col("size"), "current")
        .otherwise("grown")
    )
    on = F.col("state").isin("grown", "current", "skipped")
    out = joined.withColumn("state", state).withColumn("resume_offset", F.when(on, F.col("byte_offset")).otherwise(F.lit(0)))
    return out.withColumn("last_line", F.when(on, F.col("last_line")).otherwise(F.lit(0).cast("long"))).drop("unchanged", "same")


def discontinuities(files: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """An event for each source that shrank, was replaced or went, with an id that makes it come once."""
    broken = files.where(F.col("state").isin("truncated", "rotated")).select("raw_file", "known_session", "byte_offset", "size", F.concat(F.lit("source."), F.col("state")).alias("kind"))
    if deleted is not None:
        broken = broken.unionByName(deleted.select(F.col("source_path").alias("raw_file"), F.col("session_id").alias("known_session"), "byte_offset", F.lit(0).cast("long").alias("size"), F.lit("source.deleted").alias("kind")))
    id_ = F.concat_ws(":", "kind", "raw_file", F.col("byte_offset").cast("string"), F.col("size").cast("string"))
    payload = F.to_json(F.struct(F.col("known_session").alias("session_id"), F.col("kind").alias("hook_event_name"), F.col("raw_file").alias("source_path"), F.col("byte_offset").alias("previous_byte_offset"), F.col("size").alias("current_byte_len"), F.col("kind").alias("reason"), F.lit("source discontinuity").alias("text")))
    return broken.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), F.regexp_extract("raw_file", "/raw/([^/]+)/[^/]+$", 1).alias("tool"),
        F.col("known_session").alias("session_id"), sanitize_session_id(F.col("known_session")).alias("filename_session_id"), F.lit("backfill").alias("source"), F.col("kind").alias("source_event_type"),
        F.lit("source.discontinuity").alias("canonical_type"), id_.alias("source_event_id"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("payload_ref"), "raw_file",
        F.lit(0).cast("long").alias("raw_line"), F.lit(None).cast("long").alias("raw_offset"), payload.alias("payload"),
    )


def path_session(path: str) -> F.Column:
    """The session that a log's name tells, without the tool before it."""
    stem, tool = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1), F.regexp_extract(path, "/raw/([^/]+)/[^/]+$", 1)
    return F.when(stem.startswith(F.concat(tool, F.lit("_"))), F.substr(stem, F.length(tool) + 2)).otherwise(stem)


def index_once(spark: SparkSession, home: str, store: Store) -> dict[str, int]:
    """One pass. Returns what it did: files looked into, lines read, events added, faults and discontinuities."""
    with store.lock():
        return _pass(spark, home, store)


def _pass(spark: SparkSession, home: str, store: Store) -> dict[str, int]:
    aside = f"{store.path}/pass-{uuid.uuid4().hex}"
    kept = lambda df, name: (df.write.option("compression", "zstd").parquet(f"{aside}/{name}"), spark.read.schema(df.schema).parquet(f"{aside}/{name}"))[1]
    try:
        listed = raw.listing(spark, f"{home}/raw/*/*.jsonl")
    except Exception as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        listed = spark.createDataFrame([], raw.LISTED)
    checkpoints = store.checkpoints()
    files = kept(positions(listed, checkpoints), "files")
    deleted = checkpoints.join(files.select(F.col("raw_file").alias("source_path")), "source_path", "left_anti")
    looked = files.agg(F.count_if(~F.col("state").isin("skipped", "current")), F.count_if(F.col("state").isin("truncated", "rotated")), F.count_if(F.col("state") != "skipped")).head()
    went = deleted.count()
    if not (looked[2] or went):  # nothing to do, and nothing to note
        fs, p = store._fs(aside)
        fs.delete(p, True)
        return {"files": 0, "lines": 0, "faults": 0, "events": 0, "discontinuities": 0}
    work = files.where("state not in ('skipped', 'current')").select("raw_file", "size", "resume_offset", "last_line")
    found = raw.lines_from(work).where("complete").withColumn("folder_tool", F.regexp_extract("raw_file", "/raw/([^/]+)/[^/]+$", 1))
    found = kept(found, "lines")
    parsed = raw.envelopes(found)
    good = parsed.where("fault is null").drop("fault", "line", "folder_tool")
    broken = document.with_documents(discontinuities(files, deleted))
    rows = good.unionByName(broken.select(*(c for c in good.columns if c in broken.columns)), allowMissingColumns=True)
    # a valid envelope has its key, so only events that are new need documents
    added = store.append(rows, lambda new: document.with_documents(new.withColumnRenamed("dedupe_key", "__key")).withColumn("dedupe_key", F.col("__key")).drop("__key"))
    last = found.groupBy("raw_file").agg(F.max_by(F.struct("raw_line", "raw_offset", F.sha2(F.rtrim("line"), 256).alias("h"), (F.col("raw_offset") + F.octet_length("line") + 1).alias("end")), "raw_line").alias("l"))
    old = checkpoints.select(F.col("source_path").alias("raw_file"), F.col("last_offset").alias("old_offset"), F.col("last_line_hash").alias("old_hash"), F.col("last_line").alias("old_line"))
    now = files.select("raw_file", "size", "modified", "state", "resume_offset").join(last, "raw_file", "left").join(old, "raw_file", "left")
    stays = F.col("state").isin("grown", "current", "skipped")
    pick = lambda fresh, before: F.coalesce(F.col(fresh), F.when(stays, F.col(before)))
    tool = F.regexp_extract("raw_file", "/raw/([^/]+)/[^/]+$", 1)
    session = path_session("raw_file")
    store.checkpoint(
        now.select(
            tool.alias("tool"), F.lit("raw_jsonl").alias("source_kind"), F.col("raw_file").alias("source_path"), session.alias("session_id"), F.coalesce("l.end", "resume_offset").alias("byte_offset"),
            F.col("size").alias("source_size"), F.col("modified").alias("source_mtime"), pick("l.raw_line", "old_line").alias("last_line"), pick("l.raw_offset", "old_offset").alias("last_offset"),
            pick("l.h", "old_hash").alias("last_line_hash"), F.current_timestamp().alias("imported_at"),
        )
    )
    counted = parsed.agg(F.count(F.lit(1)), F.count_if(F.col("fault").isNotNull())).head()
    report = {"files": looked[0], "lines": counted[0], "faults": counted[1], "events": added, "discontinuities": looked[1] + went}
    fs, p = store._fs(aside)
    fs.delete(p, True)
    return report


def detached(spark: SparkSession, home: str, store: Store) -> threading.Thread:
    """Index beside what the caller goes on with; where a pass is running already, that one is enough."""

    def run() -> None:
        try:
            drain(spark, home, store)
        except UnavailableError:
            pass

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread


def drain(spark: SparkSession, home: str, store: Store, passes: int = 8) -> int:
    """Passes until one adds nothing, at most `passes`; events added in all."""
    total = 0
    for _ in range(passes):
        added = index_once(spark, home, store)["events"]
        total += added
        if not added:
            break
    return total


def first_of_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(raw_file, raw_line, raw_offset, line): the lines of files that are not blank, of equal ones the first by file and line. Equal lines are
    equal events, so only one of them is shaped. A place is one number, the file's rank times more than any file's bytes plus the line's number
    or offset, so that equal lines are combined by hash before the shuffle, without sorting."""
    listed = raw.listing(spark, *files)
    known = sorted((r.raw_file, r.size) for r in listed.select("raw_file", "size").distinct().collect())
    step = F.lit(max(size for _, size in known) + 2).cast("long")
    ranks = F.broadcast(spark.createDataFrame([(name, i) for i, (name, _) in enumerate(known)], "raw_file string, rank long"))
    found = raw.lines_from(listed.withColumns({"resume_offset": F.lit(0).cast("long"), "last_line": F.lit(0).cast("long")})).where(F.trim("line") != "").join(ranks, "raw_file")
    place = lambda c: F.min(F.col("rank") * step + F.col(c)).alias(c)
    firsts = found.groupBy("line").agg(place("raw_line"), place("raw_offset"))
    own = F.broadcast(ranks.select("raw_file", (F.col("rank") * step).alias("__base")))
    firsts = firsts.withColumn("__base", F.col("raw_offset") - F.pmod("raw_offset", step)).join(own, "__base")
    return firsts.select("raw_file", (F.col("raw_line") - F.col("__base")).alias("raw_line"), (F.col("raw_offset") - F.col("__base")).alias("raw_offset"), "line")


def follow(spark: SparkSession, landing: str, store: Store, checkpoint: str, once: bool = True):
    """A stream over landed, immutable JSONL files of hook payloads (tool, payload per line): events append with the file and line they
    came from, repeated keys drop out. Out-of-order and late events are taken as they come."""
    from ..operators import canonical

    rows = spark.readStream.schema("value string").text(landing).select(F.col("_metadata.file_path").alias("raw_file"))

    def add(batch: DataFrame, _epoch: int) -> None:
        # a landed file does not change, so a line's place among the file's lines is the same in every batch that reads it
        files = [r.raw_file for r in batch.select("raw_file").distinct().collect()]  # files of one batch
        if not files:
            return
        pair = F.from_json("line", "tool string, payload string")
        named = first_of_lines(batch.sparkSession, files).select("raw_file", "raw_line", "raw_offset", pair.alias("p")).select("raw_file", "raw_line", "raw_offset", "p.tool", "p.payload")
        store.append(document.with_documents(canonical.from_hooks(named)))

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def stream_session_counts(spark: SparkSession, source: str, pattern: str, schema, out: str, checkpoint: str, key: "F.Column") -> DataFrame:
    """Counts and bounds of sessions kept up by a stream over Parquet files; what the last batch left."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    kept = rows.groupBy(key.alias("session_id")).agg(F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    query = kept.writeStream.outputMode("complete").foreachBatch(lambda b, _e: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
