"""Appends, keys, purges and derived tables of a home: what is read, what is written, and what survives a task that runs again."""

import glob
import json
import os
import shutil
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep import paths
from lorekeep.errors import UnavailableError
from lorekeep.operators import derive, document, keys, lexical, sessions, store
from lorekeep.operators.keys import KeyTable
from lorekeep.operators.store import Home
from lorekeep.schema import TEXT_COLUMNS
from lorekeep.sources import raw
from lorekeep.streaming import incremental

from .test_pipeline import envelope, write

SCHEMA = "schema_version int, captured_at string, tool string, session_id string, filename_session_id string, source string, source_event_type string, canonical_type string, dedupe_key string, sequence long, payload string"


def rows(spark, ids, session="s1", day=1):
    out = [(1, f"2024-01-{day + i % 5:02d}T00:00:00Z", "claude", session, session, "hook", "UserPromptSubmit", "user.message", f"sha256:{session}-{i}", i, json.dumps({"prompt": f"word{i} see #{i} in src/f{i % 3}.py"})) for i in ids]
    return spark.createDataFrame(out, SCHEMA)


def log_of(home, session="s1"):
    with open(f"{home.path}/raw/claude/claude_{session}.jsonl", encoding="utf-8") as f:
        return f.read()


def appended(home, df):
    return home.append(df).agg(F.coalesce(F.sum("lines"), F.lit(0))).head()[0]


@pytest.fixture
def home(spark, tmp_path):
    made = Home(spark, str(tmp_path / "home"))
    made.init()
    return made


def test_key_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "PER", 10)
    table, gens = KeyTable(spark, str(tmp_path)), {}
    for k in range(5):
        gens = table.add(spark.range(100 * k, 100 * k + 30 + k).select(F.concat(F.lit("k"), "id").alias("key")), gens)
    assert len(gens) <= 4 and table.rows(gens).count() == sum(30 + k for k in range(5))
    asked = spark.range(0, 600).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"))
    new = {r.n for r in table.unseen(asked, gens).collect()}
    assert new == set(range(600)) - {100 * k + i for k in range(5) for i in range(30 + k)}
    less = table.without(spark.createDataFrame([("k1",), ("k203",), ("none",)], "key string"), gens)
    assert table.rows(less).count() == 158 and {r.n for r in table.unseen(asked, less).collect()} - new == {1, 203}
    table.sweep(less)
    assert len(glob.glob(f"{tmp_path}/keys/gen=*")) == len(less)


def test_lookup_opens_admitted_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "PER", 50)
    table = KeyTable(spark, str(tmp_path))
    gens = table.add(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key")), {})
    assert len(glob.glob(f"{tmp_path}/keys/gen=*/bucket=*")) == 64
    one = spark.createDataFrame([("k7",)], "key string")
    admitted = table._seen(one, gens)
    files = table.opened(admitted, gens).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1 and table.unseen(one, gens).count() == 0
    none = spark.range(10_000, 11_000).select(F.concat(F.lit("k"), "id").alias("key"))
    admitted = table._seen(none, gens)
    assert admitted is None or admitted.count() < 50  # what a filter lets through by chance


def test_appends_read_what_is_new(spark, home, monkeypatch):
    assert appended(home, rows(spark, range(5))) == 5 and appended(home, rows(spark, range(7))) == 2 and appended(home, rows(spark, range(7))) == 0
    assert appended(home, rows(spark, range(3), "s2")) == 3
    read = []
    plain = raw.lines_from
    monkeypatch.setattr(raw, "lines_from", lambda files: (read.extend(files.select("raw_file", "resume_offset").collect()), plain(files))[1])
    assert appended(home, rows(spark, range(8))) == 1 and read == []  # its own lines are known
    with open(f"{home.path}/raw/claude/claude_s2.jsonl", "a", encoding="utf-8") as f:
        f.write(envelope(50, "s2", dedupe_key="sha256:s2-7") + "\n")
    size = len(log_of(home, "s2").encode()) - len(envelope(50, "s2", dedupe_key="sha256:s2-7").encode()) - 1
    assert appended(home, rows(spark, range(9), "s2")) == 5
    assert [(os.path.basename(r.raw_file), r.resume_offset) for r in read] == [("claude_s2.jsonl", size)]
    assert home.keys().count() == 8 + 9 and home.keys_fit()
    lines = [json.loads(x) for x in log_of(home).splitlines()]
    assert [x["sequence"] for x in lines] == list(range(8))
    # covered ends agree with the files
    for r in home.ledger.covered().collect():
        body = log_of(home, r.source_path[-8:-6]).encode()
        assert r.byte_offset == len(body) and r.last_line == body.count(b"\n") and raw.line_hash(body.splitlines()[-1]) == r.last_line_hash and body[r.last_offset - 1 : r.last_offset] in (b"\n", b"")


def test_logs_that_shrink_go_or_end_in_the_middle(spark, home):
    appended(home, rows(spark, range(6)))
    path = f"{home.path}/raw/claude/claude_s1.jsonl"
    kept = log_of(home).splitlines(True)[:2]
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(kept)
    assert appended(home, rows(spark, range(6))) == 4 and len(log_of(home).splitlines()) == 6
    os.remove(path)
    assert appended(home, rows(spark, range(3))) == 3 and len(log_of(home).splitlines()) == 3
    with open(path, "a", encoding="utf-8") as f:
        f.write('{"torn": ')
    assert appended(home, rows(spark, range(4))) == 1
    lines = log_of(home).splitlines()
    assert len(lines) == 5 and lines[3] == '{"torn": ' and json.loads(lines[4])["sequence"] == 3
    assert home.ledger.covered().where("source_size >= 0").head().last_line == 5


def test_a_task_that_runs_again_writes_nothing_twice(tmp_path):
    path = str(tmp_path / "log.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write("old\n")
    batch = pa.RecordBatch.from_arrays([pa.array([path] * 3), pa.array([4] * 3), pa.array([False] * 3), pa.array(["a", "é", "c"])], ["raw_file", "base", "torn", "line"])
    first = [b.to_pylist() for b in store._appended(iter([batch]))]
    with open(path, "a", encoding="utf-8") as f:
        f.write("half a li")  # what a killed attempt may leave
    assert [b.to_pylist() for b in store._appended(iter([batch]))] == first
    with open(path, encoding="utf-8") as f:
        assert f.read() == "old\na\né\nc\n"
    gone = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.string()), pa.array([False])], ["raw_file", "line", "complete"])
    for _ in range(2):
        assert [b.to_pylist() for b in store._rewritten(iter([gone]))] == [[{"raw_file": path, "lines": 0}]]
    assert os.listdir(tmp_path) == []


def test_two_writers(spark, home, monkeypatch):
    failed = []

    def run(session):
        try:
            appended(home, rows(spark, range(4), session))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=("s1",)) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(log_of(home).splitlines()) == 4 and home.keys().count() == 4
    monkeypatch.setattr(store, "WAIT", 0)
    with home.store.lock():
        for act in (lambda: appended(home, rows(spark, range(5))), lambda: home.purge("claude", "s1"), lambda: incremental.index_once(spark, home.path, home.store)):
            with pytest.raises(UnavailableError):
                act()


def test_damaged_buckets_heal(spark, home):
    appended(home, rows(spark, range(5)))
    bucket = glob.glob(f"{home.path}/spool/dedupe/keys/gen=*/bucket=*")[0]
    shutil.rmtree(bucket)
    assert appended(home, rows(spark, range(6))) == 1 and home.keys().count() == 6
    for f in glob.glob(f"{home.path}/spool/dedupe/keys/gen=*/bucket=*/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"no parquet")
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    assert appended(home, rows(spark, range(7))) == 1 and len(log_of(home).splitlines()) == 7


def kept_equals_derived(home):
    events = home.store.events()
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for name, of in (("event_files", derive.event_files), ("event_refs", derive.event_refs), ("tool_events", derive.tool_events)):
        assert shown(home.store.view(name)) == shown(of(events)), name
    facts = ["tool", "session_id", "event_count", "message_count", "tool_event_count", "compaction_count", "started_at", "updated_at", "raw_file", "cwd", "project_root", "first_user_prompt", "last_event_type"]
    plain = sessions.counts(events).join(sessions.bounds(events), ["tool", "session_id"]).join(sessions.first_prompts(events), ["tool", "session_id"], "left").join(sessions.last_types(events), ["tool", "session_id"], "left")
    assert shown(home.store.view("sessions").select(facts)) == shown(plain.select(facts))


def test_views_purges_and_the_index_follow(spark, home, monkeypatch):
    """Passes add batches; what they wrote stays as it is; a purge opens the logs of its session only, and all that follows agrees with it."""
    monkeypatch.setattr(incremental, "FAN", 3)
    for k in range(3):
        appended(home, rows(spark, range(4 * k, 4 * k + 4), "s1").unionByName(rows(spark, range(k, k + 3), f"t{k}")))
        before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{home.store.path}/views/*/batch=*/*.parquet")}
        assert incremental.index_once(spark, home.path, home.store)["events"] == 7
        assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
        index = home.search_index()
    kept_equals_derived(home)
    assert index.rows().count() == 21 and home.store.compact() == 2 and len(home.store.state()["batches"]) == 1
    assert home.search_index().rows().count() == 21 and home.search_index().manifest()[0] == index.manifest()[0] + 1  # merged batches bring nothing new
    appended(home, rows(spark, range(40, 42), "t9"))
    incremental.index_once(spark, home.path, home.store)
    read = []
    plain = raw.lines_from
    monkeypatch.setattr(raw, "lines_from", lambda files: (read.extend(r.raw_file for r in files.select("raw_file").collect()), plain(files))[1])
    gone = home.purge("claude", "t1")
    assert (gone["lines"], gone["files"], gone["emptied"]) == (3, 1, 1) and {os.path.basename(f) for f in read} == {"claude_t1.jsonl"}
    assert home.store.events().count() == 20 and home.store.events().where("session_id = 't1'").isEmpty()
    kept_equals_derived(home)
    assert home.purge(before="2024-01-02")["lines"] > 0
    left = home.store.events()
    assert left.where("captured_at < '2024-01-02'").isEmpty()
    places = {(os.path.basename(r.raw_file), r.raw_line, r.dedupe_key) for r in left.collect()}
    assert places == {(f"claude_{s}.jsonl", i + 1, json.loads(x)["dedupe_key"]) for s in ("s1", "t0", "t2", "t9") if os.path.exists(f"{home.path}/raw/claude/claude_{s}.jsonl") for i, x in enumerate(log_of(home, s).splitlines())}
    kept_equals_derived(home)
    index = home.search_index()
    scores = lambda df: sorted((r.dedupe_key, r.raw_line, round(r.score, 9)) for r in df.collect())
    assert scores(index.rank(["word9", "see"])) == scores(lexical.rank(lexical.tokenized(left, TEXT_COLUMNS), ["word9", "see"])) and index.rows().count() == left.count()
    # a purged event may come again
    assert appended(home, rows(spark, range(1, 4), "t1")) == 3 and incremental.index_once(spark, home.path, home.store)["events"] == 3
    assert home.search_index().rows().count() == left.count() + 3
    assert {t.tool for t in home.tables().sessions.collect()} == {"claude"}


def test_blobs_by_zones(spark, home):
    write(f"{home.path}/raw/claude/claude_s1.jsonl", [envelope(1), envelope(2, payload=None, payload_ref="sha256:aa")])
    for name in ("aa", "bb"):
        with open(f"{home.path}/blobs/sha256/{name}", "w") as f:
            f.write("{}")
    assert home.collect_blobs() == 1 and os.listdir(f"{home.path}/blobs/sha256") == ["aa"]
    assert home.purge("claude", "s1")["blobs"] == 1


def test_a_purged_log_is_written_by_one_task(spark, home):
    """A join on the log's name, turned into a broadcast while it runs, must not stand in for the shuffle that gives each log one writer."""
    home.append(rows(spark, range(10), "s1").unionByName(rows(spark, range(10), "s2")))
    static, running = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(static, "-1")
        spark.conf.set(running, "10MB")
        report = home.purge(before="2024-01-03")
    finally:
        spark.conf.unset(static)
        spark.conf.unset(running)
    assert report["lines"] == 8 and report["files"] == 2 and report["emptied"] == 0
    for s in ("s1", "s2"):
        assert [json.loads(x)["sequence"] for x in log_of(home, s).splitlines()] == [2, 3, 4, 7, 8, 9]


def test_ranges_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Rows that name ranges are small, but what they stand for is not: they are not put together into one task."""
    monkeypatch.setattr(raw, "RANGE", 1000)
    write(str(tmp_path / "l.jsonl"), [f"{i:099d}" for i in range(300)])
    found = raw.lines(spark, str(tmp_path / "l.jsonl")).withColumn("task", F.spark_partition_id()).collect()
    assert [r.raw_line for r in sorted(found, key=lambda r: r.raw_offset)] == list(range(1, 301))
    assert len({r.task for r in found}) > 1


def test_ranges_behind_a_join_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Where counts of lines are joined by a shuffle on the range, its tasks may be put together; those that read are not."""
    monkeypatch.setattr(raw, "RANGE", 1000)
    write(str(tmp_path / "l.jsonl"), [f"{i:099d}" for i in range(300)])
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for name in names:
        spark.conf.set(name, "-1")
    try:
        found = raw.lines(spark, str(tmp_path / "l.jsonl")).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert [r.raw_line for r in sorted(found, key=lambda r: r.raw_offset)] == list(range(1, 301))
    assert len({r.task for r in found}) > 1


def test_a_line_is_parsed_once(spark, tmp_path):
    """A filter on faults does not parse the line again for each column that a fault names."""
    write(str(tmp_path / "raw" / "claude" / "claude_s1.jsonl"), [json.dumps({"tool": "claude"})])
    found = paths.staged(raw.scan_home(spark, str(tmp_path)), "parsed")
    good = raw.envelopes(found).where("fault is null").drop("fault", "line", "folder_tool")
    assert good._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert raw.envelopes(found).select("fault").collect()[0].fault == "schema_version"


def test_appends_and_purges_leave_no_copies_of_lines(spark, home, monkeypatch):
    """What is staged on the way goes when it is done with, and a pass behind a purge shapes no event that the store has."""
    def names():
        return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))

    before = names()
    home.append(rows(spark, range(10)))
    incremental.index_once(spark, home.path, home.store)
    shaped, own = [], document.with_documents
    monkeypatch.setattr(document, "with_documents", lambda events: (shaped.append(events.count()), own(events))[1])
    assert home.purge(before="2024-01-03")["lines"] == 4
    assert sum(shaped) == 0
    assert home.store.events().count() == 6 and len(log_of(home).splitlines()) == 6
    assert {n.rpartition("-")[0] for n in names() - before} <= {"appended", "covered", "rewritten", "admitted"}
