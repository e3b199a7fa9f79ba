"""The streaming source of growing logs against passes over the same logs."""

import json
import os
import random

from lorekeep.sources import raw
from lorekeep.streaming import incremental, tailing

from .test_pipeline import envelope

PLACES = ["raw_file", "raw_line", "raw_offset", "dedupe_key", "session_id", "canonical_type", "source_event_type"]


def log(home, session):
    path = f"{home}/raw/claude/claude_{session}.jsonl"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def grow(path, ids, mode="a", end="\n"):
    with open(path, mode, encoding="utf-8") as f:
        f.write("\n".join(envelope(i, os.path.basename(path)[7:-6], captured_at="2024-01-01T00:00:00Z") for i in ids) + end)


def rounds(home):
    """Logs grow, end in the middle of a line, shrink, are replaced and go; each step is one round of the stream."""
    a, b, c = (log(home, s) for s in ("a", "b", "c"))
    grow(a, range(5)), grow(b, range(100, 103))
    yield
    grow(a, range(5, 30), end="\n" + envelope(30, "a")[:20])
    yield
    with open(a, "a", encoding="utf-8") as f:
        f.write(envelope(30, "a")[20:] + "\n\n{broken\n")
    grow(c, range(200, 204))
    yield
    grow(a, [50, 2], "w")  # shrinks
    grow(b, [x for x in range(300, 310)], "w")  # another log of more bytes
    yield
    os.remove(c)
    grow(a, range(51, 55))
    yield


def stored(store):
    return sorted(tuple(map(str, r)) for r in store.events().select(*PLACES).collect())


def run(spark, home, store, checkpoint, **options):
    query = tailing.watch(spark, home, store, checkpoint, once=True, **options)
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def test_a_stream_equals_passes(spark, tmp_path):
    home, one, two = str(tmp_path / "home"), incremental.Store(spark, str(tmp_path / "one")), incremental.Store(spark, str(tmp_path / "two"))
    for _ in rounds(home):
        incremental.index_once(spark, home, one)
        run(spark, home, two, str(tmp_path / "cp"), range_bytes=300)
        assert stored(one) == stored(two)
        same = ["tool", "source_path", "session_id", "byte_offset", "last_line", "last_line_hash"]
        points = [sorted(tuple(map(str, r)) for r in s.checkpoints().where("byte_offset > 0").select(*same).collect()) for s in (one, two)]
        assert points[0] == points[1]
    assert {r[0] for r in two.events().where("canonical_type = 'source.discontinuity'").select("source_event_type").collect()} == {"source.truncated", "source.rotated", "source.deleted"}
    assert run(spark, home, two, str(tmp_path / "cp")) == 0
    assert incremental.index_once(spark, home, two)["events"] == 0  # a pass goes on where the stream ended


def test_limits_and_restarts_lose_and_repeat_nothing(spark, tmp_path):
    """Batches of few bytes, a new query for each, and a line longer than a batch."""
    home, store = str(tmp_path / "home"), incremental.Store(spark, str(tmp_path / "store"))
    grow(log(home, "a"), range(12)), grow(log(home, "b"), range(100, 108))
    with open(log(home, "a"), "a", encoding="utf-8") as f:
        f.write(envelope(99, "a", captured_at="2024-01-01T00:00:00Z", payload={"prompt": "long " * 2000}) + "\n")
    seen = 0
    for _ in range(60):
        n = run(spark, home, store, str(tmp_path / "cp"), most=3000)
        seen += n
        if not n:
            break
    assert seen == 21 and store.events().count() == 21
    got = sorted((r.raw_file[-7:-6], r.raw_line) for r in store.events().collect())
    assert got == [("a", i) for i in range(1, 14)] + [("b", i) for i in range(1, 9)]


def test_a_batch_twice(spark, tmp_path, monkeypatch):
    """A batch that is run again after its checkpoint was written numbers its lines as before."""
    home, store = str(tmp_path / "home"), incremental.Store(spark, str(tmp_path / "store"))
    batches = []
    consume = tailing.consume

    def twice(batch, to):
        batches.append(batch.count())
        return consume(batch, to), consume(batch, to)

    monkeypatch.setattr(tailing, "consume", twice)
    grow(log(home, "a"), range(4))
    run(spark, home, store, str(tmp_path / "cp"))
    grow(log(home, "a"), range(4, 9))
    run(spark, home, store, str(tmp_path / "cp"))
    assert batches == [4, 5]
    assert sorted((r.sequence, r.raw_line) for r in store.events().select("sequence", "raw_line").collect()) == [(i, i + 1) for i in range(9)]
    assert store.checkpoints().head().last_line == 9


def test_versions_are_folded(tmp_path, monkeypatch):
    """A reader that starts anew knows what the one before it knew, from a snapshot and what came after; ranges cover each byte once."""
    monkeypatch.setattr(tailing, "SNAPSHOT", 4)
    r, home = random.Random(1), str(tmp_path / "home")
    options = {"path": f"{home}/raw", "positions": str(tmp_path / "p"), "rangeBytes": "64"}
    path = log(home, "a")
    for i in range(11):
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(f"{i} {'x' * r.randrange(200)}\n" for _ in range(r.randrange(1, 5)))
        reader = tailing.LogReader(options)
        assert reader.latestOffset() == {"version": i + 1} == reader.latestOffset() == tailing.LogReader(options).latestOffset()
    assert any(n.endswith(".all") for n in os.listdir(tmp_path / "p"))
    reader, got = tailing.LogReader(options), []
    for part in reader.partitions({"version": 0}, {"version": 11}):
        got += [x for batch in reader.read(part) for x in batch.column("line").to_pylist()]
    assert got == open(path, encoding="utf-8").read().splitlines()
    assert json.loads(json.dumps(reader.latestOffset())) == {"version": 11}


def test_lines_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "RANGE", 10)
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f"{'y' * (i % 13)}\n" for i in range(50)))
    ends = [i + 1 for i, ch in enumerate(path.read_text()) if ch == "\n"]
    for k in (1, 7, 50):
        got = raw.lines_before(spark.createDataFrame([(str(path), ends[k - 1])], "raw_file string, upto long")).head()
        assert got.n == k
