"""Logs to events to tables: canonicalization, documents, identity, the incremental index."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.errors import NotFoundError, UnavailableError
from lorekeep.operators import canonical, derive, document, maintain, search, sessions, vector
from lorekeep.sources import native, raw
from lorekeep.streaming import incremental


def hooks(spark, *rows):
    return canonical.from_hooks(spark.createDataFrame([(t, p if isinstance(p, str) else json.dumps(p)) for t, p in rows], "tool string, payload string"))


def test_hook_types(spark):
    rows = [
        ("claude", {"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": "hi"}, "user.message"),
        ("claude", {"hook_event_name": "MessageDisplay", "session_id": "s", "message_id": "m", "index": 2, "final": True}, "assistant.message"),
        ("claude", {"hook_event_name": "MessageDisplay", "session_id": "s", "final": False}, "assistant.delta"),
        ("codex", {"type": "response_item", "session_id": "s", "payload": {"type": "message", "role": "user"}}, "user.message"),
        ("codex", {"type": "response_item", "session_id": "s", "payload": {"type": "function_call"}}, "tool.call"),
        ("codex", {"type": "event_msg", "session_id": "s", "payload": {"type": "nonsense"}}, "error"),
        ("codex", {"type": "item.completed", "session_id": "s", "item": {"type": "reasoning"}}, "assistant.delta"),
        ("codex", {"type": "item.completed", "session_id": "s", "item": {"role": "user", "type": "message"}}, "user.message"),
        ("codex", {"type": "item/completed", "session_id": "s"}, "assistant.message"),
        ("opencode", {"type": "session.created", "id": "oc-1"}, "session.started"),
        ("opencode", {"type": "file.edited", "sessionID": "oc-1", "file": "/a"}, "file.changed"),
        ("opencode", {"type": "SubagentStart", "sessionID": "oc-1"}, "error"),
        ("claude", {"hook_event_name": "PreCompact", "session_id": "s", "trigger": "auto"}, "compaction.before"),
        ("claude", "{not json", "error"),
    ]
    got = hooks(spark, *[(t, p) for t, p, _ in rows]).collect()
    assert [r.canonical_type for r in got] == [w for _, _, w in rows]
    assert got[1].source_event_id == "m:2:true" and got[9].session_id == "oc-1" and got[13].session_id == "hook-parse-error"


def test_native_types(spark):
    records = [
        ("claude", {"type": "user", "message": {"content": "x"}}, "user.message"),
        ("claude", {"type": "user", "message": {"content": [{"type": "tool_result", "content": "y"}]}}, "tool.result"),
        ("claude", {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}}, "tool.call"),
        ("claude", {"type": "assistant", "message": {"content": [{"type": "tool_use"}, {"type": "text", "text": "t"}]}}, "assistant.message"),
        ("claude", {"type": "summary"}, "compaction.after"),
        ("claude", {"type": "attachment", "attachment": {"hookEvent": "PostToolUse"}}, "tool.result"),
        ("opencode", {"type": "patch"}, "file.changed"),
        ("opencode", {"role": "user"}, "user.message"),
        ("claude", {"type": "parse_error", "parse_error": "x", "raw_line": "{"}, "error"),
        ("codex", {"type": "zzz", "canonical_type": "permission.requested"}, "permission.requested"),
    ]
    df = spark.createDataFrame([(t, "/x/0a1b2c3d-0000-1111-2222-333344445555.jsonl", 5, json.dumps(p)) for t, p, _ in records], "tool string, source_path string, byte_offset long, payload string")
    got = native.named(df).collect()
    assert [r.canonical_type for r in got] == [w for _, _, w in records]
    assert {r.session_id for r in got} == {"0a1b2c3d-0000-1111-2222-333344445555"} and got[0].sequence == 5


def test_documents():
    d = document.document
    assert d("user.message", {"z": {"prompt": "b"}, "prompt": " a ", "text": ["a", {"type": "no", "k": "c"}]})["user_text"] == "a\nc\nb"
    wrapped = {"tool_name": "shell", "input": {"command": ["git", " status ", 3], "workdir": "/x", "justification": "why"}}
    assert d("tool.call", wrapped)["tool_intent"] == "git status\nwhy\nshell"
    assert d("tool.call", {"arguments": json.dumps({"command": "ls", "timeout_ms": 5})})["tool_intent"] == "ls"
    assert d("tool.call", {"command": "ls"})["tool_intent"] == "ls"
    assert d("session.ended", {"reason": "done", "usage": {"in": 3, "ok": True, "l": [1.5]}})["metadata_text"] == "done\nin 3\nl 1.5\nok true"
    assert d("user.message", {"other": "x", "session_id": "hidden"})["metadata_text"] == "x"
    assert document.file_paths({"a": ["./x", "no"], "my_path": "rel", "path": {"file": [" f ", ""]}, "n": 1}) == ["./x", "f", "rel"]


def test_identity_ignores_observation(spark):
    base = {"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": "hello\n there "}
    same = dict(base, timestamp="2024-01-01T00:00:00Z", cwd="/x")
    other = dict(base, prompt="bye")
    keys = [r.dedupe_key for r in document.with_documents(hooks(spark, *[("claude", p) for p in (base, same, other)])).collect()]
    assert keys[0] == keys[1] != keys[2] and all(k.startswith("sha256:") and len(k) == 71 for k in keys)


def envelope(i, session="s1", **more):
    e = {"schema_version": 1, "captured_at": f"2024-01-01T00:00:{i:02d}Z", "tool": "claude", "session_id": session, "filename_session_id": session, "source": "hook", "source_event_type": "UserPromptSubmit",
         "canonical_type": "user.message", "dedupe_key": f"sha256:{i:064x}", "sequence": i, "payload": {"prompt": f"prompt é {i} #5{i}", "file": f"/tmp/f{i}"}}
    return json.dumps(e | more, ensure_ascii=False)


def write(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


def test_raw_pointers_and_faults(spark, tmp_path):
    log = tmp_path / "raw/claude/claude_s1.jsonl"
    write(str(log), [envelope(0), "", "{broken", envelope(1, tool="codex"), envelope(2)], end="\nhalf")
    found = raw.scan_home(spark, str(tmp_path)).orderBy("raw_line").collect()
    data = log.read_bytes()
    for r in found:
        assert data[r.raw_offset :].startswith(r.line.encode())
    assert [r.raw_line for r in found] == [1, 2, 3, 4, 5, 6] and [r.complete for r in found][-1] is False
    faults = {r.raw_line: r.fault for r in raw.envelopes(raw.scan_home(spark, str(tmp_path))).collect()}
    assert faults == {1: None, 3: "schema_version", 4: "tool folder", 5: None, 6: "schema_version"}
    assert raw.line_at(raw.scan_home(spark, str(tmp_path)), "claude_s1.jsonl", 5).head().line == envelope(2)


@pytest.mark.parametrize(("size", "block"), [(1, 3), (7, 2), (64, 5), (1 << 20, 1 << 20)])
def test_lines_of_ranges(spark, tmp_path, monkeypatch, size, block):
    """Logs read range by range: each line once, numbered and placed as in the file."""
    texts = ["", "\n", "a", "a\n", "\n\n", "one\ntwo é\n\n" + "x" * 50 + "\nend", "long" * 40 + "\n" + "b\n" * 9]
    for i, t in enumerate(texts):
        (tmp_path / f"f {i}.jsonl").write_text(t, encoding="utf-8")
        monkeypatch.setattr(raw, "BLOCK", block)
        data, got, n = t.encode(), [], len(t.encode())
        with raw.opened(str(tmp_path / f"f {i}.jsonl")) as f:
            for a in range(0, max(n, 1), size):
                got += list(raw._starts(f, a, min(a + size, n)))
        want, at = [], 0
        *ended, last = data.split(b"\n")
        for line in ended:
            want.append((at, line, True))
            at += len(line) + 1
        assert got == want + [(at, last, False)] * bool(last), (i, t)
    monkeypatch.setattr(raw, "RANGE", max(size, 40))
    found = raw.lines(spark, str(tmp_path / "*.jsonl")).collect()
    for i, t in enumerate(texts):
        own = sorted((r.raw_line, r.raw_offset, r.line, r.complete) for r in found if r.raw_file.endswith(f"f {i}.jsonl"))
        want = [(k + 1, len("\n".join([*t.split("\n")[:k], ""]).encode()), x, k + 1 < len(t.split("\n"))) for k, x in enumerate(t.split("\n"))]
        assert own == [w for w in want if w[3] or w[2]], (i, t)


def test_unchanged_logs_are_not_opened(spark, tmp_path):
    home, store = str(tmp_path / "home"), incremental.Store(spark, str(tmp_path / "store"))
    for k in (1, 2):
        write(f"{home}/raw/claude/claude_s{k}.jsonl", [envelope(i + 100 * k, f"s{k}") for i in range(3)])
    assert incremental.index_once(spark, home, store) == {"files": 2, "lines": 6, "faults": 0, "events": 6, "discontinuities": 0}
    with open(f"{home}/raw/claude/claude_s1.jsonl", "a", encoding="utf-8") as f:
        f.write(envelope(3, "s1") + "\n" + envelope(4, "s1"))
    assert incremental.index_once(spark, home, store) == {"files": 1, "lines": 1, "faults": 0, "events": 1, "discontinuities": 0}
    with open(f"{home}/raw/claude/claude_s1.jsonl", "a", encoding="utf-8") as f:
        f.write("\n")
    assert incremental.index_once(spark, home, store)["events"] == 1
    lines = {(r.session_id, r.raw_line) for r in store.events().collect()}
    assert lines == {("s1", i) for i in range(1, 6)} | {("s2", i) for i in range(1, 4)}
    write(f"{home}/raw/claude/claude_s2.jsonl", [envelope(i + 20, "s2") for i in range(4)])
    assert incremental.index_once(spark, home, store)["discontinuities"] == 1
    kinds = {r.source_path.rpartition("_")[2]: (r.session_id, r.last_line, r.byte_offset == r.source_size) for r in store.checkpoints().collect()}
    assert kinds == {"s1.jsonl": ("s1", 5, True), "s2.jsonl": ("s2", 4, True)}
    with store.lock(), pytest.raises(UnavailableError):
        incremental.index_once(spark, home, store)
    assert store.under(f"file:{home}/raw").count() == 2 and store.under(f"file:{home}/ra").count() == 0
    path = store.checkpoints().where("session_id = 's2'").head().source_path
    store.drop("claude", path)
    assert store.checkpoints().count() == 1
    store.put(store.checkpoints().withColumn("byte_offset", F.lit(0).cast("long")))
    assert [r.byte_offset for r in store.checkpoints().collect()] == [0]
    thread = incremental.detached(spark, home, store)
    thread.join()
    assert store.checkpoints().count() == 2


def test_incremental_index(spark, tmp_path):
    home, store = str(tmp_path / "home"), incremental.Store(spark, str(tmp_path / "store"))
    log = f"{home}/raw/claude/claude_s1.jsonl"
    write(log, [envelope(i) for i in range(3)])
    assert incremental.index_once(spark, home, store)["events"] == 3
    again = incremental.index_once(spark, home, store)
    assert again["events"] == 0 and again["lines"] == 0
    with open(log, "a", encoding="utf-8") as f:
        f.write(envelope(3) + "\n" + envelope(1) + "\n")
    grown = incremental.index_once(spark, home, store)
    assert grown["events"] == 1 and grown["lines"] == 2
    write(log, [envelope(7)])
    cut = incremental.index_once(spark, home, store)
    assert cut["discontinuities"] == 1 and cut["events"] == 2
    assert incremental.index_once(spark, home, store)["events"] == 0
    os.remove(log)
    write(f"{home}/raw/claude/claude_s2.jsonl", [envelope(9, "s2")])
    gone = incremental.index_once(spark, home, store)
    assert gone["discontinuities"] == 1 and gone["events"] == 2
    kinds = [r.source_event_type for r in store.events().where("canonical_type = 'source.discontinuity'").orderBy("source_event_type").collect()]
    assert kinds == ["source.deleted", "source.truncated"]


def test_follow_stream(spark, tmp_path):
    store = incremental.Store(spark, str(tmp_path / "store"))
    landing = tmp_path / "landing"
    rows = [{"tool": "claude", "payload": json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": f"p{i % 2}"})} for i in range(4)]
    write(str(landing / "a.json"), [json.dumps(r) for r in rows])
    incremental.follow(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    write(str(landing / "b.json"), [json.dumps(rows[0])])
    incremental.follow(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.raw_file.rpartition("/")[2], r.raw_line) for r in store.events().collect()) == [("a.json", 1), ("a.json", 2)]


def test_follow_shapes_equal_lines_once(spark, tmp_path, monkeypatch):
    """However often a payload lands, it is shaped once, and its place is that of its first line by file and line."""
    shaped, own = [], document.with_documents
    monkeypatch.setattr(document, "with_documents", lambda events: (shaped.append(events.count()), own(events))[1])
    line = lambda i: json.dumps({"tool": "claude", "payload": json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": f"p{i}"})})
    write(str(tmp_path / "landing" / "a.json"), [line(2), "", *[line(i % 3) for i in range(30)]])
    write(str(tmp_path / "landing" / "b.json"), [line(i % 5) for i in range(50)])
    store = incremental.Store(spark, str(tmp_path / "store"))
    incremental.follow(spark, str(tmp_path / "landing"), store, str(tmp_path / "cp")).awaitTermination()
    assert shaped == [5]
    found = {r.user_text: (r.raw_file.rpartition("/")[2], r.raw_line, r.raw_offset) for r in store.events().collect()}
    n = len(line(0)) + 1
    assert found == {"p2": ("a.json", 1, 0), "p0": ("a.json", 3, n + 1), "p1": ("a.json", 4, 2 * n + 1), "p3": ("b.json", 4, 3 * n), "p4": ("b.json", 5, 4 * n)}


def indexed(spark, tmp_path):
    log = f"{tmp_path}/raw/claude/claude_s1.jsonl"
    write(log, [envelope(i) for i in range(5)] + [envelope(8, canonical_type="assistant.delta", payload={"text": "prompt delta"})])
    events = document.with_documents(raw.envelopes(raw.scan_home(spark, str(tmp_path))).where("fault is null").drop("fault"))
    return events


def test_search_end_to_end(spark, tmp_path):
    events = indexed(spark, tmp_path).cache()
    t = search.Tables(events, events.select("tool", "session_id", "filename_session_id").distinct(), derive.event_files(events), derive.tool_events(events), derive.event_refs(events))
    page = search.search(t, "prompt", limit=3)
    assert page.returned == 3 and page.total == 5 and page.next_cursor == 3 and page.mode == "lexical"
    pages = [r.raw_line for o in (0, 3) for r in search.search(t, "prompt", limit=3, offset=o).rows.collect()]
    assert pages == [r.raw_line for r in search.search(t, "prompt", limit=50).rows.collect()] and len(set(pages)) == 5
    assert search.search(t, "prompt", search.Filters(ref="#53"), limit=9).rows.collect()[0].raw_line == 4
    assert search.search(t, "prompt", search.Filters(file="/tmp/f2"), limit=9).returned == 1
    assert search.search(t, "prompt", search.Filters(session="s"), limit=9).returned == 5
    assert search.search(t, "prompt", search.Filters(session="absent"), limit=9).returned == 0
    assert search.search(t, "prompt", search.Filters(include_deltas=True), limit=9).returned == 6
    units = derive.vector_units(events)
    t.units = vector.embed(vector.pending(units, spark.createDataFrame([], "text_hash string")), vector.HashingEmbedder(32)).join(units, "text_hash").select("dedupe_key", "embedding")
    mixed = search.search(t, "prompt 3", mode="hybrid", limit=5, embedder=vector.HashingEmbedder(32))
    assert mixed.mode == "hybrid" and mixed.returned == 5
    with pytest.raises(search.UnavailableError):
        search.search(search.Tables(events), "x", mode="hybrid")
    assert search.hydrate(page.rows, events).count() == 3
    recalled = sessions.recall_answer(t, "prompt", limit=2, before=1, after=1).collect()
    lines = [c.raw_line for r in recalled for c in r.context or []]
    assert len(lines) == len(set(lines))
    events.unpersist()


def test_twins_collapse(spark):
    rows = [("s", "user.message", "a  b", 1, 1), ("s", "user.message", "a\nb ", 2, 5), ("s", "user.message", "a c", 3, 7), ("t", "user.message", "a b", 4, 9), ("s", "user.message", " a b", 5, 2)]
    df = spark.createDataFrame(rows, "session_id string, canonical_type string, searchable_text string, rank int, raw_line long")
    got = {(r.session_id, r["rank"]): list(r.also_at) for r in search.collapse(df).collect()}
    assert got == {("s", 1): [5, 2], ("s", 3): [], ("t", 4): []}


def test_derived_tables_and_upkeep(spark, tmp_path):
    events = indexed(spark, tmp_path).cache()
    assert derive.messages(events).where("is_delta").count() == 1
    assert derive.event_refs(events).where("kind = 'pr'").count() == 5
    kept, blobs = derive.spilled(events, 10)
    assert kept.where("payload_ref is not null").count() == 6 and derive.resolved(kept, blobs).where("payload is null").count() == 0
    assert maintain.orphans(blobs, kept.where("raw_line > 1")).count() == 1
    assert maintain.purge_before(events, "2024-01-01T00:00:02Z").count() == 4
    page, truncated, after = sessions.session_page(events, "claude", "s1", limit=2)
    assert truncated and after == 2 and page.count() == 2
    rest, truncated, _ = sessions.session_page(events, "claude", "s1", limit=9, after_raw_line=after)
    assert not truncated and [r.raw_line for r in rest.collect()] == [3, 4, 5]
    with pytest.raises(NotFoundError):
        sessions.session_page(events, "claude", "nope")
    assert sessions.get_event(events, "claude", "s1", raw_line=3).head().raw_line == 3
    s = sessions.triage(events, derive.tool_events(events), derive.event_files(events)).head()
    assert s.event_count == 6 and s.first_user_prompt.startswith("prompt é 0")
    text_lines = maintain.export_markdown(events, "claude", "s1").collect()
    assert text_lines[0].value.startswith("## user.message")
    assert {r.name: r.n for r in maintain.table_counts({"e": events, "m": derive.messages(events)}).collect()} == {"e": 6, "m": 6}
    events.unpersist()


def test_native_sources(spark, tmp_path):
    write(str(tmp_path / "t.jsonl"), ['{"type":"thread.started","thread_id":"T"}', "", "oops", '{"type":"item.completed","item":{"type":"message"}}'])
    got = native.codex_stream(spark, "exec_json", str(tmp_path / "t.jsonl")).orderBy("byte_offset").collect()
    assert [r.session_id for r in got] == ["T", "T", "T"] and [r.canonical_type for r in got][1] == "error" and got[0].source == "exec_json"
    write(str(tmp_path / "m.json"), [json.dumps({"session_id": "S", "messages": [{"text": "a"}, {"session_id": "X", "text": "b"}]})])
    got = native.named(native.json_records(spark, "opencode", str(tmp_path / "m.json"))).orderBy("byte_offset").collect()
    assert [r.session_id for r in got] == ["S", "X"]
    payload = {"messages": [{"sessionID": "S", "text": "hello", "parts": [{"type": "text", "text": "p"}, {"type": "patch"}]}, {"parts": [{"type": "reasoning"}]}, {"role": "user"}]}
    got = native.opencode_server(spark.createDataFrame([(json.dumps(payload),)], "payload string"), "F").collect()
    assert sorted((r.session_id, r.canonical_type) for r in got) == [("F", "assistant.delta"), ("F", "user.message"), ("S", "assistant.message"), ("S", "error"), ("S", "file.changed")]


def test_envelope_rules(spark):
    assert schema.SUMMARY_KINDS["session.ended"] == "session_end"
    df = spark.createDataFrame([("a b/ü",), ("",)], "s string").select(schema.sanitize_session_id(F.col("s")).alias("n")).collect()
    assert [r.n for r in df] == ["a_b__", "_"]


def test_items_of_whole_files_leave_the_file_behind(spark, tmp_path):
    """An item that carried its file's text would have all of it parsed once for each item."""
    items = [{"id": i, **({"session_id": "own"} if i % 2 else {})} for i in range(300)]
    write(str(tmp_path / "m.json"), [json.dumps({"session_id": 'o"1', "messages": items})])
    write(str(tmp_path / "l.json"), [json.dumps(items)])
    assert "value" not in native._items(spark, ("messages",), str(tmp_path / "m.json")).columns
    got = native.json_records(spark, "claude", str(tmp_path / "m.json")).orderBy("byte_offset").collect()
    assert [json.loads(r.payload) for r in got] == [{"session_id": 'o"1'} | x for x in items]
    assert [r.outer_session for r in got] == [None if i % 2 else 'o"1' for i in range(300)]
    got = native.json_records(spark, "claude", str(tmp_path / "l.json")).orderBy("byte_offset").collect()
    assert [json.loads(r.payload) for r in got] == items and not any(r.outer_session for r in got)
