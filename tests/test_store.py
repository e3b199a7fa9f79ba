"""Homes from the command line, the tools over JSON-RPC, and what searches show."""

import io
import json
import os
import subprocess

import pytest

from lorekeep import __main__ as cli
from lorekeep import api, server
from lorekeep.errors import ValidationError
from lorekeep.functions import text
from lorekeep.operators import corroborate, vector
from lorekeep.operators.store import Home

from .test_pipeline import envelope, write


def said(capsys, spark, *argv, stdin=None, monkeypatch=None):
    if stdin is not None:
        monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    code = cli.main(list(argv), spark)
    out = capsys.readouterr()
    return json.loads(out.out) if code == 0 and out.out.startswith("{") else out.out if code == 0 else json.loads(out.err.splitlines()[-1])


def test_commands(spark, tmp_path, capsys, monkeypatch):
    home = str(tmp_path / "home")
    run = lambda *argv, stdin=None: said(capsys, spark, "--home", home, *argv, stdin=stdin, monkeypatch=monkeypatch)
    assert "raw/claude" in run("init")["made"] and run("init")["made"] == []
    assert run("search", "x")["error"]["code"] == "invalid_argument"
    hook = json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s 1", "prompt": "find the needle in src/a/b.py", "cwd": str(tmp_path)})
    assert run("ingest", "--tool", "claude", stdin=hook) == {"appended": 1} and run("ingest", "--tool", "claude", stdin=hook) == {"appended": 0}
    assert run("ingest", "--tool", "claude", stdin="{broken") == {"appended": 1}
    native = tmp_path / "user/.claude/projects/p/0a1b2c3d-0000-1111-2222-333344445555.jsonl"
    write(str(native), [json.dumps({"type": "user", "uuid": f"u{i}", "timestamp": f"2024-01-0{i + 1}T00:00:00Z", "message": {"role": "user", "content": f"needle {i}"}}) for i in range(4)])
    user = str(tmp_path / "user")
    plan = run("backfill", "--tool", "claude", "--user-home", user, "--dry-run")
    assert plan["total"]["missing"] == 4 and plan["would_import"] == 4
    assert run("backfill", "--user-home", user) == {"appended": 4} and run("backfill", "--user-home", user) == {"appended": 0}
    assert run("backfill", "--tool", "claude", "--user-home", user, "--dry-run")["total"]["captured"] == 4
    assert run("index", "--once") == {"events": 6} and run("index", "--watch", "--passes", "1")["files"] == 0
    found = run("search", "needle", "--corroborate")
    assert len(found["results"]) == 5
    hit = next(r for r in found["results"] if r["session_id"] == "s 1")
    assert hit["corroboration"][0]["reference"] == "src/a/b.py" and hit["corroboration"][0]["reason"] == "no_repo"
    assert run("embed")["embedded"] > 0 and run("embed")["embedded"] == 0 and run("search", "needle")["mode"] == "hybrid"
    assert {s["session_id"] for s in run("sessions")["sessions"]} == {"s 1", "hook-parse-error", "0a1b2c3d-0000-1111-2222-333344445555"}
    assert len(run("show", "claude", "0a1b2c3d-0000-1111-2222-333344445555")["events"]) == 4
    assert "needle" in run("tail", "claude", "s 1")["payload"]["prompt"]
    assert run("export", "claude", "s 1").startswith("# claude session s 1")
    assert run("recall", "needle", "--limit", "1")["hits"]
    assert all(run("doctor", "--deep")["health"].values())
    assert run("bench", "--iterations", "2")["search_seconds"]["p95"] > 0
    gone = run("purge", "--tool", "claude", "--session", "s 1")
    assert gone["lines"] == 1 and gone["emptied"] == 1 and len(run("search", "needle", "--mode", "lexical")["results"]) == 4
    before = run("purge", "--before", "2024-01-03")
    assert before["lines"] == 2 and len(run("search", "needle", "--mode", "lexical")["results"]) == 2
    lines = [e["raw_line"] for e in run("show", "claude", "0a1b2c3d-0000-1111-2222-333344445555")["events"]]
    assert lines == [1, 2]
    h = Home(spark, home)
    assert h.search_index().rows().count() == h.store.events().count()
    assert run("ingest", "--tool", "claude", stdin=hook) == {"appended": 1} and run("index", "--once") == {"events": 1}
    assert len(run("search", "needle", "--mode", "lexical")["results"]) == 3 and h.search_index().rows().count() == h.store.events().count()
    (tmp_path / "home/mine.txt").write_text("x")
    plan = {e["name"]: e["action"] for e in run("purge", "--all", "--dry-run", "--keep-config")["entries"]}
    assert plan["raw"] == "would remove" and plan["config.json"] == plan["mine.txt"] == "kept"
    run("purge", "--all")
    assert os.listdir(home) == ["mine.txt"]
    with pytest.raises(ValidationError):
        Home(spark, str(tmp_path / "home")).purge_all()


def test_keys_heal_and_blobs_go(spark, tmp_path):
    home = Home(spark, str(tmp_path))
    home.init()
    write(str(tmp_path / "raw/claude/claude_s1.jsonl"), [envelope(i) for i in range(3)])
    assert not home.keys_fit() and home.keys().count() == 3 and home.keys_fit()
    with open(tmp_path / "raw/claude/claude_s1.jsonl", "a", encoding="utf-8") as f:
        f.write(envelope(8, payload=None, payload_ref="sha256:aa") + "\n")
    assert not home.keys_fit() and home.keys().count() == 4
    for name in ("aa", "bb"):
        (tmp_path / "blobs/sha256" / name).write_text("{}")
    assert home.collect_blobs() == 1 and os.listdir(tmp_path / "blobs/sha256") == ["aa"]


def test_server(spark, tmp_path):
    write(str(tmp_path / "raw/claude/claude_s1.jsonl"), [envelope(i) for i in range(3)])
    from lorekeep.sources import raw

    lines = raw.scan_home(spark, str(tmp_path))
    h = api.History.of(raw.envelopes(lines).where("fault is null").drop("fault", "line", "folder_tool"), lines=lines)
    ask = lambda method, **params: server.answer(h, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "lorekeep" and ask("ping")["result"] == {}
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(server.TOOLS)
    got = json.loads(ask("tools/call", name="search_history", arguments={"query": "prompt", "tool": "claude", "limit": 2})["result"]["content"][0]["text"])
    assert len(got["results"]) == 2
    for bad in ({"name": "search_history", "arguments": {"limit": 3}}, {"name": "search_history", "arguments": {"query": "x", "limit": "3"}}, {"name": "none"}, {"name": "get_event", "arguments": {"tool": "claude", "session_id": "s1", "raw_line": 99}}):
        assert ask("tools/call", **bad)["result"]["isError"]
    read = lambda uri: json.loads(ask("resources/read", uri=uri)["result"]["contents"][0]["text"])
    assert read("lorekeep://sessions")["sessions"] and len(read("lorekeep://sessions/claude/s1")["events"]) == 3 and read("lorekeep://schema/tools")["tools"]
    assert "error" in ask("resources/read", uri="lorekeep://x") and "error" in ask("nothing") and server.answer(h, {"method": "ping"}) is None
    assert len(ask("prompts/list")["result"]["prompts"]) == 2 and ask("prompts/get", name="prepare_handoff_summary")["result"]["messages"]
    out = io.StringIO()
    server.serve(h, io.StringIO('{"id": 1, "method": "ping"}\n\nno json\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [None, -32700]


def test_snippets_hold_their_term():
    for t, terms, most in (("İ" * 40 + "needle" + "x" * 60, ["needle"], 20), ("a" * 500 + " NEEDLE " + "b" * 500, ["needle"], 30), ("é" * 400 + "needle", ["zzz", "needle"], 24)):
        got = text.snippet(t, terms, most)
        assert "needle" in got.lower() and len(got.encode()) <= most
    assert len(text.snippet("é" * 30, ["x"], 30).encode()) <= 30 and text.snippet(" ab ", ["x"], 30) == "ab"


def test_claims_of_a_broken_repository(tmp_path):
    (tmp_path / ".git").write_text("gitdir: nowhere")
    got = corroborate.corroborate("branch main, PR #3", cwd=str(tmp_path))
    assert {(c["kind"], c["status"], c["reason"]) for c in got} == {("branch", "unknown", "git_error"), ("pr", "unresolved", "needs_network")}
    subprocess.run(["git", "init", "-q", str(tmp_path / "r")], check=True)
    assert corroborate.corroborate("branch main", project_root=str(tmp_path / "r"))[0]["status"] == "missing"


def test_vector_bytes_and_progress():
    assert vector.to_blob([1.0, -2.5]).hex() == "0000803f000020c0" and vector.from_blob(vector.to_blob([1.0, -2.5])) == [1.0, -2.5]
    with pytest.raises(ValidationError):
        vector.from_blob(b"abc")
    assert vector.progress(10, 25, 4.0) == {"done": 10, "total": 25, "rate": 2.5, "eta_seconds": 6}
    assert vector.progress(0, 5, 0.0)["eta_seconds"] is None and vector.embed_pending(None, "", None) == 0


def test_texts_are_embedded_in_waves(spark, tmp_path, monkeypatch):
    """A round for each chunk would look all texts up again each time."""
    path, units = str(tmp_path / "vectors"), spark.range(500).selectExpr("concat('text ', id % 400) as text").selectExpr("text", "sha2(text, 256) as text_hash")
    told = []
    assert vector.embed_pending(units, path, vector.HashingEmbedder(8), 5, told.append) == 400
    assert [(t["done"], t["total"]) for t in told][-1] == (400, 400) and len(told) == 3
    assert vector.embed_pending(units, path, vector.HashingEmbedder(8), 5) == 0
    more = units.unionByName(spark.range(7).selectExpr("concat('new ', id) as text").selectExpr("text", "sha2(text, 256) as text_hash"))
    assert vector.embed_pending(more, path, vector.HashingEmbedder(8), 5) == 7
    got = spark.read.parquet(path)
    assert got.count() == got.select("text_hash").distinct().count() == 407
