"""The query surface and claims about repositories."""

import json
import subprocess

import pytest

from lorekeep import api
from lorekeep.errors import NotFoundError, ValidationError
from lorekeep.operators import corroborate
from lorekeep.sources import raw

from .test_pipeline import envelope, write


def test_history(spark, tmp_path):
    write(str(tmp_path / "raw/claude/claude_s1.jsonl"), [envelope(i) for i in range(4)] + [envelope(7, payload={"prompt": "use API_KEY=abcdefgh1234"})])
    lines = raw.scan_home(spark, str(tmp_path))
    h = api.History.of(raw.envelopes(lines).where("fault is null").drop("fault", "line", "folder_tool"), lines=lines)
    found = h.search_history("prompt", limit=2, include_payload=True)
    assert len(found["results"]) == 2 and found["next_cursor"] == 2 and found["total_estimated"] == 4 and json.loads(found["results"][0]["payload"])["prompt"]
    assert "[REDACTED:ENV_VALUE]" in h.search_history("API_KEY", redacted=True)["results"][0]["snippet"]
    for bad in (dict(limit=0), dict(limit=51), dict(cursor=-1), dict(max_snippet_chars=5000)):
        with pytest.raises(ValidationError):
            h.search_history("prompt", **bad)
    assert h.list_sessions()["sessions"][0]["event_count"] == 5
    page = h.get_session("claude", "s1", limit=3)
    assert len(page["events"]) == 3 and page["next_after_raw_line"] == 3
    assert h.get_event("claude", "s1", raw_line=2)["events"][0]["raw_line"] == 2
    with pytest.raises(NotFoundError):
        h.get_event("claude", "s1", raw_line=99)
    with pytest.raises(ValidationError):
        h.get_session("vim", "s1")
    assert "abcdefgh1234" not in h.export_session("claude", "s1") and "abcdefgh1234" in h.export_session("claude", "s1", "jsonl", redacted=False)
    assert h.recall_answer("prompt", limit=1)["hits"][0]["context"]
    assert h.history_doctor(deep=True)["tables"]["events"] == 5
    with pytest.raises(ValidationError):
        h.history_doctor(deep=True, store_bytes=10**12)


def test_fitting():
    answer = {"results": [{"a": "x" * 100} for _ in range(50)], "truncated": False}
    cut = api.fitted(answer, "results", 1000)
    assert api.size(cut) <= 1000 and 1 < len(cut["results"]) < 50 and cut["truncated"]
    one = api.fitted({"results": [{"a": "é" * 5000, "b": 1}]}, "results", 800)
    assert api.size(one) <= 800 and one["results"][0]["b"] == 1 and len(one["results"][0]["a"]) > 200
    assert api.fitted({"results": []}, "results", 100) == {"results": []}
    assert api.failure(NotFoundError("x"))["error"]["code"] == "not_found"


def test_claims():
    got = corroborate.claims('PR #12 and pull/12, commit abcdef1; git switch -c feat/x. branch main, origin/dev "src/a/b.py" ../no/x.py')
    assert ("pr", "#12") in got and ("commit", "abcdef1") in got and ("branch", "feat/x") in got and ("branch", "main") in got and ("branch", "origin/dev") in got and ("file", "src/a/b.py") in got
    assert len(got) == len(set(got))


def test_resolve(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/in.py").write_text("x")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    (tmp_path / "d/new.py").write_text("y")
    head = git("rev-parse", "HEAD")[:10]
    status = lambda kind, ref: corroborate.resolve(str(tmp_path), kind, ref)["status"]
    assert status("commit", head) == "present" and status("commit", "0" * 10) == "missing"
    assert status("branch", "main") == "present" and status("branch", "nope") == "missing"
    assert [status("file", f) for f in ("d/in.py", "d/new.py", "d/gone.py", "/etc/x.conf")] == ["present", "untracked", "missing", "missing"]
    assert status("pr", "#1") == "unresolved" and corroborate.resolve(None, "commit", head)["status"] == "unresolved"


def test_a_git_that_fails_is_not_a_missing_claim(tmp_path, monkeypatch):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    monkeypatch.setattr(corroborate, "GIT_SECONDS", 1e-9)
    got = corroborate.resolve(str(tmp_path), "commit", "abcdef1")
    assert (got["status"], got["reason"]) == ("unknown", "git_error")
    assert corroborate.corroborate("branch main", project_root=str(tmp_path))[0]["status"] == "unknown"
