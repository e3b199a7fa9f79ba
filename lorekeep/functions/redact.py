"""Secrets in text and JSON replaced by what they were."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How secrets look, in the order in which they are replaced.
RULES = (
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED:PRIVATE_KEY]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer [REDACTED:BEARER_TOKEN]"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "[REDACTED:API_KEY]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:API_KEY]"),
)
#: For each rule, texts of which every match holds one, in lower case where the rule takes any case.
NEEDED = (("PRIVATE KEY",), ("bearer",), ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("xox",), ("AKIA",))
ASSIGNMENT = r"""(?i)\b([A-Z0-9_]*(?:API|TOKEN|SECRET|KEY|PASSWORD)[A-Z0-9_]*\s*=\s*)(['"]?)[^\s'"#]{8,}(['"]?)"""
ENV_VALUE = "[REDACTED:ENV_VALUE]"
SENSITIVE_PARTS = ("api_key", "apikey", "access_token", "auth_token", "bearer", "secret", "password", "private_key")
SENSITIVE_ENDS = ("_key", "token")


def redact(col: Column) -> Column:
    """text with every secret replaced. A rule's pattern runs only on texts that hold a text which all its matches hold."""
    for (pattern, instead), needs in zip((*RULES, (ASSIGNMENT, "$1" + ENV_VALUE)), (*NEEDED, ("=",)), strict=True):
        col = _where_needed(col, pattern, instead, needs)
    return col


def _where_needed(col: Column, pattern: str, instead: str, needs: tuple[str, ...]) -> Column:
    # the text is bound to a name, as it is needed three times
    def one(x: Column) -> Column:
        held = F.lower(x) if pattern.startswith("(?i)") else x
        there = reduce(lambda a, b: a | b, (held.contains(n) for n in needs))
        return F.when(there, F.regexp_replace(x, pattern, instead)).otherwise(x)

    return F.transform(F.array(col), one)[0]


_COMPILED = tuple((re.compile(p), r) for p, r in RULES)
_ASSIGNMENT = re.compile(ASSIGNMENT)


def redact_text(text: str) -> str:
    for pattern, instead in _COMPILED:
        text = pattern.sub(instead, text)
    return _ASSIGNMENT.sub(lambda m: m[1] + ENV_VALUE, text)


def is_sensitive(key: str) -> bool:
    low = key.lower()
    return any(p in low for p in SENSITIVE_PARTS) or low.endswith(SENSITIVE_ENDS)


def redact_json(value):
    """Strings redacted at any depth; the whole value under a sensitive key goes."""
    if isinstance(value, dict):
        return {k: ENV_VALUE if is_sensitive(k) else redact_json(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_json(v) for v in value]
    return redact_text(value) if isinstance(value, str) else value


def redact_line(line: str) -> str:
    """A log line: as JSON if it is JSON, else as text."""
    try:
        return json.dumps(redact_json(json.loads(line)), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except ValueError:
        return redact_text(line)
