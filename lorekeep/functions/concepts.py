"""Opt-in expansion of query terms by related words."""

from __future__ import annotations

# Groups of words that stand for one concept.
CONCEPTS = (
    ("bug", "error", "failure", "fault", "defect"),
    ("perf", "performance", "latency", "throughput", "speed"),
    ("crash", "panic", "abort", "segfault"),
    ("config", "configuration", "settings", "setup"),
    ("auth", "authentication", "login", "signin"),
    ("delete", "remove", "purge", "erase"),
    ("fix", "patch", "repair", "resolve"),
    ("docs", "documentation", "readme"),
    ("test", "tests", "spec", "specs"),
    ("dependency", "dependencies", "deps", "package", "packages"),
)
_RELATED = {word: group for group in CONCEPTS for word in group}


def expand(terms: list[str]) -> list[str]:
    """The terms, then the other words of their concepts; each word once, whatever its case."""
    once: dict[str, str] = {}
    for word in terms:
        once.setdefault(word.lower(), word)
    for word in (w for term in terms for w in _RELATED.get(term.lower(), ())):
        once.setdefault(word, word)
    return list(once.values())
