"""References to pull requests and commits in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How references look. Groups by position, so that other engines can run them too.
PR_URL = r"(?i)\bgithub\.com/[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?/[A-Za-z0-9._-]+/pull/([0-9]{1,9})\b"
PR_HASH = r"(?i)(?:^|[^0-9A-Za-z/#])(?:[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9._-]+)?(?:PR\s*)?#([0-9]{1,9})(?:[^0-9A-Za-z]|$)"
COMMIT = r"(?i)(?:^|[^0-9a-fx])([0-9a-f]{7,40})(?:[^0-9a-fx]|$)"


def extract(col: Column) -> Column:
    """Sorted distinct array<struct<kind, value>>: pull requests as #number without leading zeros, commits in lower case. A run of
    digits alone is no commit."""
    text = F.coalesce(col, F.lit(""))
    number = lambda x: F.concat(F.lit("#"), F.regexp_replace(x, "^0+(?=[0-9])", ""))
    none = F.array().cast("array<string>")
    # only lines with the mark can match; none of the patterns spans a line break but for white space after PR, which its number does not need
    marked = lambda mark: F.array_join(F.filter(F.split(text, "\n"), lambda x: x.contains(mark)), "\n")
    urls = F.when(F.lower(text).contains("/pull/"), F.regexp_extract_all(text, F.lit(PR_URL), F.lit(1))).otherwise(none)
    hashes = F.when(text.contains("#"), F.regexp_extract_all(marked("#"), F.lit(PR_HASH), F.lit(1))).otherwise(none)
    prs = F.transform(F.array_union(urls, hashes), number)
    commits = F.transform(F.filter(F.regexp_extract_all(text, F.lit(COMMIT), F.lit(1)), lambda x: x.rlike("[A-Fa-f]")), F.lower)
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    return F.array_sort(F.array_distinct(F.concat(named("commit", commits), named("pr", prs))))


def normalize(raw: str) -> tuple[str, str]:
    """(kind, value) of a reference filter: a pull request to match whole, or the beginning of a commit."""
    text = raw.strip()
    tail = text.rpartition("#")[2].strip()
    if re.fullmatch("[0-9]+", tail) and ("#" in text or tail == text):
        return "pr", "#" + (tail.lstrip("0") or "0")
    return "commit", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def normalized(col: Column) -> Column:
    """struct<kind, value> of each reference by the rules of `normalize`; white space is Unicode's."""
    text = F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")
    digits = F.regexp_extract(text, r"(?U)^(?:#|[^#][\s\S]*#)?\s*([0-9]+)\z", 1)
    commit = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    value = F.when(digits != "", F.concat(F.lit("#"), F.regexp_replace(digits, "^0+(?=[0-9])", ""))).otherwise(commit)
    return F.when(col.isNotNull(), F.struct(F.when(digits != "", "pr").otherwise("commit").alias("kind"), value.alias("value")))
