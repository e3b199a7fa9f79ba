"""Tokens, keys and text shaping as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError


def _accents() -> tuple[str, str]:
    """Letters of U+00C0 to U+024F that decompose to one ASCII letter and marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b != a and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(col: Column) -> Column:
    """Lower case without Latin diacritics."""
    return F.translate(F.lower(col), ACCENTED, PLAIN)


def tokens(col: Column) -> Column:
    """Runs of letters and digits of the folded text; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def query_terms(query: str) -> list[str]:
    """Runs of letters, digits and underscores, in order, repetitions and case kept."""
    if not query.strip():
        raise ValidationError("query must not be empty")
    found = re.findall(r"\w+", query)
    if not found:
        raise ValidationError("query must contain searchable text")
    return found


def phrases(terms: list[str]) -> list[list[str]]:
    """Each term as the words it is indexed by: an underscore parts words, so such a term is a phrase."""
    split = [re.findall(r"[^\W_]+", fold_text(t)) for t in terms]
    return [p for p in split if p]


def whitespace_key(col: Column) -> Column:
    """Hash of the text with each run of white space as one space and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")), 256)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def like_ascii_fold(col: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only; % and _ in pattern are wildcards."""
    return ascii_lower(col).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))


def escape_like(value: str) -> str:
    """value as a LIKE pattern that matches itself."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def join_non_empty(*cols: Column) -> Column:
    """Trimmed texts, empty ones left out, a line each."""
    return F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in cols))


def ellipsis(col: Column, most: int) -> Column:
    """At most `most` characters; cut text ends in an ellipsis, without white space before it. Empty becomes null."""
    text = F.trim(col)
    cut = F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))
    return F.nullif(F.when(F.char_length(text) > most, cut).otherwise(text), F.lit(""))


def posix_quote(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))


def native_line_command(path: Column, line: Column) -> Column:
    """Shell command that shows one line of a log, null for lines under 1."""
    return F.when(line >= 1, F.concat(F.lit("sed -n '"), line.cast("string"), F.lit("p' "), posix_quote(path), F.lit(" | jq .")))


def is_uuid(col: Column) -> Column:
    return col.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")


def utf8_prefix(text: str, most: int) -> str:
    """The longest prefix of at most `most` bytes that ends between characters."""
    return text.encode()[: max(0, most)].decode("utf-8", "ignore")


def snippet(text: str, terms: list[str], most: int) -> str:
    """At most `most` bytes around the first term found, whole characters, trimmed; short texts whole. Terms are found in the text as it
    is, whatever the case, so places need no mapping between a text and its lower-cased form."""
    raw = text.encode()
    if len(raw) <= most:
        return text.strip()
    found = [m for t in terms if t and (m := re.search(re.escape(t), text, re.IGNORECASE))]
    at, size = 0, 0
    if found:
        first = min(found, key=lambda m: m.start())
        at, size = len(text[: first.start()].encode()), len(first[0].encode())
    start = max(0, min(at - max(0, most - size) // 2, len(raw) - most))
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    return raw[start : start + most].decode("utf-8", "ignore").strip()
