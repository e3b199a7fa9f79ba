"""SQL that states the ranking rules anew, for another engine."""

from __future__ import annotations

from ..functions import text
from ..schema import WEIGHTS


def _tokens(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def _count(tokens: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({tokens}, lambda x: x = '{phrase[0]}'))"
    words = ", ".join(f"'{w}'" for w in phrase)
    return f"len(list_filter(range(1, len({tokens}) - {len(phrase) - 2}), lambda i: {tokens}[i:i + {len(phrase) - 1}] = [{words}]))"


def bm25(view: str, columns: list[str], terms: list[str]) -> str:
    """CTEs up to `scored`: view `ev` with its score, rows without a phrase left out."""
    wanted = text.phrases(terms)
    distinct = [list(p) for p in dict.fromkeys(map(tuple, wanted))]
    toks = ", ".join(f"{_tokens(c)} AS t_{c}" for c in columns)
    length = " + ".join(f"len(t_{c})" for c in columns)
    found = []
    for i, p in enumerate(distinct):
        found.append(" + ".join(f"{WEIGHTS[c]} * {_count(f't_{c}', p)}" for c in columns) + f" AS f{i}")
        found.append(" + ".join(_count(f"t_{c}", p) for c in columns) + f" AS n{i}")
    stats = ", ".join(f"count(*) FILTER (WHERE n{i} > 0) AS df{i}" for i in range(len(distinct)))
    parts = []
    for p in wanted:
        i = distinct.index(p)
        idf = f"ln((st.n - df{i} + 0.5) / (df{i} + 0.5))"
        parts.append(f"(CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl * st.n / st.total))")
    some = " OR ".join(f"n{i} > 0" for i in range(len(distinct)))
    return f"""{view}, tok AS (SELECT *, {toks} FROM ev), tf AS (SELECT *, {length} AS dl, {', '.join(found)} FROM tok),
  st AS (SELECT count(*) AS n, sum(dl) AS total, {stats} FROM tf), scored AS (SELECT tf.*, {' + '.join(parts)} AS score FROM tf, st WHERE {some})"""


ORDER = "round(score, 9) DESC, captured_at DESC, raw_line ASC, session_id ASC"


def redacted(column: str) -> str:
    """Secrets replaced rule by rule."""
    from ..functions import redact

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, instead in redact.RULES:
        column = f"regexp_replace({column}, {quote(pattern)}, {quote(instead)}, 'g')"
    return f"regexp_replace({column}, {quote(redact.ASSIGNMENT)}, {quote(chr(92) + '1' + redact.ENV_VALUE)}, 'g')"
