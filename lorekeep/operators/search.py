"""Search: filters, fusion, twin collapse, pages and snippets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnavailableError, ValidationError
from ..functions import concepts, redact, refs, text, times
from ..schema import CANONICAL_TYPES, SUMMARY_KINDS, TOOLS
from . import lexical, vector
from .index import Index

# Limits of the query surface.
LIMITS = {"limit": (1, 50), "max_snippet_chars": (1, 1000), "sessions": (1, 100), "session_limit": (1, 500), "context": (0, 500), "cursor": (0, 10_000)}
SNIPPET = 500
RRF_K = 60
EXTRA = 500


def bounded(name: str, value: int, strict: bool = False) -> int:
    """value within the limits of name; strict rejects what is outside."""
    low, high = LIMITS[name]
    if strict and not low <= value <= high:
        raise ValidationError(f"{name} must be between {low} and {high}")
    return max(low, min(high, value))


@dataclass
class Filters:
    """What rows a search may return. None and empty mean no filter."""

    tool: str | None = None
    session: str | None = None
    cwd: str | None = None
    since: str | None = None
    canonical_type: str | None = None
    include_deltas: bool = False
    file: str | None = None
    command: str | None = None
    ref: str | None = None

    def count(self) -> int:
        return sum(bool(x) for x in (self.tool and self.tool != "all", self.session, self.cwd, self.since, self.canonical_type, self.file, self.command, self.ref))


@dataclass
class Tables:
    """Derived tables beside the events; only those that a filter needs must be there."""

    events: DataFrame
    sessions: DataFrame | None = None
    files: DataFrame | None = None
    tools: DataFrame | None = None
    refs: DataFrame | None = None
    units: DataFrame | None = None
    index: Index | None = None
    key: str = "dedupe_key"
    extra: dict = field(default_factory=dict)


def session_tier(sessions: DataFrame, wanted: str, tool: str | None = None) -> DataFrame:
    """Ids that `wanted` means: equal ids, else equal file-name ids, else ids that begin with it; of the first kind that has any."""
    rows = sessions if not tool or tool == "all" else sessions.where(F.col("tool") == tool)
    tier = (
        F.when(F.col("session_id") == wanted, 1)
        .when(F.col("filename_session_id") == wanted, 2)
        .when(F.col("session_id").startswith(wanted), 3)
    )
    found = rows.select("session_id", tier.alias("tier")).where("tier is not null").distinct()
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best"), "left_semi").select("session_id").distinct()


def apply_filters(rows: DataFrame, f: Filters, t: Tables) -> DataFrame:
    """rows that pass every filter; memberships are semi-joins."""
    if f.tool and f.tool != "all":
        if f.tool not in TOOLS:
            raise ValidationError(f"unknown tool: {f.tool}")
        rows = rows.where(F.col("tool") == f.tool)
    if f.cwd:
        rows = rows.where(F.col("cwd") == f.cwd)
    if f.since:
        rows = rows.where(F.col("captured_at") >= times.threshold(f.since))
    if f.canonical_type:
        rows = rows.where(F.col("canonical_type") == f.canonical_type)
    if not f.include_deltas:
        rows = rows.where("canonical_type <> 'assistant.delta'")
    if f.session:
        rows = rows.join(session_tier(t.sessions, f.session, f.tool), "session_id", "left_semi")
    if f.file:
        hit = (F.col("path") == f.file) | text.like_ascii_fold(F.col("path"), f"%{f.file}%")
        rows = rows.join(t.files.where(hit).select(t.key), t.key, "left_semi")
    if f.command:
        rows = rows.join(t.tools.where(text.like_ascii_fold(F.col("command"), f"%{f.command}%")).select(t.key), t.key, "left_semi")
    if f.ref:
        kind, value = refs.normalize(f.ref)
        hit = (F.col("kind") == kind) & (F.col("value") == value if kind == "pr" else F.col("value").startswith(value))
        rows = rows.join(t.refs.where(hit).select(t.key), t.key, "left_semi")
    return rows


def order(score: str = "score") -> list[Column]:
    """Best first; ties to the later event, then the earlier line. Scores are rounded, so equal sums in other orders tie."""
    return [F.desc(F.round(F.col(score), 9)), F.desc("captured_at"), F.asc("raw_line"), F.asc("session_id")]


def overfetch(offset: int, limit: int) -> int:
    """How many ranked rows to collapse for a page, as twins shrink them."""
    window = offset + limit
    return window + max(min(window, EXTRA), limit)


def top(rows: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best with `rank` from 1. Only these n rows, a bound of the page, meet in one task."""
    best = rows.orderBy(*order(score)).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order(score))))


def indexed(t: Tables, terms: list[str], f: Filters, n: int) -> list[tuple[int, int, float]]:
    """Keys and scores of indexed rows that pass every filter, the n best among them. Tool, type, deltas and time are tested beside the postings; the
    other filters name the rows that count."""
    tool = f.tool if f.tool and f.tool != "all" else None
    if tool is not None and tool not in TOOLS:
        raise ValidationError(f"unknown tool: {tool}")
    kind = f.canonical_type if f.canonical_type in CANONICAL_TYPES else None
    members = None
    if f.session or f.cwd or f.file or f.command or f.ref or (f.canonical_type and kind is None):
        members = apply_filters(t.index.rows(), f, t).select("seg", "__doc")
    return t.index.best(terms, n, tool=tool, canonical_type=kind, deltas=f.include_deltas, since=times.threshold(f.since) if f.since else None, members=members)


def fuse(lexical_rows: DataFrame, vector_rows: DataFrame, key: str) -> DataFrame:
    """(key, score): reciprocal ranks of both lists summed. Each has (key, rank)."""
    both = lexical_rows.select(key, "rank").unionByName(vector_rows.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def collapse(ranked: DataFrame, searchable: str = "searchable_text") -> DataFrame:
    """Of rows that share session, type and text but for white space, the best ranked, with the lines of the others in order of rank."""
    twin = ["session_id", "canonical_type", text.whitespace_key(F.col(searchable))]
    w = Window.partitionBy(*twin).orderBy("rank")
    whole = Window.partitionBy(*twin)
    also = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "raw_line")).over(whole)), lambda x: x["rank"] > F.col("rank")), lambda x: x["raw_line"])
    return ranked.withColumn("__n", F.row_number().over(w)).withColumn("also_at", also).where("__n = 1").drop("__n")


@dataclass
class Page:
    """One page of results. total is None when more were ranked than fetched."""

    rows: DataFrame
    total: int | None
    returned: int
    next_cursor: int | None
    mode: str


def search(t: Tables, query: str, filters: Filters | None = None, mode: str = "auto", limit: int = 10, offset: int = 0, max_snippet_chars: int = SNIPPET,
           expand: bool = False, embedder: vector.Embedder | None = None, redacted: bool = False) -> Page:
    """Rank all events, filter, fuse with vectors if asked for, collapse twins and cut a page; snippets are made for its rows only."""
    limit, max_snippet_chars = bounded("limit", limit), bounded("max_snippet_chars", max_snippet_chars)
    filters = filters or Filters()
    if mode not in ("auto", "lexical", "hybrid"):
        raise ValidationError(f"unknown mode: {mode}")
    able = embedder is not None and t.units is not None and not t.units.limit(1).isEmpty()
    if mode == "hybrid" and not able:
        raise UnavailableError("hybrid search needs an embedder and embedded units")
    used = "hybrid" if able and mode != "lexical" else "lexical"
    terms = text.query_terms(query)
    terms = concepts.expand(terms) if expand else terms
    fetch = overfetch(offset, limit)
    if t.index is not None:
        best = indexed(t, terms, filters, fetch + 1)
        ranked, overflow = (top(t.index.fetched(best), fetch + 1) if best else t.events.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})), len(best) > fetch
    else:
        ranked, overflow = top(apply_filters(lexical.rank(lexical.tokenized(t.events), terms), filters, t), fetch + 1), None
    if used == "hybrid":
        near = apply_filters(t.events.join(t.units, t.key), filters, t)
        point = embedder.embed_query(vector.QUERY_PREFIX + query)
        for k in vector.adaptive_k(fetch, filters.count()):
            units = vector.nearest(near, point, k, key=t.key).select(t.key, "distance").cache()
            each = units.groupBy(t.key).agg(F.min("distance").alias("distance"))
            if units.count() < k or each.count() >= fetch:
                break
            units.unpersist()
        near = each.withColumn("rank", F.row_number().over(Window.orderBy("distance", t.key)))
        fused = fuse(ranked, near, t.key)
        ranked, overflow = top(t.events.join(F.broadcast(fused), t.key), fetch + 1), None
    if overflow is None:
        ranked = ranked.cache()
        overflow = ranked.count() > fetch
    kept = collapse(ranked.where(F.col("rank") <= fetch)).orderBy("rank").collect()
    page = kept[offset : offset + limit]
    rows = []
    for r in page:
        cut = text.snippet(r["searchable_text"] or "", terms, max_snippet_chars)
        rows.append((r["tool"], r["session_id"], r["raw_file"], r["raw_line"], r["captured_at"], r["canonical_type"], SUMMARY_KINDS.get(r["canonical_type"]), float(r["score"]),
                     redact.redact_text(cut) if redacted else cut, r["also_at"], r[t.key]))
    schema = f"tool string, session_id string, raw_file string, raw_line long, captured_at string, canonical_type string, summary_kind string, score double, snippet string, also_at array<long>, {t.key} string"
    following = offset + len(page)
    more = following < len(kept) or overflow
    return Page(t.events.sparkSession.createDataFrame(rows, schema), None if overflow else len(kept), len(page), following if more and page else None, used)


def hydrate(page: DataFrame, events: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """A page with its events' payloads; only the page's keys are sent."""
    return events.select(key, "payload").join(F.broadcast(page), key)
