"""Queries over the driver tables, each with the SQL that another engine checks it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import paths
from ..functions import concepts, redact, refs, text
from ..operators import derive, document, lexical, maintain, search, sessions, vector
from ..operators.index import Index
from ..schema import sanitize_session_id, SUMMARY_KINDS
from ..streaming import incremental
from . import oracle, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TALK = ["user_text", "assistant_text", "metadata_text"]
WORDS = ["the", "that", "moron"]
KEY = ["session_id", "raw_line"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_INDEXES: dict[tuple[str, ...], Index] = {}

VIEWS = {
    "conversations": (views.conversations, tuple(TALK)),
    "documents": (views.documents, ("metadata_text",)),
    "decorated": (lambda spark, sf_dir: views.documents(spark, sf_dir, True), ("metadata_text",)),
}


def index(spark: SparkSession, sf_dir: str, view: str) -> Index:
    """The view's index in the shared folder, built where a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(spark, sf_dir, view)
    return _INDEXES[key]


def build_index(spark: SparkSession, sf_dir: str, view: str) -> Index:
    rows, columns = VIEWS[view]
    built = Index(spark, f"{paths.shared_folder(spark)}/index-{view}-{uuid.uuid4().hex}", columns)
    built.add(rows(spark, sf_dir))
    return built


def scored(spark: SparkSession, sf_dir: str, terms: list[str], view: str = "conversations") -> DataFrame:
    return index(spark, sf_dir, view).rank(terms)


def hits(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*KEY, *more, F.round("score", 6).alias("score"))


def hits_sql(terms: list[str], where: str = "TRUE", view: str = views.CONVERSATIONS, columns: list[str] = TALK, more: str = "") -> str:
    return f"WITH {oracle.bm25(view, columns, terms)} SELECT session_id, raw_line, {more}round(score, 6) AS score FROM scored WHERE {where}"


# ranking


@query("search_bm25", hits_sql(WORDS, more="canonical_type, captured_at, "))
def search_bm25(spark, sf_dir):
    return hits(scored(spark, sf_dir, WORDS), "canonical_type", "captured_at")


@query("search_bm25_documents", hits_sql(["license", "idiot", "der"], view=views.documents_sql(), columns=["metadata_text"]))
def search_bm25_documents(spark, sf_dir):
    return hits(scored(spark, sf_dir, ["license", "idiot", "der"], "documents"))


@query("search_bm25_unindexed", hits_sql(WORDS))
def search_bm25_unindexed(spark, sf_dir):
    return hits(lexical.rank(lexical.tokenized(views.conversations(spark, sf_dir), tuple(TALK)), WORDS))


@query(
    "search_index_terms",
    f"""WITH {views.documents_sql()}, t AS (SELECT doc_id, unnest({oracle._tokens('metadata_text')}) AS term FROM ev) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term""",
)
def search_index_terms(spark, sf_dir):
    """Builds the index anew; its terms, with their rows and occurrences."""
    built = build_index(spark, sf_dir, "documents")
    return built.terms().select("term", "df").join(built.occurrences(), "term")


_LEFT = views.CONVERSATIONS.replace("ev AS", "ev0 AS", 1) + ", ev AS (SELECT * FROM ev0 WHERE raw_line % 7 <> 3)"


@query("search_index_tiers", f"WITH {oracle.bm25(_LEFT, TALK, ['of_the', 'moron', 'that'])} SELECT session_id, raw_line, round(score, 6) AS score FROM scored")
def search_index_tiers(spark, sf_dir):
    """Ten appends with merges, deletions, and a merge after them: the scores of an index of what is left."""
    rows = views.conversations(spark, sf_dir)
    grown = Index(spark, f"{paths.shared_folder(spark)}/tiers-{uuid.uuid4().hex}", tuple(TALK))
    for k in range(10):
        grown.add(rows.where(F.pmod(F.hash("dedupe_key"), F.lit(10)) == k))
        grown.compact()
    grown.delete(rows.where("raw_line % 7 = 3"))
    grown.compact()
    return hits(grown.rank(["of_the", "moron", "that"]))


@query("search_repeated_term", hits_sql(["idiot", "that", "idiot"]))
def search_repeated_term(spark, sf_dir):
    return hits(scored(spark, sf_dir, ["idiot", "that", "idiot"]))


@query("search_phrase_underscore", hits_sql(["of_the", "that"]))
def search_phrase_underscore(spark, sf_dir):
    return hits(scored(spark, sf_dir, text.query_terms("of_the that")))


@query("search_concept_expand", hits_sql(concepts.expand(["Bug", "auth"]), view=views.documents_sql(True), columns=["metadata_text"]))
def search_concept_expand(spark, sf_dir):
    return hits(scored(spark, sf_dir, concepts.expand(["Bug", "auth"]), "decorated"))


# filters; statistics cover all rows


def filtered(name: str, filters: search.Filters, where: str) -> None:
    def run(spark, sf_dir):
        t = search.Tables(views.conversations(spark, sf_dir))
        t.sessions = t.events.select("tool", "session_id", "filename_session_id").distinct()
        return hits(search.apply_filters(scored(spark, sf_dir, WORDS), filters, t))

    query(name, hits_sql(WORDS, where))(run)


filtered("search_filter_tool", search.Filters(tool="claude"), "tool = 'claude'")
filtered("search_filter_session", search.Filters(session="conv-7"), "session_id = 'conv-7'")
filtered("search_filter_since", search.Filters(since="2024-01-15"), "captured_at >= '2024-01-15T00:00:00Z'")
filtered("search_filter_type", search.Filters(canonical_type="user.message"), "canonical_type = 'user.message'")
filtered("search_filter_no_delta", search.Filters(tool="all"), "canonical_type <> 'assistant.delta'")
filtered("search_session_prefix_tier", search.Filters(session="conv-7"), "CASE WHEN (SELECT count(*) FROM ev WHERE session_id = 'conv-7') > 0 THEN session_id = 'conv-7' ELSE starts_with(session_id, 'conv-7') END")
filtered("search_session_prefix_only", search.Filters(session="conv-"), "starts_with(session_id, 'conv-')")


@query("search_filter_ref", f"WITH {views.documents_sql(True)} SELECT doc_id FROM ev WHERE list_contains(regexp_extract_all(searchable_text, '{refs.PR_HASH}', 1), '42')")
def search_filter_ref(spark, sf_dir):
    rows = views.documents(spark, sf_dir, True).withColumn("payload", F.lit(None).cast("string"))
    t = search.Tables(rows, refs=derive.event_refs(rows))
    return search.apply_filters(rows, search.Filters(ref="#042"), t).select("doc_id")


@query("search_filter_file", f"WITH {views.EVENTS} SELECT event_id FROM ev WHERE lower(path) LIKE '%part_3.csv%'")
def search_filter_file(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    t = search.Tables(rows, files=rows.where("path is not null").select("dedupe_key", "path"))
    return search.apply_filters(rows, search.Filters(file="PART_3.csv"), t).select("event_id")


@query("search_filter_command", f"WITH {views.EVENTS} SELECT event_id FROM ev WHERE lower(command) LIKE '%run --k=1%'")
def search_filter_command(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    t = search.Tables(rows, tools=rows.where("command is not null").select("dedupe_key", "command"))
    return search.apply_filters(rows, search.Filters(command="run --K=1"), t).select("event_id")


# pages


@query(
    "search_twin_collapse",
    f"""WITH {oracle.bm25(views.documents_sql(), ['metadata_text'], ['the', 'der'])}, r AS (SELECT *, row_number() OVER (ORDER BY {oracle.ORDER}) AS rank FROM scored),
  k AS (SELECT *, sha256(trim(regexp_replace(searchable_text, '\\s+', ' ', 'g'))) AS twin FROM r), c AS (SELECT *, row_number() OVER (PARTITION BY session_id, canonical_type, twin ORDER BY rank) AS n FROM k)
  SELECT a.doc_id, a.session_id, coalesce((SELECT string_agg(cast(b.raw_line AS VARCHAR), ',' ORDER BY b.rank) FROM c b WHERE b.session_id = a.session_id AND b.twin = a.twin AND b.rank > a.rank), '') AS also_at FROM c a WHERE n = 1""",
)
def search_twin_collapse(spark, sf_dir):
    rows = scored(spark, sf_dir, ["the", "der"], "documents")
    # rows of a twin group are ordered among themselves, so no rank over all rows is needed
    twin = ["session_id", "canonical_type", text.whitespace_key(F.col("searchable_text"))]
    w = Window.partitionBy(*twin).orderBy(*search.order())
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return search.collapse(ranked).select("doc_id", "session_id", F.array_join(F.col("also_at").cast("array<string>"), ",").alias("also_at"))


@query("search_page", f"WITH {oracle.bm25(views.CONVERSATIONS, TALK, WORDS)}, r AS (SELECT *, row_number() OVER (ORDER BY {oracle.ORDER}) AS rank FROM scored) SELECT rank, session_id, raw_line, round(score, 6) AS score FROM r WHERE rank > 10 AND rank <= 20")
def search_page(spark, sf_dir):
    n = search.overfetch(10, 10)
    ranked = search.top(index(spark, sf_dir, "conversations").top(WORDS, n), n)
    return hits(ranked.where("rank > 10 and rank <= 20"), "rank")


@query("search_top_k", f"WITH {oracle.bm25(views.CONVERSATIONS, TALK, ['with', 'from'])}, r AS (SELECT *, row_number() OVER (ORDER BY {oracle.ORDER}) AS rank FROM scored) SELECT rank, session_id, raw_line, round(score, 6) AS score FROM r WHERE rank <= 25")
def search_top_k(spark, sf_dir):
    return hits(search.top(index(spark, sf_dir, "conversations").top(["with", "from"], 25), 25), "rank")


def _page_sql(limit: int) -> str:
    """Hits of a page of `the moron`: ranked, twins collapsed among what is fetched, then cut."""
    return (
        f"{oracle.bm25(views.CONVERSATIONS, TALK, ['the', 'moron'])}, r AS (SELECT *, row_number() OVER (ORDER BY {oracle.ORDER}) AS place FROM scored QUALIFY place <= {search.overfetch(0, limit)}),"
        " o AS (SELECT *, row_number() OVER (PARTITION BY session_id, canonical_type, trim(regexp_replace(searchable_text, '\\s+', ' ', 'g')) ORDER BY place) AS twin FROM r),"
        f" h AS (SELECT *, row_number() OVER (ORDER BY place) AS rank FROM o WHERE twin = 1 QUALIFY rank <= {limit})"
    )


#: A snippet by characters, where text is ASCII: the first place of a term in the middle of 80, or the text's end.
_SNIPPET = """CASE WHEN strlen(searchable_text) <= 80 THEN trim(searchable_text) ELSE trim(substr(searchable_text, 1 + greatest(0, least(spot - (80 - size) // 2, strlen(searchable_text) - 80)), 80)) END"""


@query(
    "search_snippet",
    f"""WITH {_page_sql(20)}, p AS (SELECT *, strpos(lower(searchable_text), 'the') AS a, strpos(lower(searchable_text), 'moron') AS b FROM h),
  q AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN b = 0 OR (a > 0 AND a < b) THEN a - 1 ELSE b - 1 END AS spot, CASE WHEN a = 0 AND b = 0 THEN 0 WHEN b = 0 OR (a > 0 AND a < b) THEN 3 ELSE 5 END AS size FROM p)
  SELECT session_id, raw_line, CASE WHEN strlen(searchable_text) = length(searchable_text) THEN {_SNIPPET} END AS snippet, true AS fits FROM q""",
)
def search_snippet(spark, sf_dir):
    """Snippets of a page; SQL states those of texts in ASCII, tests those of others."""
    t = search.Tables(views.conversations(spark, sf_dir), index=index(spark, sf_dir, "conversations"))
    page = search.search(t, "the moron", limit=20, max_snippet_chars=80)
    whole = t.events.select(*KEY, F.col("searchable_text").alias("whole")).join(F.broadcast(page.rows.select(*KEY, "snippet")), KEY)  # a page
    plain = F.octet_length("whole") == F.char_length("whole")
    return whole.select(*KEY, F.when(plain, F.col("snippet")).alias("snippet"), (F.octet_length("snippet") <= 80).alias("fits"))


@query("search_page_indexed", f"WITH {_page_sql(10)} SELECT session_id, raw_line, round(score, 6) AS score FROM h")
def search_page_indexed(spark, sf_dir):
    t = search.Tables(views.conversations(spark, sf_dir), index=index(spark, sf_dir, "conversations"))
    return hits(search.search(t, "the moron").rows)


# vectors

_VECTORS = "SELECT vec_id, label, 1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _point(spark, sf_dir) -> list[float]:
    return views.table(spark, sf_dir, "embeddings").where("vec_id = 0").head().embedding


@query("knn_cosine", f"SELECT vec_id, round(d, 6) + 0 AS distance, round(1 / (1 + d), 6) AS score FROM ({_VECTORS}) ORDER BY d, vec_id LIMIT 20")
def knn_cosine(spark, sf_dir):
    near = vector.nearest(views.table(spark, sf_dir, "embeddings"), _point(spark, sf_dir), 20)
    return near.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.round("score", 6).alias("score"))


@query("knn_filtered", f"SELECT vec_id, round(d, 6) + 0 AS distance FROM ({_VECTORS}) WHERE label = 3 ORDER BY d, vec_id LIMIT 15")
def knn_filtered(spark, sf_dir):
    near = vector.nearest(views.table(spark, sf_dir, "embeddings"), _point(spark, sf_dir), 15, where=F.col("label") == 3)
    return near.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    "rrf_fuse",
    f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM ({_VECTORS}) ORDER BY d, vec_id LIMIT 30), b AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS rank FROM embeddings ORDER BY label, vec_id LIMIT 40)
  SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.vec_id = b.vec_id""",
)
def rrf_fuse(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    near = vector.nearest(vectors, _point(spark, sf_dir), 30).withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id")))
    first = vectors.orderBy("label", "vec_id").limit(40).withColumn("rank", F.row_number().over(Window.orderBy("label", "vec_id")))
    return search.fuse(near, first, "vec_id").select("vec_id", F.round("score", 9).alias("score"))


class _Point:
    """An embedder that knows one vector."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.vector for _ in texts]

    def embed_query(self, text: str) -> list[float]:
        return self.vector


@query(
    "search_hybrid_page",
    f"""WITH {oracle.bm25(views.CONVERSATIONS, TALK, ['the', 'moron'])}, x AS (SELECT dedupe_key, row_number() OVER (ORDER BY {oracle.ORDER}) AS rank FROM scored QUALIFY rank <= 21),
  v AS (SELECT dedupe_key, row_number() OVER (ORDER BY d, dedupe_key) AS rank FROM ev JOIN (SELECT 'conv:' || vec_id || ':0' AS k, d FROM ({_VECTORS})) ON dedupe_key = k QUALIFY rank <= 40),
  u AS (SELECT dedupe_key, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM v) GROUP BY dedupe_key),
  r AS (SELECT ev.*, u.score, row_number() OVER (ORDER BY {oracle.ORDER.replace('score', 'u.score')}) AS place FROM ev JOIN u USING (dedupe_key) QUALIFY place <= 20),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id, canonical_type, trim(regexp_replace(searchable_text, '\\s+', ' ', 'g')) ORDER BY place) AS twin FROM r)
  SELECT session_id, raw_line, round(score, 6) AS score FROM o WHERE twin = 1 ORDER BY place LIMIT 10""",
)
def search_hybrid_page(spark, sf_dir):
    rows = views.conversations(spark, sf_dir)
    units = views.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("conv:"), F.col("vec_id").cast("string"), F.lit(":0")).alias("dedupe_key"), "embedding")
    page = search.search(search.Tables(rows, units=units, index=index(spark, sf_dir, "conversations")), "the moron", mode="hybrid", embedder=_Point(_point(spark, sf_dir)))
    return hits(page.rows)


@query(
    "embedding_units",
    f"""WITH {views.CONVERSATIONS}, u AS (SELECT dedupe_key, 'user_text' AS unit_kind, trim(user_text) AS t FROM ev UNION ALL SELECT dedupe_key, 'assistant_text', trim(assistant_text) FROM ev UNION ALL SELECT dedupe_key, 'metadata_text', trim(metadata_text) FROM ev)
  SELECT dedupe_key, unit_kind, sha256(t) AS text_hash FROM u WHERE t <> ''""",
)
def embedding_units(spark, sf_dir):
    return vector.embedding_units(views.conversations(spark, sf_dir)).select("dedupe_key", "unit_kind", "text_hash")


# sessions


@query("session_counts", f"""WITH {views.EVENTS} SELECT tool, session_id, count(*) AS event_count, count(*) FILTER (WHERE canonical_type = 'tool.result') AS message_count,
  count(*) FILTER (WHERE canonical_type IN ('tool.call', 'tool.result')) AS tool_event_count, CAST(0 AS BIGINT) AS compaction_count FROM ev GROUP BY ALL""")  # fmt: skip
def session_counts(spark, sf_dir):
    return sessions.counts(views.events(spark, sf_dir))


@query("session_bounds", f"WITH {views.EVENTS} SELECT tool, session_id, min(captured_at) AS started_at, max(captured_at) AS updated_at, arg_min(cwd, raw_line) FILTER (WHERE cwd IS NOT NULL) AS cwd FROM ev GROUP BY tool, session_id")
def session_bounds(spark, sf_dir):
    return sessions.bounds(views.events(spark, sf_dir)).select("tool", "session_id", "started_at", "updated_at", "cwd")


_PROMPT = "CASE WHEN length(trim(p)) > 200 THEN rtrim(substr(trim(p), 1, 200)) || '…' ELSE nullif(trim(p), '') END"


@query("first_user_prompt", f"WITH {views.CONVERSATIONS}, f AS (SELECT tool, session_id, arg_min(user_text, sequence) AS p FROM ev WHERE canonical_type = 'user.message' GROUP BY ALL) SELECT tool, session_id, {_PROMPT} AS first_user_prompt FROM f")
def first_user_prompt(spark, sf_dir):
    return sessions.first_prompts(views.conversations(spark, sf_dir))


@query("last_event_type", f"WITH {views.EVENTS} SELECT tool, session_id, arg_max(canonical_type, raw_line) AS last_event_type FROM ev GROUP BY ALL")
def last_event_type(spark, sf_dir):
    return sessions.last_types(views.events(spark, sf_dir))


@query("latest_per_tool", f"WITH {views.EVENTS} SELECT tool, session_id, captured_at, raw_line, canonical_type FROM ev QUALIFY row_number() OVER (PARTITION BY tool ORDER BY captured_at DESC, raw_line DESC, session_id DESC) = 1")
def latest_per_tool(spark, sf_dir):
    return sessions.latest_per_tool(views.events(spark, sf_dir))


def _top_sql(column: str, where: str = "TRUE") -> str:
    return f"WITH {views.EVENTS}, c AS (SELECT tool, session_id, {column}, count(*) AS n FROM ev WHERE {column} IS NOT NULL AND {where} GROUP BY ALL) SELECT tool, session_id, {column}, n, row_number() OVER (PARTITION BY tool, session_id ORDER BY n DESC, {column}) AS place FROM c QUALIFY place <= 5"


@query("top_tools", _top_sql("tool_name"))
def top_tools(spark, sf_dir):
    return sessions.top_values(views.events(spark, sf_dir), "tool_name")


@query("top_files", _top_sql("path"))
def top_files(spark, sf_dir):
    return sessions.top_values(views.events(spark, sf_dir), "path")


@query(
    "list_sessions_triage",
    f"""WITH {views.EVENTS}, s AS (SELECT tool, session_id, count(*) AS event_count, min(captured_at) AS started_at, max(captured_at) AS updated_at, arg_max(canonical_type, raw_line) AS last_event_type FROM ev GROUP BY tool, session_id),
  t AS ({_top_sql('tool_name').replace('WITH ' + views.EVENTS + ', c AS', 'WITH c AS')}), f AS ({_top_sql('path').replace('WITH ' + views.EVENTS + ', c AS', 'WITH c AS')}),
  tl AS (SELECT tool, session_id, string_agg(tool_name || '=' || n, ',' ORDER BY place) AS top_tools FROM t GROUP BY ALL), fl AS (SELECT tool, session_id, string_agg(path || '=' || n, ',' ORDER BY place) AS top_files FROM f GROUP BY ALL)
  SELECT s.*, top_tools, top_files FROM s LEFT JOIN tl USING (tool, session_id) LEFT JOIN fl USING (tool, session_id) ORDER BY updated_at DESC, tool, session_id LIMIT 50""",
)
def list_sessions_triage(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    out = sessions.triage(rows, tools=rows, files=rows)
    return out.select("tool", "session_id", "event_count", "started_at", "updated_at", "last_event_type", "top_tools", "top_files")


@query("session_page", f"WITH {views.EVENTS} SELECT event_id, raw_line FROM ev WHERE tool = 'claude' AND session_id = 'user-100' AND raw_line > 5 ORDER BY raw_line LIMIT 20")
def session_page(spark, sf_dir):
    rows, _, _ = sessions.session_page(views.events(spark, sf_dir), "claude", "user-100", limit=20, after_raw_line=5)
    return rows.select("event_id", "raw_line")


@query("session_window", f"WITH {views.EVENTS} SELECT event_id, raw_line FROM ev WHERE tool = 'claude' AND session_id = 'user-100' AND raw_line BETWEEN 7 AND 14")
def session_window(spark, sf_dir):
    rows, _, _ = sessions.session_page(views.events(spark, sf_dir), "claude", "user-100", around_raw_line=10, before=3, after=4)
    return rows.select("event_id", "raw_line")


_HITS = f"{oracle.bm25(views.CONVERSATIONS, TALK, ['moron', 'with'])}, h AS (SELECT tool, session_id, raw_line, row_number() OVER (ORDER BY {oracle.ORDER}) AS rank FROM scored QUALIFY rank <= 40)"


def _hits(spark, sf_dir) -> DataFrame:
    return search.top(scored(spark, sf_dir, ["moron", "with"]), 40).select("tool", "session_id", "raw_line", "rank")


@query(
    "context_window_merge",
    f"""WITH {_HITS}, w AS (SELECT tool, session_id, greatest(raw_line - 1, 1) AS s, raw_line + 1 AS e FROM h), m AS (SELECT *, max(e) OVER (PARTITION BY tool, session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM w),
  g AS (SELECT *, sum(CASE WHEN s <= reached + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY tool, session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT tool, session_id, min(s) AS start_line, max(e) AS end_line FROM g GROUP BY tool, session_id, island""",
)
def context_window_merge(spark, sf_dir):
    return sessions.merged_windows(_hits(spark, sf_dir), 1, 1)


@query(
    "recall_answer",
    f"""WITH {_HITS} SELECT ev.session_id, ev.raw_line, min(rank) AS hit_rank FROM ev JOIN h ON ev.tool = h.tool AND ev.session_id = h.session_id AND ev.raw_line BETWEEN greatest(h.raw_line - 2, 1) AND h.raw_line + 2 GROUP BY ev.session_id, ev.raw_line""",
)
def recall_answer(spark, sf_dir):
    return sessions.context(_hits(spark, sf_dir), views.conversations(spark, sf_dir), 2, 2).select(*KEY, "hit_rank")


@query(
    "recall_answer_page",
    f"""WITH {_page_sql(5)}, c AS (SELECT ev.session_id, ev.raw_line, min(rank) AS rank FROM ev JOIN h ON ev.tool = h.tool AND ev.session_id = h.session_id AND ev.raw_line BETWEEN greatest(h.raw_line - 2, 1) AND h.raw_line + 2 GROUP BY ev.session_id, ev.raw_line)
  SELECT h.rank, h.session_id, h.raw_line, (SELECT count(*) FROM c WHERE c.rank = h.rank) AS n_context FROM h""",
)
def recall_answer_page(spark, sf_dir):
    out = sessions.recall_answer(search.Tables(views.conversations(spark, sf_dir)), "the moron", limit=5)
    return out.select("rank", *KEY, F.coalesce(F.size("context"), F.lit(0)).cast("long").alias("n_context"))


# shaping


@query("canonicalize_events", f"WITH {views.EVENTS} SELECT event_id, canonical_type, CASE canonical_type WHEN 'tool.call' THEN 'started' WHEN 'tool.result' THEN 'completed' END AS status, CASE canonical_type WHEN 'tool.result' THEN 'tool' END AS role FROM ev")
def canonicalize_events(spark, sf_dir):
    from ..operators import canonical

    kind = F.col("canonical_type")
    return views.events(spark, sf_dir).select("event_id", kind, canonical.tool_status(kind).alias("status"), canonical.role(kind).alias("role"))


@query("summary_kind", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'session_start' END AS summary_kind FROM events")
def summary_kind(spark, sf_dir):
    from ..operators import canonical

    assert SUMMARY_KINDS["session.started"] == "session_start"
    return views.events(spark, sf_dir).select("event_id", canonical.summary_kind(F.col("canonical_type")).alias("summary_kind"))


@query("json_pointer_extract", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text FROM events")
def json_pointer_extract(spark, sf_dir):
    from ..functions import pointers

    v = F.col("v")
    rows = views.table(spark, sf_dir, "events").withColumn("v", pointers.parsed(F.col("props")))
    return rows.select("event_id", pointers.long_at(v, "missing", "k").alias("k"), pointers.at(v, "k").alias("k_text"))


@query("dedupe_first_wins", "SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first_wins(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").where("text is not null").withColumn("dedupe_key", F.sha2("text", 256)).withColumn("raw_file", F.lit("d")).withColumn("raw_line", F.col("doc_id"))
    return derive.first_wins(rows.select("doc_id", "dedupe_key", "raw_file", "raw_line")).select("doc_id")


@query(
    "dedupe_key",
    f"SELECT event_id, 'sha256:' || sha256(concat('{document.DOMAIN}', chr(0), {views.TOOL_SQL.format('user_id')}, chr(0), 'user-' || user_id, chr(0), 'error', chr(0), CASE WHEN event_id % 2 = 0 THEN concat('native-id', chr(0), cast(event_id AS VARCHAR), chr(0)) ELSE concat('content', chr(0), sha256(props), chr(0), 'sequence', chr(0), cast(event_id AS VARCHAR), chr(0)) END)) AS dedupe_key FROM events",
)
def dedupe_key(spark, sf_dir):
    t = views.table(spark, sf_dir, "events")
    id_ = F.col("event_id").cast("string")
    key = document.dedupe_key(views._tool("user_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.lit("error"), F.when(F.col("event_id") % 2 == 0, id_), F.col("event_id"), F.sha2("props", 256))
    return t.select("event_id", key.alias("dedupe_key"))


@query(
    "extract_refs",
    f"""WITH {views.documents_sql(True)}, p AS (SELECT doc_id, 'pr' AS kind, '#' || regexp_replace(unnest(regexp_extract_all(searchable_text, '{refs.PR_HASH}', 1)), '^0+([0-9])', '\\1') AS value FROM ev),
  c AS (SELECT doc_id, 'commit' AS kind, lower(unnest(regexp_extract_all(searchable_text, '{refs.COMMIT}', 1))) AS value FROM ev) SELECT DISTINCT * FROM p UNION SELECT DISTINCT * FROM c WHERE regexp_matches(value, '[a-f]')""",
)
def extract_refs(spark, sf_dir):
    rows = views.documents(spark, sf_dir, True)
    return rows.select("doc_id", F.explode(refs.extract(F.col("searchable_text"))).alias("r")).select("doc_id", "r.kind", "r.value")


@query("normalize_ref", "SELECT doc_id, '#' || cast(doc_id AS VARCHAR) AS value FROM documents")
def normalize_ref(spark, sf_dir):
    id_ = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("org/repo#"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(id_))), id_)
    return views.table(spark, sf_dir, "documents").select("doc_id", refs.normalized(raw)["value"].alias("value"))


@query("redact_text", f"WITH {views.documents_sql(True)} SELECT doc_id, sha256({oracle.redacted('searchable_text')}) AS redacted FROM ev")
def redact_text(spark, sf_dir):
    return views.documents(spark, sf_dir, True).select("doc_id", F.sha2(redact.redact(F.col("searchable_text")), 256).alias("redacted"))


@query("whitespace_key", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM documents")
def whitespace_key(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.whitespace_key(F.col("text")).alias("key"))


@query("sanitize_session_id", "SELECT doc_id, sha256(CASE WHEN text = '' THEN '_' ELSE regexp_replace(text, '[^A-Za-z0-9._-]', '_', 'g') END) AS name FROM documents")
def sanitize(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(sanitize_session_id(F.col("text")), 256).alias("name"))


# joins, upkeep


@query("left_anti_new_events", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id = e.event_id AND s.event_type IN ('click', 'view'))")
def left_anti_new_events(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return derive.new_events(rows, rows.where("canonical_type in ('tool.call', 'tool.result')")).select("event_id")


@query("orphan_gc", "SELECT DISTINCT sha256(props) AS payload_ref FROM events WHERE sha256(props) NOT IN (SELECT sha256(props) FROM events WHERE event_type <> 'error' AND value > 400)")
def orphan_gc(spark, sf_dir):
    t = views.table(spark, sf_dir, "events").withColumn("payload_ref", F.sha2("props", 256))
    blobs = t.select("payload_ref").distinct()
    return maintain.orphans(blobs, t.where("event_type <> 'error' and value > 400"))


@query(
    "coverage_report",
    f"WITH {views.EVENTS} SELECT tool, session_id, count(*) AS on_disk, count(*) FILTER (WHERE value > 10) AS captured, count(*) - count(*) FILTER (WHERE value > 10) AS missing, count(*) FILTER (WHERE value > 10) > 0 AND count(*) > count(*) FILTER (WHERE value > 10) AS partial FROM ev GROUP BY tool, session_id",
)
def coverage_report(spark, sf_dir):
    rows = views.events(spark, sf_dir)
    return maintain.coverage(rows, rows.where("value > 10"))


@query(
    "freshness",
    f"""WITH {views.EVENTS}, f AS (SELECT tool, session_id, count(*) * 10 AS size, min(k) * 20 AS done FROM ev GROUP BY ALL) SELECT tool, cast(sum(size) AS BIGINT) AS raw_bytes, cast(sum(least(done, size)) AS BIGINT) AS indexed_bytes, count(*) FILTER (WHERE least(done, size) < size) AS pending_files FROM f GROUP BY tool""",
)
def freshness(spark, sf_dir):
    files = views.events(spark, sf_dir).groupBy("tool", F.col("session_id").alias("source_path")).agg((F.count(F.lit(1)) * 10).alias("size"), (F.min("k") * 20).alias("byte_offset"))
    return maintain.freshness(files.select("tool", "source_path", "size"), files)


@query("purge_before", f"WITH {views.EVENTS} SELECT event_id FROM ev WHERE captured_at >= '2024-01-02T00:00:00Z'")
def purge_before(spark, sf_dir):
    return maintain.purge_before(views.events(spark, sf_dir), "2024-01-02").select("event_id")


@query("purge_session", f"WITH {views.EVENTS} SELECT event_id FROM ev WHERE NOT (tool = 'claude' AND session_id = 'user-100')")
def purge_session(spark, sf_dir):
    return maintain.purge_session(views.events(spark, sf_dir), "claude", "user-100").select("event_id")


@query("export_markdown", f"WITH {views.CONVERSATIONS} SELECT raw_line, '## ' || canonical_type || ' conversations:' || raw_line || chr(10) || chr(10) || searchable_text || chr(10) AS value FROM ev WHERE tool = 'claude' AND session_id = 'conv-1'")
def export_markdown(spark, sf_dir):
    return maintain.export_markdown(views.conversations(spark, sf_dir), "claude", "conv-1")


@query("latency_percentile_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, min(value) FILTER (WHERE i = ceil((n - 1) * 0.95)) AS p95, min(value) FILTER (WHERE i = ceil((n - 1) * 0.99)) AS p99 FROM r GROUP BY event_type")
def latency_percentile_nearest_rank(spark, sf_dir):
    return maintain.nearest_rank_by_group(views.table(spark, sf_dir, "events"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})


@query("stream_incremental_index", "SELECT 'user-' || user_id AS session_id, count(*) AS event_count FROM events GROUP BY user_id")
def stream_incremental_index(spark, sf_dir):
    base = f"{paths.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = views.table(spark, sf_dir, "events").schema
    kept = incremental.stream_session_counts(spark, sf_dir, "events.parquet", schema, f"{base}/out", f"{base}/checkpoint", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return kept.select("session_id", "event_count")


@query(
    "precision_recall_at_k",
    """WITH r AS (SELECT lang AS query, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT lang AS query, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
  SELECT query, round(count(*) FILTER (WHERE rank <= 20) / 20.0, 6) AS precision, round(count(*) FILTER (WHERE rank <= 20) / count(*)::DOUBLE, 6) AS recall FROM g JOIN r USING (query, doc_id) GROUP BY query""",
)
def precision_recall_at_k(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 20")
    good = docs.join(views.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("query", "doc_id")
    out = maintain.precision_recall(ranked, good, "doc_id", 20)
    return out.select("query", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
