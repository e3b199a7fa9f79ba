"""Command line of a store: python -m lorekeep --home FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, server
from .errors import ValidationError
from .functions import times
from .operators import canonical, document, maintain, search, vector
from .operators.store import Home
from .schema import TOOLS, envelope_faults
from .sources import native, raw
from .streaming import incremental, tailing

WATCH_SECONDS, SNIPPET = 2, 240


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    p.add_argument("--home", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := sub.add_parser(name), [c.add_argument(*o, **kw) for o, kw in options]]
    flag = lambda name: ((name,), {"action": "store_true"})
    opt = lambda name, **kw: ((name,), kw)
    tool = opt("--tool", choices=TOOLS)
    add("init")
    add("ingest", opt("--tool", choices=TOOLS, required=True), opt("--file"), opt("--source", default="backfill", choices=native.FILE_SOURCES), flag("--index"))
    add("index", flag("--once"), flag("--watch"), opt("--passes", type=int, default=0))
    add("backfill", tool, opt("--path"), opt("--user-home"), opt("--since"), flag("--dry-run"))
    add("embed", opt("--chunk", type=int, default=100_000))
    add("search", opt("query"), opt("--tool", choices=(*TOOLS, "all")), opt("--session"), opt("--cwd"), opt("--since"), opt("--type"), opt("--file"), opt("--command", dest="ran"), opt("--ref"), flag("--include-deltas"),
        opt("--mode", default="auto", choices=("auto", "lexical", "hybrid")), opt("--limit", type=int, default=10), opt("--cursor", type=int, default=0), opt("--max-snippet-chars", type=int, default=SNIPPET), flag("--expand"), flag("--redact"), flag("--corroborate"))
    add("recall", opt("query"), opt("--limit", type=int, default=5))
    add("sessions", tool, opt("--cwd"), opt("--since"), opt("--limit", type=int, default=20))
    add("show", opt("tool", choices=TOOLS), opt("session"), opt("--limit", type=int, default=100), opt("--after-raw-line", type=int), flag("--redact"))
    add("tail", opt("tool", choices=TOOLS), opt("session"), flag("--follow"))
    add("export", opt("tool", choices=TOOLS), opt("session"), opt("--form", default="markdown", choices=("markdown", "jsonl")), flag("--no-redact"))
    add("purge", tool, opt("--session"), opt("--before"), flag("--all"), flag("--dry-run"), flag("--keep-model"), flag("--keep-config"))
    add("doctor", flag("--deep"))
    add("bench", opt("--file"), opt("--iterations", type=int, default=20), opt("--query", default="error"))
    add("serve")
    return p


def history(home: Home, lines: bool = False) -> api.History:
    events = home.store.events()
    if events is None:
        raise ValidationError("nothing is indexed yet")
    units, embedder = None, None
    if home.store.exists("vectors"):
        embedder = vector.HashingEmbedder()
        vectors = home.spark.read.parquet(f"{home.store.path}/vectors")
        units = vector.embedding_units(events).select("dedupe_key", "text_hash").join(vectors, "text_hash")
    return api.History(events, raw.scan_home(home.spark, home.path).where("complete") if lines else None, units, embedder, home.tables())


def _keyed(envelopes: DataFrame) -> DataFrame:
    rows = document.with_documents(envelopes)
    return rows if "captured_at" in rows.columns else rows.withColumn("captured_at", F.lit(None).cast("string"))


def ingest(home: Home, a) -> dict:
    if a.file:
        found = native.ingest_file(home.spark, a.tool, a.file, a.source)
    else:
        payload = sys.stdin.read()
        found = canonical.from_hooks(home.spark.createDataFrame([(a.tool, payload)], "tool string, payload string"))
    good = envelope_faults(_keyed(found)).where("fault is null")
    added = home.append(good).agg(F.coalesce(F.sum("lines"), F.lit(0))).head()[0]
    if a.index:
        incremental.detached(home.spark, home.path, home.store).join()
    return {"appended": added}


def index(home: Home, a) -> dict:
    done, n = {"events": 0}, 0
    if a.watch and not a.passes:
        tailing.watch(home.spark, home.path, home.store, f"{home.store.path}/watch", seconds=WATCH_SECONDS).awaitTermination()
    while True:
        done = incremental.index_once(home.spark, home.path, home.store) if not a.once else {"events": incremental.drain(home.spark, home.path, home.store)}
        n += 1
        if not a.watch or n == a.passes:
            return done
        time.sleep(WATCH_SECONDS)


def backfill(home: Home, a) -> dict:
    tools = (a.tool,) if a.tool else TOOLS
    since = times.threshold(a.since).removesuffix("Z") if a.since else None
    if a.path:
        if not a.tool:
            raise ValidationError("a path needs a tool")
        found = native.ingest_file(home.spark, a.tool, a.path)
    else:
        found = native.native_records(home.spark, a.user_home or "", tools, since)
    if found is None:
        return {"files": 0}
    rows = _keyed(found)
    if a.dry_run:
        report, preview = native.dry_run(rows, home.keys())
        return {"total": native.merged(report).head().asDict(), "sessions": [r.asDict() for r in report.limit(100).collect()], "would_import": preview.count()}
    return {"appended": home.append(envelope_faults(rows).where("fault is null")).agg(F.coalesce(F.sum("lines"), F.lit(0))).head()[0]}


def embed(home: Home, a) -> dict:
    units = vector.embedding_units(home.store.events())
    tell = lambda x: print(json.dumps(x), file=sys.stderr, flush=True)
    return {"embedded": vector.embed_pending(units, f"{home.store.path}/vectors", vector.HashingEmbedder(), a.chunk, tell)}


def tail(home: Home, a) -> None:
    path, at = raw.raw_path(home.path, a.tool, a.session), 0
    while True:
        with raw.opened(path) as f:
            at = 0 if f.size() < at else at  # a log that shrank is shown from its top
            f.seek(at)
            data = f.read()
        whole = data.rfind(b"\n") + 1 if a.follow else len(data)
        sys.stdout.write(data[:whole].decode("utf-8", "replace"))
        sys.stdout.flush()
        at += whole
        if not a.follow:
            return
        time.sleep(1)


def purge(home: Home, a) -> dict:
    if a.all:
        keep = ("model",) * a.keep_model + ("config",) * a.keep_config
        return {"entries": home.purge_all(a.dry_run, keep)}
    if a.dry_run:
        raise ValidationError("a dry run is for --all")
    return home.purge(a.tool, a.session, a.before)


def doctor(home: Home, a) -> dict:
    out: dict = {"health": home.health(a.deep)}
    if home.store.events() is not None:
        own = home.store.checkpoints()
        files = home.logs().select(F.regexp_extract("raw_file", "/raw/([^/]+)/[^/]+$", 1).alias("tool"), F.col("raw_file").alias("source_path"), "size")
        plain = own.withColumn("source_path", F.regexp_replace("source_path", "^file:/+", "/") if home.path.startswith("/") else F.col("source_path"))
        fs, p = home._fs()
        out |= history(home).history_doctor(files, plain, a.deep, fs.getContentSummary(p).getLength())
    return out


def bench(home: Home, a) -> dict:
    """Seconds of an append for each event of a file, and of searches, at the nearest ranks of the release gates."""
    out: dict = {}
    taken = lambda n, f: sorted((began := time.perf_counter(), f(), time.perf_counter() - began)[2] for _ in range(n))
    ranks = lambda xs, p95, p99: {"p95": maintain.nearest_rank(xs, 0.95), "p99": maintain.nearest_rank(xs, 0.99), "within": maintain.nearest_rank(xs, 0.95) < p95 and maintain.nearest_rank(xs, 0.99) < p99}
    if a.file:
        rows = _keyed(canonical.from_hooks(native.bench_events(home.spark, a.file))).cache()
        n = max(1, rows.count())
        out["ingest_seconds_an_event"] = ranks([t / n for t in taken(a.iterations, lambda: home.append(rows).count())], 0.05, 0.25)
    if home.store.events() is not None:
        found = history(home)
        out["search_seconds"] = ranks(taken(a.iterations, lambda: found.search_history(a.query)), 0.2, float("inf"))
    return out


def run(a, spark: SparkSession) -> dict | str | None:
    home = Home(spark, a.home)
    if a.command == "init":
        return {"made": home.init()}
    if a.command == "search":
        f = search.Filters(a.tool, a.session, a.cwd, a.since, a.type, a.include_deltas, a.file, a.ran, a.ref)
        return history(home).search_history(a.query, f, a.mode, a.limit, a.cursor, a.max_snippet_chars, a.expand, a.redact, False, a.corroborate)
    simple = {
        "recall": lambda: history(home).recall_answer(a.query, limit=a.limit),
        "sessions": lambda: history(home).list_sessions(a.tool, a.cwd, a.since, a.limit),
        "show": lambda: history(home).get_session(a.tool, a.session, a.redact, limit=a.limit, after_raw_line=a.after_raw_line),
        "export": lambda: history(home, True).export_session(a.tool, a.session, a.form, not a.no_redact),
        "serve": lambda: server.serve(history(home, True), sys.stdin, sys.stdout),
    }
    if a.command in simple:
        return simple[a.command]()
    return {"ingest": ingest, "index": index, "backfill": backfill, "embed": embed, "tail": tail, "purge": purge, "doctor": doctor, "bench": bench}[a.command](home, a)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(a, spark)
    except Exception as e:
        print(json.dumps(api.failure(e)), file=sys.stderr)
        return 1
    if out is not None:
        print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
