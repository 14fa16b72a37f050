"""Commands: init, doctor, run, status, search, evaluate, inspect, review, resolve,
audit, draft-email."""

from __future__ import annotations

import argparse
import importlib.util
import os
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

from . import config
from .operators import audit, evaluate, inspect, outreach, resolve, search
from .plans import artifacts, export, pipeline
from .plans.store import Store
from .scratch import shared_dir
from .sources.fetch import HttpMaker


def session(name: str = "rosterlake") -> SparkSession:
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    shared_dir(spark)
    return spark


def context(spark: SparkSession, settings: config.Settings, read_only: bool = False) -> pipeline.Context:
    h, a = settings.http, settings.authors
    make = HttpMaker(h.user_agent, h.timeout_seconds, max(h.request_delay_seconds, 1.0) if a.api_keys or a.api_key else h.request_delay_seconds, (a.api_key, *a.api_keys))
    return pipeline.Context(spark, Store(spark, settings.app.store_dir, read_only), settings, make, today=date.today().isoformat())


def tables(ctx: pipeline.Context) -> dict:
    return {n: ctx.table(n) for n in pipeline.TABLES}


def doctor(settings: config.Settings) -> list[dict]:
    """What a run needs, and whether it is there."""
    checks = [(f"module {m}", importlib.util.find_spec(m) is not None, "install it") for m in ("pyspark", "pyarrow", "pandas", "numpy")]
    store = Path(settings.app.store_dir.removeprefix("file:"))
    near = next((p for p in (store, *store.parents) if p.exists()), Path("."))
    checks += [("store folder can be written", os.access(near, os.W_OK), f"check {near}"), ("seed file", Path(settings.app.seed_file).exists(), "set app.seed_file"), ("embedding backend", settings.embeddings.backend == "hash" or importlib.util.find_spec(settings.embeddings.backend.partition(":")[0]) is not None, "use hash or module:function"), ("author source", bool(settings.authors.base_url), "set authors.base_url")]
    return [{"name": n, "status": "ok" if ok else "fail", **({} if ok else {"hint": hint})} for n, ok, hint in checks]


def run_pipeline(ctx: pipeline.Context, from_stage: str | None, through_stage: str | None) -> dict:
    ctx.reporter = artifacts.Reporter(ctx.settings.app.runs_dir, "pipeline")
    try:
        return ctx.reporter.finish(pipeline.run(ctx, from_stage, through_stage))
    except pipeline.StageFailed as e:
        return ctx.reporter.finish(e.done, e.stage, str(e))


def _search(ctx: pipeline.Context, rows, limit, works: int):
    e = ctx.settings.embeddings
    return search.search(pipeline.search_tables(ctx), rows, e.dimension, limit, works, e.backend, ctx.encoders)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rosterlake", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--profile")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [c := sub.add_parser(name), *[c.add_argument(o, **k) for o, k in options]] and c
    add("init")
    add("doctor")
    add("run", ("--from-stage", {}), ("--through-stage", {}), ("--limit", {"type": int}))
    add("status")
    add("search", ("query", {}), ("--limit", {"type": int}), ("--work-offset", {"type": int, "default": 0}), ("--works", {"type": int, "default": 3}))
    add("evaluate", ("file", {}), ("--limit", {"type": int, "default": 10}))
    add("inspect", ("--id", {"type": int}), ("--name", {}), ("--works", {"type": int, "default": 8}))
    add("review")
    add("resolve", ("status", {"choices": ["manual_override", "unmatched", "ambiguous", "matched"]}), ("--id", {"type": int}), ("--name", {}), ("--author-id", {}), ("--reason", {"default": ""}))
    add("audit", ("--min-works", {"type": int, "default": 15}), ("--limit", {"type": int, "default": 25}))
    add("draft-email", ("id", {"type": int}), ("--interest", {"required": True}), ("--applicant", {"default": ""}), ("--background", {"default": ""}), ("--backend", {"default": "fake"}), ("--papers", {"type": int, "default": 2}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings = config.load(a.config, a.profile)
    if a.command == "doctor":
        report = doctor(settings)
        print(export.as_json(report))
        return int(any(r["status"] != "ok" for r in report))
    ctx = context(spark or session(), settings, read_only=a.command not in ("init", "run", "resolve"))
    t = tables(ctx)
    if a.command == "init":
        for name in pipeline.TABLES:
            if not ctx.store.exists(name):
                ctx.put(name, ctx.table(name))
        print(export.as_json({"store": settings.app.store_dir}))
    elif a.command == "run":
        ctx.limit = a.limit
        summary = run_pipeline(ctx, a.from_stage, a.through_stage)
        print(export.as_json(summary))
        return int(not summary["success"])
    elif a.command == "status":
        print(export.as_json(inspect.status_counts(t["people"], t["matches"], t["works"], t["candidates"], t["vectors"])))
    elif a.command == "search":
        rows = ctx.spark.createDataFrame([(0, a.query)], "query_id bigint, query string")
        hits, ranked = _search(ctx, rows, a.limit if a.limit is not None else settings.search.result_limit, settings.search.work_limit)
        shown = search.work_window(ranked, a.work_offset, a.works).join(hits.select("professor_id"), "professor_id", "left_semi")
        print(export.as_json({"hits": [r.asDict() for r in hits.orderBy("rank").collect()], "works": [r.asDict() for r in shown.orderBy("professor_id", "place").collect()]}))
    elif a.command == "evaluate":
        asked = evaluate.load_queries(ctx.spark, a.file)
        results = evaluate.evaluate(asked, _search(ctx, asked, a.limit, settings.search.work_limit)[0])
        print(export.as_json({"results": [r.asDict(recursive=True) for r in results.orderBy("query_id").collect()], "summary": evaluate.summarize(results).first().asDict()}))
    elif a.command == "inspect":
        one = inspect.resolve_one(t["people"], a.id, a.name, pipeline.names_by_part(ctx))
        person = inspect.details(t["people"].where(f"professor_id = {one}"), t["universities"], t["matches"])
        print(export.as_json({"person": [r.asDict() for r in person.collect()], "works": [r.asDict() for r in inspect.recent_works(t["links"].where(f"professor_id = {one}"), t["works"], a.works).collect()]}))
    elif a.command == "review":
        print(export.as_json(inspect.review_queue(t["people"], t["universities"], t["matches"])))
    elif a.command == "resolve":
        one = inspect.resolve_one(t["people"], a.id, a.name, pipeline.names_by_part(ctx))
        ctx.put("matches", resolve.apply_decision(t["matches"], one, a.status, a.author_id, a.reason))
        if a.status not in ("matched", "manual_override"):
            key = pipeline.KEYS["links"]
            ctx.store.merge("links", None, key, gone=t["links"].where(f"professor_id = {one}").select(key))
        print(export.as_json({"professor_id": one, "match_status": a.status}))
    elif a.command == "audit":
        print(export.as_json(audit.audit_publications(t["people"], t["universities"], t["matches"], t["works"], t["links"], a.min_works, a.limit)))
    else:
        out = outreach.draft(a.id, outreach.Applicant(a.interest, a.applicant, a.background), t, outreach.backend(a.backend), a.papers)
        print(export.as_json(vars(out)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
