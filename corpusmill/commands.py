"""Commands: python -m corpusmill.commands sync|backfill|query|evaluate|validate|map|verify ...

Exit codes: 0 done, 1 failed, 2 another run holds the lock.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill import scratch, settings
from corpusmill.operators import backfill, composition, runs
from corpusmill.session import build_session, ship
from corpusmill.sources import families, fixed_pages, sinks
from corpusmill.sources.readers import read_declared
from corpusmill.sources.sinks import RunIsActive
from corpusmill.sources.tables import read_table

FIXED = tuple(dict.fromkeys(p.scope for p in fixed_pages.FIXED_PAGES))
FAMILIES = tuple(f.scope for f in families.FAMILIES)
#: Scopes that can be synchronised, each with what makes its records; the last two groups read the site's own tables.
SCOPES = ("blog", "service_faq", "image_descriptions", *FAMILIES, *FIXED)
#: What each reporting command shows, by query, with the columns its rows are in order of.
REPORTS = {
    "evaluate": {"recall_by_category": ["is_total", "category"], "threshold_report": [], "strategy_report": ["strategy"], "corpus_fingerprint": []},
    "validate": {"evaluation_gates": ["gate"], "vector_validation": ["embedding_model", "problem"]},
    "map": {"title_consensus": ["canonical_uri"], "mapping_problems": ["problem", "item"]},
    "verify": {"replay_verification": ["chunk_id", "side"]},
}


def _declared(spark: SparkSession, base: str, schemas: dict) -> dict:
    return {name: read_declared(spark, f"{base.rstrip('/')}/{name}.parquet", schema) for name, schema in schemas.items()}


def records_of(spark: SparkSession, base: str, scope: str, site: str):
    """Records of a scope in delivery order; page scopes read the allow-listed columns of their tables."""
    if scope == "blog":
        posts = read_table(spark, base, "blog", ["post_id", "url", "title", "html"]).withColumnRenamed("post_id", "id")
        return composition.post_records(posts, f"{site}blog/").withColumn("ordinal", F.split("source_ref", "#")[1].cast("bigint"))
    if scope == "service_faq":
        records = composition.pair_list_records(read_table(spark, base, "service_faq_data"))
    elif scope == "image_descriptions":
        columns = ["image_key", "framework", "title_in_image", "summary_clean", "description_clean"]
        records = composition.described_image_records(read_table(spark, base, "image_descriptions", columns), site)
    elif scope in FAMILIES:
        page = families.page_of(scope, site)
        records = composition.compose_pages(_declared(spark, base, families.allow_list(page)), page)
    else:
        own = [p for p in fixed_pages.FIXED_PAGES if p.scope == scope]
        records = composition.union_records([fixed_pages.compose_fixed(_declared(spark, base, fixed_pages.allow_list(p)), p, site) for p in own])
    return records.withColumn("ordinal", F.monotonically_increasing_id())


def write_report(spark: SparkSession, command: str, base: str, path: str) -> int:
    """Write ``path``.json and ``path``.md; 1 if a gate failed."""
    from corpusmill.plans import registry

    parts = {name: (registry.QUERIES[name](spark, base), order) for name, order in REPORTS[command].items()}
    Path(f"{path}.json").write_text(sinks.report_json(command, parts))
    Path(f"{path}.md").write_text(sinks.report_markdown(command, parts))
    failed = "evaluation_gates" in parts and not parts["evaluation_gates"][0].where("verdict = 'FAIL'").isEmpty()
    return int(failed)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusmill")
    commands = parser.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync", help="deliver scopes into the store")
    sync.add_argument("--base", required=True)
    sync.add_argument("--store", required=True)
    sync.add_argument("--scope", action="append", choices=SCOPES)
    fill = commands.add_parser("backfill", help="embed what is pending; a dry run unless --execute")
    fill.add_argument("--store", required=True)
    fill.add_argument("--dim", type=int, default=64)
    fill.add_argument("--execute", action="store_true")
    fill.add_argument("--scope", action="append")
    fill.add_argument("--limit", type=int)
    sync.add_argument("--site", default=settings.load().base_url)
    for name in REPORTS:
        report = commands.add_parser(name, help="write a report of named queries as JSON and Markdown")
        report.add_argument("--base", required=True)
        report.add_argument("--to", required=True, help="path without suffix")
    query = commands.add_parser("query", help="write a named query's rows as Parquet")
    query.add_argument("name")
    query.add_argument("--base", required=True)
    query.add_argument("--to", required=True)
    args = parser.parse_args(argv)
    spark = spark or build_session("corpusmill")
    ship(spark)
    worst = 0
    if args.command == "query":
        from corpusmill.plans import registry

        with scratch.scope():
            registry.QUERIES[args.name](spark, args.base).write.parquet(args.to)
        return 0
    if args.command in REPORTS:
        return write_report(spark, args.command, args.base, args.to)
    for scope in (args.scope or SCOPES[:2]) if args.command == "sync" else [None]:
        try:
            if scope:
                records = records_of(spark, args.base, scope, args.site)
                inventory = records.where("canonical_uri is not null").select("canonical_uri").distinct()
                report = runs.synchronize_scope(spark, args.store, scope, records, inventory)
            else:
                embedder = backfill.hashing_embedder(args.dim) if args.execute else None
                report = runs.backfill_store(spark, args.store, f"hashing:{args.dim}", args.dim, embedder, args.scope, args.limit)
            print(json.dumps({"command": args.command, "scope": scope} | report))
        except RunIsActive:
            worst = worst or 2
        except Exception as error:  # each scope is its own run
            print(json.dumps({"command": args.command, "scope": scope, "failed": type(error).__name__}), file=sys.stderr)
            worst = 1
    return worst


if __name__ == "__main__":
    sys.exit(main())
