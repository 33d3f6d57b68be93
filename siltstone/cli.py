"""Command line: check, make and list configurations, and run a crawl over a table of fetched pages."""

from __future__ import annotations

import argparse
import logging
import sys

from siltstone import config
from siltstone.errors import ConfigError

log = logging.getLogger("siltstone")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    out.add_argument("--verbose", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate", help="check a configuration file")
    one.add_argument("file")
    one = commands.add_parser("init", help="print a new configuration file")
    one.add_argument("name")
    one.add_argument("start_url")
    one.add_argument("domain")
    one = commands.add_parser("list", help="list the configuration files of a folder")
    one.add_argument("folder")
    one = commands.add_parser("run", help="crawl a table of fetched pages and write its documents")
    one.add_argument("file")
    one.add_argument("results", help="Parquet table of fetched pages")
    one.add_argument("--max-pages", type=int)
    one.add_argument("--dry-run", action="store_true", help="compute everything, write no files")
    one.add_argument("--preview", metavar="PATH", help="write a report of what would be written, as JSON lines")
    one.add_argument("--state", metavar="FOLDER", help="folder of the checkpoint")
    one.add_argument("--resume", action="store_true", help="go on from the checkpoint")
    one.add_argument("--reset", action="store_true", help="leave the checkpoint's content out")
    return out


def check_flags(args: argparse.Namespace) -> None:
    """Flags that exclude each other."""
    if args.resume and not args.state:
        raise ConfigError("--resume needs --state")
    if args.resume and args.reset:
        raise ConfigError("--resume and --reset exclude each other")
    if args.resume and args.dry_run:
        raise ConfigError("--resume and --dry-run exclude each other")


def run(spark, own: config.Config, results, max_pages: int | None = None, dry: bool = False, preview: str | None = None, state: str | None = None, resume: bool = False, now=None) -> dict:
    """The whole pipeline over fetched pages; gives its counters.

    Frontier (start addresses, or what the checkpoint still holds), levels of
    the crawl, hooks, conversion, files, state, in this order. Only the
    counters and kinds of errors come to the driver.
    """
    from pyspark.sql import functions as F

    from siltstone.functions import urls
    from siltstone.operators import convert, crawl, reports
    from siltstone.operators.transforms import Registry
    from siltstone.plans.lineage import keep
    from siltstone.sources import checkpoints, files

    hooks = Registry()
    hooks.load(list(own.plugins))
    results = hooks.table("pre_crawl", results)
    backend = checkpoints.TableBackend(spark, state, own.identity()) if state else None
    saved = backend.load() if backend and resume else None
    starts = spark.createDataFrame([(u,) for u in own.start_urls], "url string")
    seeds = crawl.seeds_of(starts if saved is None else None, saved[1] if saved else None) if saved is None or not saved[1].isEmpty() else crawl.seeds_of(starts)
    reached = crawl.crawl(results, seeds.select("url"), own.rules, max_pages or own.max_pages)
    if saved is not None:
        reached = crawl.not_checkpointed(reached, saved[0], F.current_timestamp() if now is None else now, own.checkpoint.get("force_redownload_after_days", 7))
    at = urls.normalize(F.col("url"))
    pages = hooks.table("post_fetch", results.withColumn("_at", at).join(reached.select(F.col("url").alias("_at")), "_at", "left_semi").drop("_at"))
    if preview:
        reports.preview_document(reports.preview(pages)).write.mode("overwrite").text(preview)
    documents = keep(convert.documents(pages, own.layout, None, own.keep_selectors, own.remove_selectors, own.frontmatter, hooks, own.page_limit_mb or 1e9))
    written = keep(files.save_texts(documents, own.folders["root"], dry=dry or bool(preview)))
    written = hooks.table("post_save", written)
    if backend and not dry:
        new = pages.where("html <> ''").select(at.alias("url"), F.sha2("html", 256).alias("content_hash"), F.col("fetched_at").alias("last_scraped"), "status_code", own.layout.document(F.col("url")).alias("file_path"), "etag", "last_modified")
        from siltstone.operators import state as states

        both = states.upsert(saved[0], new) if saved is not None else states.latest(new, "url", "last_scraped")
        left = crawl.not_checkpointed(reached.select("url", "depth", "parent"), both.withColumn("last_scraped", F.col("last_scraped")), F.current_timestamp(), None)
        backend.save(both, crawl.queue_positions(left).select("position", "url", F.col("parent").alias("parent_url")))
    counts = written.groupBy("state").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    failures = convert.error_rows(documents).groupBy("category", "type").agg(F.count("*").alias("n")).collect()
    hooks.table("post_crawl", documents)
    return {"files": {r["state"]: r["n"] for r in counts}, "bytes": sum(r["bytes"] or 0 for r in counts), "errors": {f"{r['category']}/{r['type']}": r["n"] for r in failures}, "plugin_errors": hooks.errors}


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(levelname)s %(message)s", stream=sys.stderr)
    try:
        if args.command == "validate":
            own = config.load(args.file)
            print(f"{own.name}: {len(own.start_urls)} start addresses, {len(own.include)} include and {len(own.exclude)} exclude patterns")
        elif args.command == "init":
            print(config.generated(args.name, args.start_url, args.domain), end="")
        elif args.command == "list":
            for row in config.catalogue(args.folder):
                print(f"{row['file']}: {row['name'] or row.get('error')} {row['description'] or ''}".rstrip())
        else:
            check_flags(args)
            own = config.load(args.file)
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName(f"siltstone {own.name}").getOrCreate()
            if args.state and not args.resume and not args.reset:
                from siltstone.sources.checkpoints import TableBackend

                if TableBackend(spark, args.state, own.identity()).versions():
                    log.info("the checkpoint is left as it is and a new version is written; --resume goes on from it")
            print(run(spark, own, spark.read.parquet(args.results), args.max_pages, args.dry_run, args.preview, args.state, args.resume))
    except ConfigError as e:
        log.error("%s", e)
        return 2
    return 0
