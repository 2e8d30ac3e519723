"""Command line: python -m foliospark.cli TABLES --output FOLDER."""

from __future__ import annotations

import argparse
import sys
import time

from foliospark import config
from foliospark.operators import correction_server, engines
from foliospark.plans import pipeline
from foliospark.session import local_session
from foliospark.sources import files, ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("foliospark", description="Assembles recognised and native books into Markdown and EPUB.")
    p.add_argument("inputs", nargs="*", help="folders of parquet tables, or input files to be listed with --plan; default: the input folder")
    p.add_argument("--input-dir", help="the input folder")
    p.add_argument("--output-dir", default="output", help="where results go")
    p.add_argument("--work-dir", help="a shared folder in which pages and elements are kept between runs")
    p.add_argument("--engine", default="auto", help="a recognition engine's name")
    p.add_argument("--list-engines", action="store_true", help="show the registered engines and end")
    p.add_argument("--plan", action="store_true", help="show how input files are grouped and dispatched, and end")
    p.add_argument("--pages", type=int, help="only the first pages of each document")
    p.add_argument("--no-llm", action="store_true", help="leave the correction pass out")
    p.add_argument("--llm-url", help="the correction server's address")
    p.add_argument("--llm-model", help="the correction server's model")
    p.add_argument("--no-preprocess", action="store_true", help="plan no restoration")
    p.add_argument("--force-preprocess", action="store_true", help="plan restoration for every page")
    p.add_argument("--fresh", action="store_true", help="use nothing that was kept")
    p.add_argument("--only", action="append", choices=("md", "epub"), help="write only these; may be repeated")
    p.add_argument("--quiet", action="store_true", help="no report")
    p.add_argument("--config", help="a settings file")
    return p


def settings_of(args: argparse.Namespace) -> config.Settings:
    """The file's and the environment's settings with the command line's over them."""
    given = {
        "run.max_pages": args.pages,
        "run.resume": False if args.fresh else None,
        "correct.enabled": False if args.no_llm else None,
        "preprocess.mode": "never" if args.no_preprocess else "always" if args.force_preprocess else None,
    }
    return config.Settings(config.merged(config.load(args.config).values, {k: v for k, v in given.items() if v is not None}))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    say = (lambda *_: None) if args.quiet else print
    if args.list_engines:
        for name, make in sorted(engines.ENGINES.items()):
            print(name, make().available() or "available")
        return pipeline.OK
    if args.engine != "auto":
        try:
            engines.choose(args.engine, [])
        except LookupError as e:
            print(e, file=sys.stderr)
            return pipeline.NO_ENGINE
    settings = settings_of(args)
    places = args.inputs or ([args.input_dir] if args.input_dir else [])
    if not places:
        say("nothing to do")
        return pipeline.NOTHING_TO_DO
    spark = local_session()
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            print(f"no such file: {place}", file=sys.stderr)
            return pipeline.NO_FILE
    if args.plan:
        found = [files.discover(spark, p).select("path") for p in places]
        groups = ingest.dispatch(files.group_inputs(found[0] if len(found) == 1 else found[0].unionAll(found[1]), places[0]))
        groups.select("document", "kind", "title", "stem", "error").show(1000, False)
        return pipeline.OK if groups.limit(1).count() else pipeline.NOTHING_TO_DO
    server = correction_server.Server(args.llm_url, args.llm_model) if args.llm_url and args.llm_model and settings["correct.enabled"] else None
    corrector, warning = correction_server.corrector_or_none(server)
    if server and warning:
        say(f"correction is left out: {warning}")
    store = ingest.Store(spark, args.work_dir) if args.work_dir else None
    worst = pipeline.OK
    try:
        for k, place in enumerate(places):
            began = time.time()
            out = args.output_dir if len(places) == 1 else f"{args.output_dir}/{k}"
            status, code = pipeline.run(pipeline.from_tables(spark, place, settings.get("run.max_pages")), settings, out, tuple(args.only or ("md", "epub")), corrector, store, time.strftime("%Y-%m-%d"))
            worst = max(worst, code)
            if not args.quiet:
                pipeline.report(status, time.time() - began).show(truncate=False)
                status.filter("NOT ok").show(20, False)
    except KeyboardInterrupt:
        return pipeline.INTERRUPTED
    return worst


if __name__ == "__main__":
    sys.exit(main())
