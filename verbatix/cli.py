"""Command lines: score a folder of catalogues, compare several, plan translation and judge requests.

A folder of a run holds its catalogues in ``outputs_ts``. Results are CSV folders and a
Markdown report. No command calls a model: requests are written for others to send.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, glossary, metrics, prompts, sampling, variants
from .sources import catalogue, glossaries, workflow

KEYS = ("condition_id", "idx", "issue_type", "severity")


def _segments(spark: SparkSession, folder: str, outdir: str) -> DataFrame:
    """The messages of a run, parsed once; each file is a condition, named by its stem."""
    path, slug = f"{outdir}/segments", F.regexp_extract("ts_file", r"([^/]+?)(?:\.ts)?\z", 1)
    catalogue.read_catalogues(spark, f"{folder}/outputs_ts").withColumn("condition_id", slug).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _issues(segments: DataFrame, entries: DataFrame | None, chars: str) -> DataFrame:
    """Issues of all kinds as (condition_id, idx, issue_type, severity)."""
    found = checks.checks(segments).select(*KEYS)
    files = segments.select("ts_file", "language", "condition_id").distinct()
    found = found.unionByName(checks.language_issues(files).join(files.select("ts_file", "condition_id"), "ts_file").select(*KEYS))
    if entries is not None:
        found = found.unionByName(glossary.term_checks(segments, glossary.hits(segments, entries), entries).select(*KEYS))
    return found.unionByName(variants.script_issues(segments, chars).select(*KEYS)) if chars else found


def _inputs(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame | None, str]:
    entries = glossaries.read_glossaries(spark, args.glossary) if args.glossary else None
    return entries, variants.letters(variants.read_variants(spark, args.variants)) if args.variants else ""


def _totals(spark: SparkSession, folder: str, outdir: str, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, issues, facts) of a run; the latter two are written too, as every table of results needs them."""
    segments = _segments(spark, folder, outdir)
    _issues(segments, *_inputs(spark, args)).write.mode("overwrite").parquet(f"{outdir}/issues")
    issues = spark.read.parquet(f"{outdir}/issues")
    metrics.facts(metrics.attach(segments, issues)).write.mode("overwrite").parquet(f"{outdir}/facts")
    return segments, issues, spark.read.parquet(f"{outdir}/facts")


def score(spark: SparkSession, args: argparse.Namespace) -> str:
    """Tables of results of one run, and their report."""
    folder, outdir = args.workdir.rstrip("/"), (args.outdir or f"{args.workdir.rstrip('/')}/statistics").rstrip("/")
    segments, issues, totals = _totals(spark, folder, outdir, args)
    found = workflow.context(spark, folder)
    known = workflow.conditions(spark, found)
    items = metrics.report_order(metrics.structure_scores(totals))
    summary = metrics.summary(totals)
    named = metrics.described(summary.withColumnRenamed("condition_id", "slug"), known)
    failed = metrics.failed_segments(checks.checks(segments))
    for name, df in {"condition_summary": named, "structure_scores": items}.items():
        catalogue.write_report(df, f"{outdir}/{name}.csv", ("condition_id", "slug"), one_file=True)
    catalogue.write_report(metrics.issue_counts(segments, issues), f"{outdir}/issue_counts.csv", one_file=True)
    catalogue.write_report(metrics.failed_summary(failed), f"{outdir}/failed_summary.csv", one_file=True)
    catalogue.write_report(failed.join(segments.select("condition_id", "idx", "segment_id", "context", "source", "translation", "locations"), ["condition_id", "idx"]), f"{outdir}/failed_segments.csv")
    if args.glossary:
        catalogue.write_report(glossaries.report(glossaries.read_glossaries(spark, args.glossary)), f"{outdir}/glossary.csv", one_file=True)
    messages = workflow.message_count(found, messages=segments)
    parts = [f"# Scores of {folder}", f"Messages: {messages}", "## Conditions", catalogue.markdown(named.drop("slug").orderBy("condition_id")), "## Structure", catalogue.markdown(items, 200)]
    if args.reference:
        versus = metrics.compare(totals, args.reference)
        catalogue.write_report(versus, f"{outdir}/comparison.csv", one_file=True)
        parts += [f"## Against {args.reference}", catalogue.markdown(versus)]
    return _written(outdir, "report.md", parts)


def compare(spark: SparkSession, args: argparse.Namespace) -> str:
    """Tables of several runs, each with its label, and their report."""
    pairs = dict(p.split("=", 1) for p in args.runs)
    rows, items = {}, {}
    for label, folder in pairs.items():
        totals = _totals(spark, folder.rstrip("/"), f"{args.outdir}/{label}", args)[2]
        rows[label], items[label] = metrics.summary(totals), metrics.structure_scores(totals)
    summary, scores = metrics.labelled_union(rows), metrics.labelled_union(items)
    catalogue.write_report(summary, f"{args.outdir}/conditions.csv", ("experiment", "condition_id"), one_file=True)
    catalogue.write_report(scores, f"{args.outdir}/structure_scores.csv", ("experiment", "condition_id", "item"), one_file=True)
    mean = scores.groupBy("experiment", "condition_id").agg(F.avg("score").alias("structure_average"))
    ends = metrics.best_and_worst(scores.withColumn("condition_id", F.concat_ws("/", "experiment", "condition_id")))
    parts = ["# Comparison", catalogue.markdown(mean.orderBy("experiment", "condition_id"), 200), "## Best and worst items", catalogue.markdown(ends)]
    return _written(args.outdir, "report.md", parts)


def judge_plan(spark: SparkSession, args: argparse.Namespace) -> str:
    """Requests to a judge: a sample of each file and run, as lines of a batch file."""
    folder, outdir = args.workdir.rstrip("/"), args.outdir or f"{args.workdir.rstrip('/')}/judge"
    segments, issues, _ = _totals(spark, folder, outdir, args)
    found = checks.checks(segments)
    files = [r.ts_file for r in segments.select("ts_file").distinct().orderBy("ts_file").collect()]
    size = sampling.budget(args.total_request_budget, len(files), args.repeats) if args.total_request_budget else args.sample_size
    out = None
    for name in files:  # a plan per file; its messages stay distributed
        here = segments.where(F.col("ts_file") == name)
        for run in range(1, args.repeats + 1):
            if args.sampling_mode == "random":
                part = sampling.random_sample(here, size, args.seed + run - 1)
            else:
                part = sampling.enriched_sample(here, found.where(F.col("ts_file") == name), size, args.seed + run - 1, "mixed" if args.sampling_mode == "mixed" else "issues")
            part = sampling.judge_keys(part, f"run_{run:02d}")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise SystemExit("no catalogues")
    own = issues.groupBy("condition_id", "idx").agg(F.array_sort(F.collect_list(F.struct("issue_type", "severity"))).alias("issues"))
    asked = out.join(own, ["condition_id", "idx"], "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<issue_type:string,severity:string>>")))
    asked = asked.withColumn("prompt", prompts.prompt("List the errors of the translation, each with its category and severity, as JSON.", "judge", F.col("source"), F.col("translation"), issues=F.col("issues")))
    catalogue.batch_requests(asked, args.model).write.mode("overwrite").text(f"{outdir}/requests.jsonl")
    catalogue.write_report(asked.select("request_key", "run_id", "ts_file", "segment_id", "sample_position"), f"{outdir}/requests.csv", one_file=True)
    return f"{outdir}/requests.jsonl"


def translation_plan(spark: SparkSession, args: argparse.Namespace) -> str:
    """A subset of one catalogue as a catalogue and a report, and the requests for its translation."""
    every = catalogue.read_catalogues(spark, args.catalogue)
    terms = glossaries.read_glossaries(spark, args.glossary) if args.glossary else None
    rows = every.withColumn("condition_id", F.lit(""))
    held = F.lit(False)
    if terms is not None:
        matched = glossary.hits(rows, terms).select("idx").distinct().withColumn("_term", F.lit(True))
        rows, held = rows.join(matched, "idx", "left"), F.coalesce("_term", F.lit(False))
    rows = rows.withColumn("categories", checks.categories(F.col("source"), F.col("numerus"), held))
    chosen = {"stratified": sampling.stratified_sample, "random": sampling.random_sample}.get(args.subset_mode, lambda r, n, _: r.where(F.col("idx") <= n))(rows, args.sample_size, args.seed)
    chosen.drop("condition_id").write.mode("overwrite").parquet(f"{args.outdir}/subset/messages")
    chosen = spark.read.parquet(f"{args.outdir}/subset/messages")
    catalogue.write_catalogues(catalogue.subset(every, chosen), f"{args.outdir}/subset", args.target_language)
    catalogue.write_report(catalogue.subset_report(chosen.orderBy("idx")), f"{args.outdir}/subset/selected_segments.csv", one_file=True)
    asked = chosen.select(F.col("segment_id").alias("request_key"), prompts.prompt(f"Translate into {args.target_language}; keep all placeholders and tags.", "translate", F.col("source")).alias("prompt"))
    catalogue.batch_requests(asked, args.model).write.mode("overwrite").text(f"{args.outdir}/requests.jsonl")
    return f"{args.outdir}/requests.jsonl"


def full_mini(spark: SparkSession, args: argparse.Namespace) -> str:
    """Score a run, compare it with itself alone, and plan a few judge requests."""
    outdir = args.outdir or f"{args.workdir.rstrip('/')}/mini"
    same = {**vars(args), "runs": [f"run={args.workdir}"]}
    score(spark, argparse.Namespace(**{**same, "outdir": f"{outdir}/statistics"}))
    compare(spark, argparse.Namespace(**{**same, "outdir": f"{outdir}/compare"}))
    return judge_plan(spark, argparse.Namespace(**{**same, "outdir": f"{outdir}/judge"}))


def listing(spark: SparkSession, args: argparse.Namespace) -> str:
    """The catalogues below a folder, and how many messages each has."""
    return catalogue.markdown(catalogue.read_catalogues(spark, args.workdir).groupBy("ts_file", "language").agg(F.count("*").alias("messages")).orderBy("ts_file"), 1000)


def _written(folder: str, name: str, parts: Sequence[str]) -> str:
    """A report by Spark's own writer, as the folder may be in any store."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([("\n\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return f"{folder}/{name}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verbatix", description="Localization quality of message catalogues on Spark.")
    top.add_argument("--config", default="", help="JSON or YAML file whose values replace arguments left at their defaults")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *places: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for place in places:
            p.add_argument(place)
        p.add_argument("--outdir", default="")
        p.add_argument("--glossary", nargs="*", default=[])
        p.add_argument("--variants", default="", help="table of script variants (code point, property, variants)")
        p.set_defaults(run=run)
        return p

    def judging(p: argparse.ArgumentParser) -> None:
        p.add_argument("--sample-size", type=int, default=1)
        p.add_argument("--total-request-budget", type=int, default=0)
        p.add_argument("--repeats", type=int, default=1)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--sampling-mode", choices=["random", "issue_enriched", "mixed"], default="mixed")
        p.add_argument("--model", default="judge")

    command("score", score, "workdir").add_argument("--reference", default="")
    command("compare", compare).add_argument("runs", nargs="+", help="label=folder")
    judging(command("mqm", judge_plan, "workdir"))
    mini = command("full-mini", full_mini, "workdir")
    mini.add_argument("--reference", default="")
    judging(mini)
    t = command("translate", translation_plan, "catalogue")
    t.add_argument("--sample-size", type=int, default=20)
    t.add_argument("--subset-mode", choices=["stratified", "random", "first"], default="stratified")
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--target-language", default="zh-Hant")
    t.add_argument("--model", default="translator")
    command("list", listing, "workdir")
    return top


def overlaid(args: argparse.Namespace, top: argparse.ArgumentParser, config: dict) -> argparse.Namespace:
    """Arguments with the values of a configuration where the command line left the default; unknown names are ignored."""
    sub = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices[args.command]
    plain = {k.replace("-", "_"): v for k, v in config.items()}
    for action in sub._actions:
        if action.option_strings and action.dest in plain and getattr(args, action.dest, None) == action.default:
            setattr(args, action.dest, plain[action.dest])
    return args


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    top = parser()
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("verbatix").getOrCreate()
    if args.config:
        args = overlaid(args, top, workflow.read_config(spark, args.config))
    if args.command in ("compare", "translate") and not args.outdir:
        args.outdir = str(Path.cwd() / "results")
    return args.run(spark, args)
