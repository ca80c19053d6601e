"""Scores and summaries over checked segments.

``facts`` makes one row per condition in a single pass: every segment carries its
issues as an array, so distinct segments are sums of flags, nothing is exploded, and
the only shuffle is that of the partial sums. All scores are derived from these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .checks import COMPLETION, GROUPS, issue_group

BLOCKING = ("empty_translation", "missing_translation_element", "missing_qt_placeholder", "missing_brace_placeholder", "missing_printf_placeholder", "missing_html_xml_entity", "missing_html_xml_tag")


def first_window(segments: DataFrame, limit: int = 10_000) -> DataFrame:
    """The first messages by index; a limit of 0 or less means 10,000."""
    return segments.where(F.col("idx").between(1, limit if limit > 0 else 10_000))


KEPT = {"placeholder": "missing_qt_placeholder", "brace": "missing_brace_placeholder", "tag": "missing_html_xml_tag", "entity": "missing_html_xml_entity"}


def attach(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """Segments with an array of their issues from a table of (condition_id, idx, issue_type, severity); issues without a segment keep a row of their own."""
    own = issues.groupBy("condition_id", "idx").agg(F.collect_list(F.struct("issue_type", "severity")).alias("issues"))
    rows = segments.select("condition_id", "idx", "source", F.lit(1).alias("_is")).join(own, ["condition_id", "idx"], "full_outer")
    return rows.withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<issue_type:string,severity:string>>")))


def _types(group: str) -> tuple[str, ...]:
    if group == "completion_state":
        return COMPLETION
    if group in GROUPS[:6]:
        return f"missing_{group}", f"extra_{group}"
    return ("newline_count_mismatch",) if group == "newline" else ("accelerator_count_mismatch",)


def facts(checked: DataFrame) -> DataFrame:
    """Per condition: messages, characters, issues, points, affected, failed and blocked segments, and affected segments and issues by group."""
    is_one = F.col("_is").isNotNull() if "_is" in checked.columns else F.lit(True)
    issues, real = F.col("issues"), is_one
    count = lambda test: F.size(F.filter(issues, test))
    flag = lambda test: F.count_if(F.exists(issues, test))
    groups = [*GROUPS, "completion_state"]
    every = [t for g in GROUPS for t in _types(g)]
    points = F.aggregate(issues, F.lit(0.0), lambda a, x: a + stats.points(x["severity"], stats.ISSUE_POINTS))
    return checked.groupBy("condition_id").agg(
        F.count_if(real).alias("messages"),
        F.coalesce(F.sum(F.when(real, F.greatest(F.length(F.coalesce("source", F.lit(""))), F.lit(1)))), F.lit(0)).alias("chars"),
        F.sum(F.size(issues)).alias("issues"),
        F.sum(points).alias("points"),
        F.count_if(F.size(issues) > 0).alias("affected"),
        F.sum(count(lambda x: (x["severity"] == "critical") | x["issue_type"].isin(*BLOCKING))).alias("blocking"),
        F.count_if(F.exists(issues, lambda x: x["issue_type"].isin(*every)) & real).alias("failed"),
        *(flag(lambda x: x["issue_type"].startswith(p)).alias(f"lost_{n}") for n, p in KEPT.items()),
        *(F.count_if(F.exists(issues, lambda x: x["issue_type"].isin(*_types(g))) & real).alias(f"affected_{g}") for g in groups),
        *(F.sum(F.when(real, count(lambda x: x["issue_type"].isin(*_types(g)))).otherwise(0)).alias(f"issues_{g}") for g in groups),
    )


def structure_scores(totals: DataFrame, completion: bool = False) -> DataFrame:
    """Per condition and structure group: affected segments, score, and Wilson bounds of the affected share (in percent).

    ``completion`` adds the state of completion as a ninth item.
    """
    items = [*GROUPS, *(["completion_state"] if completion else [])]
    rows = F.inline(F.array(*(F.struct(F.lit(g).alias("item"), F.col(f"affected_{g}").alias("affected"), F.col(f"issues_{g}").alias("issues")) for g in items)))
    out = totals.select("condition_id", F.col("messages").alias("checked"), rows)
    low, high = stats.wilson(F.col("affected"), F.col("checked"))
    score = 100.0 * (1 - F.col("affected") / F.greatest("checked", F.lit(1)))
    return out.select("condition_id", "item", "checked", "affected", "issues", score.alias("score"), (100 * low).alias("low_pct"), (100 * high).alias("high_pct"))


def _average(items: list[str] | tuple[str, ...] = GROUPS) -> Column:
    total = sum((F.col(f"affected_{g}") for g in items), F.lit(0))
    return 100.0 * (1 - total / F.greatest("messages", F.lit(1)) / len(items))


def structure_average(scores: DataFrame) -> DataFrame:
    return scores.groupBy("condition_id").agg(F.sum("score").alias("score_sum"), F.avg("score").alias("score_avg"), F.count("*").alias("items"))


def summary(totals: DataFrame) -> DataFrame:
    """Per condition: points, error rate per 1000 source characters, affected and blocked segments, preservation rates."""
    rate, n = F.col("points") / F.greatest("chars", F.lit(1)) * 1000, F.greatest("messages", F.lit(1))
    return totals.select(
        "condition_id", "messages", "chars", "issues", "points", "affected", "blocking",
        rate.alias("points_per_1000"), stats.dashboard(rate).alias("deterministic_score"),
        F.greatest(F.lit(0.0), 100 - 10 * F.col("points") / n).alias("segment_score"),
        (F.col("affected") / n).alias("affected_rate"),
        *((1 - F.col(f"lost_{k}") / n).alias(f"{k}_kept") for k in KEPT),
    )


def issue_counts(segments: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Long table: per condition and issue type counts, distinct segments and their rate, and severities as a map. Without a table of issues the segments carry them."""
    # A row without a type stands for the segment itself, so that texts are read and checked once.
    own = F.struct(F.lit(None).cast("string").alias("issue_type"), F.lit(None).cast("string").alias("severity"))
    if issues is None:
        each = F.concat(F.array(own), F.transform("issues", lambda x: F.struct(x["issue_type"].alias("issue_type"), x["severity"].alias("severity"))))
        rows = segments.select("condition_id", "idx", F.inline(each))
    else:
        rows = segments.select("condition_id", "idx", own.alias("x")).select("condition_id", "idx", "x.*").unionByName(issues.select("condition_id", "idx", "issue_type", "severity"))
    by = rows.where("condition_id is not null").groupBy("condition_id", "issue_type", "severity", "idx").agg(F.count("*").alias("n"))
    # A segment counts once in a type, also where it has several severities.
    by = by.groupBy("condition_id", "issue_type", "idx").agg(F.sum("n").alias("n"), F.collect_list(F.struct("severity", "n")).alias("levels"))
    level = lambda s: F.sum(F.aggregate(F.filter("levels", lambda x: x["severity"] == s), F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias(s)
    by = by.groupBy("condition_id", "issue_type").agg(F.sum("n").alias("issues"), F.count("idx").alias("segments"), *(level(s) for s in sorted(stats.ISSUE_POINTS)))
    levels = F.filter(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in sorted(stats.ISSUE_POINTS))), lambda x: x["n"] > 0)
    own_count = F.max(F.when(F.col("issue_type").isNull(), F.col("issues"))).over(Window.partitionBy("condition_id"))  # a row a type
    out = by.select("*", own_count.alias("checked"), F.to_json(F.map_from_entries(levels)).alias("severities")).where("issue_type is not null and checked is not null")
    return out.select("condition_id", issue_group(F.col("issue_type")).alias("issue_group"), "issue_type", "issues", "segments", stats.safe_rate(F.col("segments"), F.col("checked")).alias("segment_rate"), "severities")


def failed_segments(issues: DataFrame) -> DataFrame:
    """Per segment and structure group: its issue types and severities in check order, joined."""
    rows = issues.withColumn("item", issue_group(F.col("issue_type"))).where(F.col("item").isin(*GROUPS))
    listed = rows.groupBy("condition_id", "idx", "item").agg(F.array_sort(F.collect_list(F.struct("check_ordinal", "form_index", "issue_type", "severity"))).alias("x"))
    return listed.select("condition_id", "idx", "item", F.array_join(F.col("x.issue_type"), "; ").alias("issue_types"), F.array_join(F.col("x.severity"), "; ").alias("severities"), F.size("x").cast("long").alias("n"))


def failed_summary(failed: DataFrame) -> DataFrame:
    """How often each issue type stands in the joined lists."""
    parts = failed.select("condition_id", F.explode(F.split("issue_types", "; ")).alias("issue_type"))
    return parts.groupBy("condition_id", "issue_type").agg(F.count("*").alias("n"))


def compare(totals: DataFrame, reference: str) -> DataFrame:
    """Every condition against the reference: score differences, and the reduction of the share of failed segments.

    A segment has failed if it has an issue of any structure group.
    """
    rate = F.col("points") / F.greatest("chars", F.lit(1)) * 1000
    flat = totals.select("condition_id", "messages", "failed", _average().alias("score_avg"), stats.dashboard(rate).alias("deterministic_score"), stats.safe_rate(F.col("failed"), F.col("messages")).alias("failed_rate"))
    # There is a row per condition, so one window over them needs no second pass of the segments.
    ref = F.max(F.when(F.col("condition_id") == reference, F.struct("condition_id", "score_avg", "deterministic_score", "failed_rate"))).over(Window.partitionBy(F.lit(0)))
    out = flat.withColumn("ref", ref).where(F.col("ref").isNotNull() & (F.col("condition_id") != reference))
    low, high = stats.wilson(F.col("failed"), F.col("messages"))
    cut = F.col("failed_rate") - F.col("ref.failed_rate")
    return out.select(
        F.col("ref.condition_id").alias("ref_condition_id"), "condition_id", "failed", "failed_rate", (100 * low).alias("failed_low_pct"), (100 * high).alias("failed_high_pct"),
        (F.col("ref.score_avg") - F.col("score_avg")).alias("delta_score"),
        (F.col("ref.deterministic_score") - F.col("deterministic_score")).alias("delta_deterministic"),
        cut.alias("reduction"),
        F.when(F.col("failed_rate") > 0, cut / F.col("failed_rate")).otherwise(F.when(F.col("ref.failed_rate") == 0, 1.0).otherwise(0.0)).alias("relative_reduction"),
    )


def pivot_scores(scores: DataFrame, value: str = "score") -> DataFrame:
    """A row per condition with a column per structure group."""
    return scores.groupBy("condition_id").pivot("item", list(GROUPS)).agg(F.first(value))


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of several experiments, each with its label; missing columns are null."""
    out = None
    for label, df in parts.items():
        df = df.select(F.lit(label).alias("experiment"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def best_and_worst(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k items with the most affected segments (worst) and the k with the least (best), over all conditions."""
    # Items are few, a row for each group of a condition, so both orders come from one pass of the texts.
    places = [F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "condition_id", "item")).alias(name) for name, order in (("worst", F.desc("affected")), ("best", F.asc("affected")))]
    kinds = F.array(*(F.struct(F.lit(name).alias("kind"), F.col(name).alias("place")) for name in ("worst", "best")))
    return scores.select("condition_id", "item", "affected", "score", *places).select(F.inline(kinds), "condition_id", "item", "affected", "score").where(F.col("place") <= k)


def run_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Repeated runs: mean of run values, sample deviation (0 for one run), and the clamped 95 % interval."""
    out = runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("runs"))
    sd = F.when(F.col("runs") > 0, F.coalesce("sd", F.lit(0.0)))
    half = 1.96 * sd / F.sqrt(F.greatest("runs", F.lit(1)))
    return out.select(*keys, "runs", "mean", sd.alias("sd"), F.greatest(F.lit(0.0), F.col("mean") - half).alias("low"), F.least(F.lit(100.0), F.col("mean") + half).alias("high"))


def runs_and_average(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of runs (``row_type`` run) and their averages (``average``: the mean of run means, ``run_id`` null) in one table."""
    scored = runs.where("valid_n > 0")
    mean = scored.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values), F.sum("valid_n").alias("valid_n"), F.sum("failed_n").alias("failed_n"))
    one = runs.select(*keys, F.lit("run").alias("row_type"), F.col("run").cast("string").alias("run_id"), "valid_n", "failed_n", *values)
    return one.unionByName(mean.select(*keys, F.lit("average").alias("row_type"), F.lit(None).cast("string").alias("run_id"), "valid_n", "failed_n", *values))


def mean_scores(files: DataFrame, values: list[str]) -> DataFrame:
    """One row: files, those with an error, and the means of scores over files that have them, to three places."""
    return files.agg(F.count("*").alias("files"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), *(F.round(F.avg(v), 3).alias(v) for v in values))


def status_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a translation log by status, and rows with issues as a further state."""
    rows = log.select(*keys, F.explode(F.array_compact(F.array("status", F.when(F.size("issues") > 0, "segments_with_issues")))).alias("status"))
    return rows.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def pivot_types(counts: DataFrame, types: list[str]) -> DataFrame:
    """A row per condition with a column per issue type (0 where it has none)."""
    return counts.groupBy("condition_id").pivot("issue_type", types).agg(F.first("issues")).fillna(0)


def condition_number(condition_id: Column) -> Column:
    """The number of a condition such as C2 for sorting, 9999 for others."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(condition_id, r"C(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(9999))


def report_order(rows: DataFrame) -> DataFrame:
    """Rows of (condition_id, item, ...) by number of condition, then in the order of the structure groups."""
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("item"))
    return rows.orderBy(condition_number(F.col("condition_id")), "condition_id", F.when(place > 0, place).otherwise(len(GROUPS) + 1), "item")


def described(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rows (slug, ...) with id, description and status of their condition; the last one of a slug wins, and a slug without one gives its own id."""
    last = conditions.groupBy("slug").agg(F.max_by(F.struct("id", "description", "status"), "position").alias("c"))
    own = F.coalesce("c.id", F.nullif(F.regexp_extract("slug", r"^(C\d+)_", 1), F.lit("")), F.col("slug"))
    return rows.join(last, "slug", "left").select(*rows.columns, own.alias("condition_id"), F.coalesce("c.description", F.lit("")).alias("description"), F.coalesce("c.status", F.lit("")).alias("workflow_status"))
