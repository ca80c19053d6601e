"""Judge replies: tolerant parsing, normalization of errors, and run scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

def reply_text(raw: Column) -> Column:
    """The text of a reply in any of the known envelopes, else the raw value."""
    paths = ("$.output_text", "$.output[0].content[0].text", "$.choices[0].message.content", "$.message.content")
    return F.coalesce(*(F.get_json_object(raw, p) for p in paths), raw)


def json_object(text: Column) -> Column:
    """The outermost object of a text, without code fences around it."""
    plain = F.regexp_replace(text, r"(?s)\A\s*```(?:json)?\s*|\s*```\s*\z", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def normalize(replies: DataFrame) -> DataFrame:
    """Replies (request keys and ``reply``) with errors scored by severity.

    An unknown severity is Neutral and warned of, so are items that are no objects, a list
    that is none, and a rejection without errors. A reply that can't be read, or carries
    ``_error``, has null points.
    """
    whole = json_object(reply_text(F.col("reply")))
    rows = replies.withColumn("_o", F.when(F.try_parse_json(whole).isNotNull(), whole))
    rows = rows.withColumn("_raw", F.get_json_object("_o", "$.errors"))
    items = F.when(F.ltrim("_raw").startswith("["), F.from_json("_raw", "array<string>"))
    rows = rows.withColumn("_items", F.coalesce(items, F.array().cast("array<string>"))).withColumn("_bad_list", F.col("_raw").isNotNull() & items.isNull())
    known = list(stats.JUDGE_POINTS)
    objects = F.filter("_items", lambda e: F.coalesce(F.ltrim(e).startswith("{"), F.lit(False)))

    def error(e: Column) -> Column:
        given = F.when(F.array_contains(F.json_object_keys(e), "severity"), F.coalesce(F.get_json_object(e, "$.severity"), F.lit("None"))).otherwise("Neutral")
        severity = F.when(given.isin(*known), given).otherwise("Neutral")
        return F.struct(F.get_json_object(e, "$.category").alias("category"), severity.alias("severity"), stats.points(severity, stats.JUDGE_POINTS, 0.0).alias("penalty"), (~given.isin(*known)).alias("unknown"))

    rows = rows.withColumn("errors", F.transform(objects, error))
    valid = F.col("_o").isNotNull() & (F.coalesce(F.get_json_object("_o", "$._error"), F.lit("")) == "")
    total = F.round(F.aggregate("errors", F.lit(0.0), lambda a, e: a + e["penalty"]), 3)
    acceptability = F.get_json_object("_o", "$.acceptability")
    empty = F.lower(acceptability).isin("reject", "major revision") & (F.size("errors") == 0)
    warnings = F.size(F.filter("errors", lambda e: e["unknown"])) + F.size("_items") - F.size("errors") + F.col("_bad_list").cast("int") + F.coalesce(empty, F.lit(False)).cast("int")
    rows = rows.withColumn("valid", valid).withColumn("acceptability", acceptability).withColumn("warnings", F.when(F.col("valid"), warnings).otherwise(0))
    rows = rows.withColumn("points", F.when(F.col("valid"), total)).withColumn("score", F.when(F.col("valid"), F.round(F.greatest(F.lit(0.0), 100 - 4 * F.col("points")), 2)))
    return rows.withColumn("errors", F.when(F.col("valid"), F.col("errors")).otherwise(F.slice("errors", 1, 0))).drop("_o", "_raw", "_items", "_bad_list")


def run_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: valid and failed replies, points, characters, points per 1000, weighted and mean score."""
    some = F.col("valid")
    out = results.groupBy(*keys).agg(F.count_if(some).alias("valid_n"), F.count_if(~some).alias("failed_n"), F.sum(F.when(some, F.col("points"))).alias("points"), F.sum(F.when(some, F.col("source_chars"))).alias("chars"), F.avg("score").alias("mean_score"))
    rate = F.when(F.col("chars") > 0, F.col("points") / F.col("chars") * 1000)
    return out.withColumn("points_per_1000", rate).withColumn("weighted_score", F.when(rate.isNotNull(), stats.dashboard(rate)))


def error_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    """Errors by category and severity."""
    return results.where("valid").select(*keys, F.explode("errors").alias("e")).groupBy(*keys, F.col("e.category").alias("category"), F.col("e.severity").alias("severity")).agg(F.count("*").alias("n"))


# The states of a file's judging.
ERROR, SCORED, PENDING, COLLECTED, FAILED, NOT_RUN = "error", "scored", "batch_submitted_pending", "batch_collected_no_scores", "grok_failed_or_partial", "grok_not_run"


def status(error: Column, average: Column, job: Column, collected: Column, failed: Column) -> Column:
    """State of a file's judging, from its error, its mean score, name and collection time of its batch job, and the number of failed replies."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(error), ERROR).when(average.isNotNull(), SCORED).when(given(job) & given(collected), COLLECTED).when(given(job), PENDING).when(F.coalesce(failed, F.lit(0)) > 0, FAILED).otherwise(NOT_RUN)


def key_parts(request_key: Column) -> tuple[Column, Column]:
    """Run and segment of a request key such as ``run_01:002:seg_...``; a key without colons is the segment."""
    parts = F.split(request_key, ":", 3)
    return F.when(request_key.startswith("run_"), F.get(parts, F.lit(0))).otherwise(""), F.element_at(parts, -1)


def with_requests(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results with what their requests hold; where a key has no request, run and segment come from the key itself."""
    run, segment = key_parts(F.col("request_key"))
    known = requests.select("request_key", F.col("run_id").alias("_run"), F.col("segment_id").alias("_segment"), "source_chars")
    out = results.join(known, "request_key", "left")
    return out.withColumn("run_id", F.coalesce("_run", run)).withColumn("segment_id", F.coalesce("_segment", segment)).withColumn("source_chars", F.greatest(F.coalesce("source_chars", F.lit(1)), F.lit(1))).drop("_run", "_segment")
