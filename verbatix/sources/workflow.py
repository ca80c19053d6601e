"""What a translation run left in its folder: conditions, their states, and how many messages it has.

All files here are small and have fixed places; they are read by Spark, so the folder
may be in any store.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: messages of a run that tells nothing of them.
USUAL_MESSAGES = 10_000


def read_json(spark: SparkSession, path: str, default: Any = None) -> Any:
    """The value of a small JSON file with or without a byte order mark, or ``default`` where there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException:
        return default
    return json.loads(rows[0].value.lstrip("\ufeff")) if rows else default


def first_json(spark: SparkSession, paths: list[str]) -> dict:
    """The first of several files that is there and holds an object; an empty one if none does."""
    return next((v for p in paths if isinstance(v := read_json(spark, p), dict)), {})


def condition_summary(spark: SparkSession, folder: str) -> dict:
    """The summary of a condition's translation, by its usual names."""
    return first_json(spark, [f"{folder}/translation_summary.json", f"{folder}/nomask_translation_summary.json", f"{folder}/*translation_summary*.json"])


def read_config(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON or YAML file; anything but a mapping is an error."""
    if path.endswith(".json"):
        found = read_json(spark, path)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package; JSON ones do not") from e
        found = yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def context(spark: SparkSession, folder: str) -> dict:
    """Conditions by slug (later entries win), their summaries, and the summary of the subset."""
    manifest = read_json(spark, f"{folder}/workflow_manifest.json") or {}
    summaries = manifest.get("condition_summaries") or read_json(spark, f"{folder}/condition_summaries_partial.json") or []
    summaries = [s for s in summaries if isinstance(s, dict)]
    given = [*manifest.get("conditions", []), *(s.get("condition") for s in summaries)]
    subset = read_json(spark, f"{folder}/subset/subset_summary.json") or manifest.get("subset") or {}
    return {"conditions": {str(c["slug"]): c for c in given if isinstance(c, dict) and c.get("slug")}, "summaries": summaries, "subset": subset}


def conditions(spark: SparkSession, found: dict) -> DataFrame:
    """(position, slug, id, description, status) of a context, as ``metrics.described`` takes them."""
    status = {str((s.get("condition") or {}).get("slug")): s.get("status") for s in reversed(found["summaries"])}
    rows = [(i, slug, str(c.get("id") or slug.split("_", 1)[0]), str(c.get("description") or ""), status.get(slug)) for i, (slug, c) in enumerate(found["conditions"].items())]
    return spark.createDataFrame(rows, "position int, slug string, id string, description string, status string")


def message_count(found: dict, selected: DataFrame | None = None, messages: DataFrame | None = None) -> int:
    """How many messages a run is of: what its subset tells, else the rows of its selection, else those of its first catalogue."""
    for key in ("selected_messages", "message_count", "sampling_frame_size"):
        try:
            n = int(float(found["subset"].get(key) or 0))
        except (TypeError, ValueError):
            n = 0
        if n > 0:
            return n
    if selected is not None and (n := selected.count()):
        return n
    if messages is not None:
        first = messages.agg(F.min("ts_file")).first()[0]
        if first is not None:
            return messages.where(F.col("ts_file") == first).count()
    return USUAL_MESSAGES


def output_name(path: Column) -> Column:
    """A name for a file's results: its stem without unusual characters, and eight digits of its path's SHA-1."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    plain = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), r"\A[._-]+|[._-]+\z", "")
    return F.concat(F.coalesce(F.nullif(plain, F.lit("")), F.lit("ts_file")), F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 8))
