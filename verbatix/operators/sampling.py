"""Reproducible samples: the permutation of a seeded shuffle, issue-first choice, strata, and request rows."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sampling window has at most so many messages; its positions are what a plan holds on the driver.
WINDOW = 10_000
#: Up to so many rows a condition is numbered in one range.
RANGE_ROWS = 1_000_000
# Quotas of the strata, in order.
QUOTAS = {"numerus": 0.10, "qt_placeholder": 0.14, "accelerator": 0.12, "html_xml": 0.10, "glossary": 0.18, "number_code_newline": 0.16, "long": 0.10, "ordinary": 0.10}
_RANKS = {"critical": 0, "major": 1, "minor": 2, "info": 3}


def shuffled(items: Iterable, seed: int, rng: random.Random | None = None) -> list:
    """The order that a seeded Mersenne Twister shuffle gives; it depends on the length and the seed alone."""
    out = list(items)
    (rng or random.Random(seed)).shuffle(out)
    return out


def _planned(segments: DataFrame, plan: list[int]) -> DataFrame:
    rows = segments.sparkSession.createDataFrame([(int(i), k + 1) for k, i in enumerate(plan)], "idx long, sample_position int")
    return segments.join(F.broadcast(rows), "idx")  # at most WINDOW rows


def random_sample(segments: DataFrame, size: int, seed: int, window: int = WINDOW) -> DataFrame:
    """``size`` messages of the window in seeded order, with ``sample_position`` from 1."""
    pool = [r.idx for r in segments.where(F.col("idx") <= window).select("idx").orderBy("idx").limit(WINDOW).collect()]
    return _planned(segments, shuffled(pool, seed)[: max(0, size)])


def issue_first(issues: DataFrame, size: int) -> DataFrame:
    """The segments of the most severe issues: by severity, index, and check order; each once."""
    rank = F.coalesce(F.create_map(*(x for k, v in _RANKS.items() for x in (F.lit(k), F.lit(v))))[F.col("severity")], F.lit(9))
    first = issues.groupBy("idx").agg(F.min(F.struct(rank.alias("rank"), "idx", "check_ordinal")).alias("f"))
    return first.select("idx", F.col("f.rank").alias("rank")).orderBy("rank", "idx").limit(max(size, 1))


def enriched_sample(segments: DataFrame, issues: DataFrame, size: int, seed: int, mode: str = "mixed", window: int = WINDOW) -> DataFrame:
    """Issue-first segments (all of the quota, or half of it in mixed mode), then seeded ones of the rest."""
    pool = [r.idx for r in segments.where(F.col("idx") <= window).select("idx").orderBy("idx").limit(WINDOW).collect()]
    known, quota = set(pool), size // 2 if mode == "mixed" else size
    first = [r.idx for r in issue_first(issues.where(F.col("idx").between(1, window)), quota).collect() if r.idx in known]
    rest = shuffled([i for i in pool if i not in set(first)], seed)
    return _planned(segments, (first + rest[: max(0, size - len(first))])[:size])


def stratified(rows: list[tuple[int, list[str]]], size: int, seed: int) -> list[int]:
    """Indexes of a stratified subset; all passes share one random stream, so their order matters."""
    if size <= 0 or size >= len(rows):
        return [i for i, _ in rows]
    rng, taken = random.Random(seed), {}
    for name, share in QUOTAS.items():
        pool = shuffled([i for i, c in rows if name in c and i not in taken], seed, rng)
        taken |= dict.fromkeys(pool[: max(1, round(size * share))])
    if len(taken) < size:
        taken |= dict.fromkeys(shuffled([i for i, _ in rows if i not in taken], seed, rng)[: size - len(taken)])
    return sorted(shuffled(taken, seed, rng)[:size])


def stratified_sample(categorized: DataFrame, size: int, seed: int, window: int = WINDOW) -> DataFrame:
    rows = [(r.idx, r.categories) for r in categorized.where(F.col("idx") <= window).select("idx", "categories").orderBy("idx").limit(WINDOW).collect()]
    return _planned(categorized, stratified(rows, size, seed))


def repeated(segments: DataFrame, size: int, seed: int, repeats: int) -> DataFrame:
    """Samples of several runs; run r uses the seed plus r - 1."""
    out = None
    for r in range(1, repeats + 1):
        part = random_sample(segments, size, seed + r - 1).withColumn("run_id", F.lit(f"run_{r:02d}"))
        out = part if out is None else out.unionByName(part)
    return out


def budget(calls: int, files: int, repeats: int) -> int:
    """Requests for each file and run."""
    return max(1, calls // max(1, files * repeats))


def request_rows(sample: DataFrame, run_id: str, order: str = "idx") -> DataFrame:
    """Request keys of a sample: run, position in it, and segment.

    Positions are counted in ranges of the order: a first pass counts each condition in
    each range, and what lies in earlier ranges is added to the place within one. So a
    condition is never gathered in a task.
    """
    n = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sample.select("condition_id", "idx", order) if order != "idx" else sample.select("condition_id", "idx")
    size = rows.count()
    cuts = rows.approxQuantile(order, [k / n for k in range(1, n)], 0.01 / n if n > 1 else 0.0) if size > RANGE_ROWS else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col(order) > c).cast("int")
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("condition_id", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("condition_id").orderBy("_part")) - F.col("_n")).select("condition_id", "_part", "_before")
    place = F.row_number().over(Window.partitionBy("condition_id", "_part").orderBy(order))
    rows = rows.withColumn("_place", place).join(F.broadcast(before), (rows.condition_id.eqNullSafe(before.condition_id)) & (rows._part == before._part)).drop(before.condition_id, before._part)  # a row for each condition and range
    rows = rows.withColumn("sample_position", (F.col("_place") + F.col("_before")).cast("int"))
    key = F.concat(F.lit(f"{run_id}:"), F.format_string("%03d", "sample_position"), F.lit(":"), F.col("condition_id"), F.lit(":"), F.col("idx").cast("string"))
    return rows.select("condition_id", "idx", "sample_position", key.alias("request_key"))


def judge_keys(sample: DataFrame, run_id: str) -> DataFrame:
    """Request keys of the standalone judge: file, condition, run, four-digit position, and segment (ts_file, condition_id, sample_position, segment_id)."""
    key = F.concat_ws("|", "ts_file", "condition_id", F.lit(run_id), F.format_string("%04d", "sample_position"), "segment_id")
    return sample.withColumn("run_id", F.lit(run_id)).withColumn("request_key", key)


def pending(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a result yet."""
    return requests.join(done.select("request_key").distinct(), "request_key", "left_anti")
