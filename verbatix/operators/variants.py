"""Letters of another script variant in translations, found by a table of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T

#: Unicode has fewer ideographs than this, which bounds what is put into a query.
MOST_CHARS = 200_000


def read_variants(spark: SparkSession, path: str, prop: str = "kTraditionalVariant") -> DataFrame:
    """(char) that have a variant of ``prop`` other than themselves, from lines of (code point, property, variants)."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="code string, prop string, variants string")
    codes = F.transform(F.split("variants", r"\s+"), lambda v: F.substring_index(v, "<", 1))
    rows = rows.where((F.col("prop") == prop) & F.col("code").rlike(r"\AU\+[0-9A-Fa-f]{1,8}\z") & ~F.array_contains(codes, F.col("code")))
    four = F.unhex(F.lpad(F.substring("code", 3, 8), 8, "0"))
    return rows.select(F.decode(four, "UTF-32").alias("char")).distinct()


def letters(variants: DataFrame) -> str:
    """The characters of a table of variants, in order; there are at most as many as ideographs."""
    rows = variants.select("char").distinct().limit(MOST_CHARS + 1).collect()
    if len(rows) > MOST_CHARS:
        raise ValueError("a table of variants has a row per character")
    return "".join(sorted(r.char for r in rows))


def hits(text: Column, chars: str) -> Column:
    """The distinct characters of ``text`` that stand in ``chars``, sorted; one look-up per character of the text."""
    text = F.coalesce(text, F.lit(""))
    if not chars:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.split(text, ""), F.split(F.translate(text, chars, ""), "")))


def script_issues(segments: DataFrame, chars: str) -> DataFrame:
    """An issue row per message whose translation holds characters of ``chars``; the first twenty are its tokens."""
    rows = segments.withColumn("tokens", hits(T.normalized(F.col("translation")), chars)).where(F.size("tokens") > 0)
    keep = [c for c in ("ts_file", "segment_id", "idx", "condition_id", "context") if c in segments.columns]
    return rows.select(*keep, F.lit("script_variant_risk").alias("issue_type"), F.lit("minor").alias("severity"), F.slice("tokens", 1, 20).alias("tokens"))
