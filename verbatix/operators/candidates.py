"""Masking of format tokens, candidate choice, and statistics of translation logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import stats
from ..functions import tokens as T

# Words that may stay in Latin letters.
ALLOWED_LATIN = (
    "QGIS", "GIS", "GPS", "CRS", "EPSG", "GDAL", "OGR", "SQL", "API", "URL", "URI", "UUID", "WMS", "WFS", "WMTS", "WCS", "XYZ",
    "HTTP", "HTTPS", "JSON", "XML", "HTML", "CSV", "SVG", "PDF", "PNG", "JPEG", "TIFF", "GeoTIFF", "PostGIS", "Python", "Qt", "LAS", "LiDAR",
)
_MASKED = [("qt", T.QT), ("brace", T.BRACE), ("printf", T.PRINTF), ("entity", T.ENTITY), ("tag", T.RAW_TAG), ("ampersand", "&&"), ("control", T.ESCAPED_CONTROL), ("newline", r"[\n\t\r]"), ("number", r"(?<![%\w])[-+]?\d+(?:[.,]\d+)?(?![%\w])")]
_COMPILED = [(k, re.compile(p)) for k, p in _MASKED]


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("token", StringType()), StructField("kind", StringType())]))


def _spans(text: str | None) -> list[dict]:
    found = sorted((m.start(), -len(m[0]), rank, m[0], kind) for rank, (kind, p) in enumerate(_COMPILED) for m in p.finditer(text or ""))
    out, end = [], 0
    for start, length, _, token, kind in found:
        if start >= end and length:
            out.append({"start": start, "end": start - length, "token": token, "kind": kind})
            end = start - length
    return out


@F.pandas_udf(SPANS)
def mask_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spans to protect: all patterns, leftmost then longest, without overlap."""
    for s in texts:
        yield s.map(_spans)


def skeleton(text: Column, spans: Column) -> Column:
    """The text with each protected span as a numbered slot."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit("⟦TOK_"), (i - 1).cast("string"), F.lit("⟧"), g))), "")


def assemble(filled: Column, spans: Column) -> Column:
    """Slots replaced by their tokens."""
    return F.aggregate(F.transform(spans, lambda s, i: F.struct(F.concat(F.lit("⟦TOK_"), i.cast("string"), F.lit("⟧")).alias("slot"), s["token"].alias("token"))), filled, lambda a, s: F.replace(a, s["slot"], s["token"]))


def with_accelerators(text: Column, accelerators: Column) -> Column:
    """Mnemonics put back as ``(&X)`` before trailing white space, unless the text has them as mnemonics."""
    body, tail = F.regexp_replace(text, r"(?U)\s+\z", ""), F.regexp_extract(text, r"(?U)\s*\z", 0)
    full = F.aggregate(accelerators, body, lambda a, t: F.when((t == "") | F.array_contains(T.accelerator_tokens(a), t), a).otherwise(F.concat(a, F.lit("("), t, F.lit(")"))))
    return F.when(F.size(accelerators) > 0, F.concat(full, tail)).otherwise(text)


def without_accelerators(text: Column) -> Column:
    """(text, tokens): mnemonic markers removed and remembered; entities and doubled ampersands stay."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(&&|{T.ENTITY})|&", "$1")
    return F.struct(plain.alias("text"), T.accelerator_tokens(text).alias("tokens"))


def is_translatable(text: Column) -> Column:
    """Whether a text has words to translate: Latin letters, and more than a code or two capitals."""
    s = T.normalized(text)
    small = s.rlike("[a-z]")
    return s.rlike("[A-Za-z]") & (small | (~s.rlike(rf"\A{T.COPY_OK}\z") & (F.length(s) > 2)))


def parts(text: Column, spans: Column) -> Column:
    """The text as an array of (kind, value, slot, text_id): tokens with their slots, texts between them, and ids of those to translate."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    blank = F.lit("")
    shape = lambda kind, value, slot, wanted: F.struct(F.lit(kind).alias("kind"), value.alias("value"), slot.alias("slot"), wanted.alias("wanted"))
    gaps = F.zip_with(starts, ends, lambda a, b: shape("text", F.substring(text, a + 1, b - a), blank, is_translatable(F.substring(text, a + 1, b - a))))
    tokens = F.transform(spans, lambda s, i: shape("token", s["token"], F.concat(F.lit("TOK_"), i.cast("string")), F.lit(False)))
    mixed = F.filter(F.flatten(F.transform(gaps, lambda g, i: F.array_compact(F.array(F.when(g["value"] != "", g), F.get(tokens, i))))), lambda p: p.isNotNull())
    return mixed


def text_requests(pieces: Column) -> Column:
    """(id, text, left_token_slot, right_token_slot) of the texts to translate, numbered in order, with the slots beside them."""
    beside = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(pieces, i - 1)["slot"], F.lit("")).alias("left"), F.coalesce(F.get(pieces, i + 1)["slot"], F.lit("")).alias("right")))
    wanted = F.filter(beside, lambda x: x["p"]["wanted"])
    return F.transform(wanted, lambda x, i: F.struct(F.concat(F.lit("T"), i.cast("string")).alias("id"), x["p"]["value"].alias("text"), x["left"].alias("left_token_slot"), x["right"].alias("right_token_slot")))


# Quotes and labels that models put around a translation.
QUOTES = (("「", "」"), ('"', '"'), ("'", "'"))
LABELS = ("譯文：", "翻譯：", "Translation:", "Translated text:", "答案：")


def stripped(text: Column) -> Column:
    """A translation without code fences, quotes around it, and labels before it."""
    trim = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    t = trim(F.regexp_replace(trim(F.coalesce(text, F.lit(""))), r"(?iU)\A```(?:json|text|zh|zh-tw|markdown)?\s*", ""))
    t = trim(F.regexp_replace(t, r"(?U)\s*```\z", ""))
    for a, b in QUOTES:
        t = trim(F.regexp_replace(t, rf"(?s)\A{a}(.*){b}\z", "$1"))
    for label in LABELS:
        t = trim(F.regexp_replace(t, rf"\A{label}", ""))
    return t


def sanitized(text: Column, forbidden: Column, slots: Column) -> Column:
    """A translated part without slots and without the tokens that it may not bring, longest first."""
    bare = F.aggregate(slots, stripped(text), lambda a, s: F.replace(F.replace(a, F.concat(F.lit("⟦"), s, F.lit("⟧")), F.lit("")), s, F.lit("")))
    longest = F.array_sort(F.transform(F.filter(F.array_distinct(forbidden), lambda t: t != ""), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.aggregate(longest, bare, lambda a, t: F.replace(a, t["t"], F.lit("")))


def parse_candidates(raw: Column, wanted: int) -> Column:
    """(candidates, issues) of a reply: a list below ``candidates``, a bare list, or a single object with ``translation``."""
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)\A```(?:json)?\s*", ""), r"\s*```\z", "")
    good = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    cut = lambda t, pattern: F.nullif(F.regexp_extract(t, pattern, 0), F.lit(""))
    # A text that parses as it is comes first; else the first cut that is there must parse.
    found = lambda t: F.coalesce(good(t), bind(F.coalesce(cut(t, r"(?s)\{.*\}"), cut(t, r"(?s)\[.*\]")), good))
    none = F.array().cast("array<struct<issue_type:string,severity:string>>")
    issue = lambda kind, severity: F.array(F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity")))

    def items(obj: Column) -> Column:
        listed = F.get_json_object(obj, "$.candidates")
        single = F.ltrim(obj).startswith("{") & F.get_json_object(obj, "$.translation").isNotNull()
        return F.when(F.ltrim(listed).startswith("["), F.from_json(listed, "array<string>")).when(F.ltrim(obj).startswith("["), F.from_json(obj, "array<string>")).when(single, F.array(obj))

    def one(x: Column, i: Column) -> Column:
        number = F.coalesce(F.get_json_object(x, "$.candidate_no").try_cast("int"), i + 1)
        return F.when(F.ltrim(x).startswith("{"), F.struct(number.alias("candidate_no"), stripped(F.get_json_object(x, "$.translation")).alias("translation")))

    def shape(o: Column) -> Column:
        some = F.coalesce(F.array_compact(F.transform(F.slice(o["items"], 1, wanted), one)), F.array().cast("array<struct<candidate_no:int,translation:string>>"))
        return bind(some, lambda c: F.struct(c.alias("candidates"), F.when(o["obj"].isNull(), issue("model_json_parse_failed", "critical")).when(o["items"].isNull(), issue("model_json_unexpected_shape", "critical")).when(F.size(c) < wanted, issue("missing_candidate_count", "minor")).otherwise(none).alias("issues")))

    return bind(bind(bind(text, found), lambda obj: F.struct(obj.alias("obj"), items(obj).alias("items"))), shape)


def latin_residue(text: Column) -> Column:
    """Latin words of three and more characters that are neither allowed nor in capitals."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9_+.#-]{2,}"), F.lit(0))
    return F.size(F.filter(words, lambda w: ~w.isin(*ALLOWED_LATIN) & (w != F.upper(w))))


def length_penalty(source: Column, translation: Column) -> Column:
    """0 for usual length ratios, else the distance from 1."""
    ratio = F.length(T.normalized(translation)) / F.greatest(F.length(T.normalized(source)), F.lit(1))
    return F.when(ratio.between(0.25, 2.8), F.lit(0.0)).otherwise(F.abs(ratio - 1.0))


def quality(source: Column, translation: Column, issues: Column) -> Column:
    """Weighted issues, Latin residue twice, and three times the length penalty; less is better."""
    weighed = F.aggregate(issues, F.lit(0.0), lambda a, i: a + stats.points(F.lower(i["severity"]), stats.CANDIDATE_POINTS))
    return weighed + 2.0 * latin_residue(translation) + 3.0 * length_penalty(source, translation)


def best_candidate(candidates: DataFrame, keys: list[str], masked: bool = False) -> DataFrame:
    """The candidate with the least (quality, number); in masked mode only clean ones count and the source stands in where none is."""
    order = F.struct("quality", "candidate_no")
    chosen = F.min(F.when(~F.col("blocking"), order) if masked else order)
    text = F.min_by("translation", F.when(~F.col("blocking"), order) if masked else order)
    out = candidates.groupBy(*keys).agg(chosen.alias("c"), text.alias("t"), F.first("source").alias("source"), F.count("*").alias("candidates"))
    return out.select(*keys, "candidates", F.col("c.candidate_no").alias("candidate_no"), F.col("c.quality").alias("quality"), F.coalesce("t", "source").alias("translation"), F.col("c").isNull().alias("fallback"))


def log_statistics(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per condition from log rows (status, candidates): rows, fallbacks, candidate totals and averages, clean shares."""
    total = F.size("candidates")
    clean = F.size(F.filter("candidates", lambda c: ~c["blocking"]))
    rows = log.select(*keys, "status", total.alias("n"), clean.alias("ok"))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.lower("status").contains("fallback")).alias("fallbacks"), F.sum("n").alias("candidates"), F.sum("ok").alias("valid"), F.avg("n").alias("avg_candidates"), F.avg("ok").alias("avg_valid"), F.count_if(F.col("ok") == 0).alias("rows_without_valid"))
