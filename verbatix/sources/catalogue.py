"""Reading and writing message catalogues, glossaries and result files."""

from __future__ import annotations

import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T

_SCHEMA = "ts_file string, language string, idx int, context string, source string, translation string, translations array<string>, translation_type string, numerus boolean, locations array<string>, comment string, extracomment string"


def _text(element) -> str:
    return "" if element is None else "".join(element.itertext())


def _messages(path: str, content: bytes) -> Iterator[tuple]:
    root, index = ET.fromstring(content), 0
    for context in root.iter("context"):
        name = _text(context.find("name"))
        for m in context.findall("message"):
            index += 1
            t, numerus = m.find("translation"), m.get("numerus") == "yes"
            forms = [_text(f) for f in t.findall("numerusform")] if t is not None else []
            forms = forms or [_text(t)]
            kind = "missing_translation_element" if t is None else t.get("type", "")
            places = [f"{x.get('filename', '')}:{x.get('line')}" if x.get("line") else x.get("filename", "") for x in m.findall("location")]
            yield path, root.get("language", ""), index, name, _text(m.find("source")), " ||| ".join(forms), forms, kind, numerus, places, _text(m.find("comment")), _text(m.find("extracomment"))


def read_catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all catalogues below a path, in document order; files are parsed whole, each in one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(_messages(p, content)), columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ts").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "content").mapInPandas(parse, _SCHEMA).withColumnRenamed("translations", "forms")
    return rows.withColumn("segment_id", T.stable_id(F.col("context"), F.col("source"), F.col("idx"))).withColumn("condition_id", F.regexp_extract("ts_file", r"(C\d+)", 1))


def with_translations(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments with new translations (ts_file, idx, translation, unfinished): every plural form is set, and only ``unfinished`` ones keep a type."""
    new = translations.select("ts_file", "idx", F.col("translation").alias("_new"), F.coalesce("unfinished", F.lit(False)).alias("_open"))
    rows = segments.join(new, ["ts_file", "idx"], "left")
    forms = F.when(F.size("forms") > 0, F.transform("forms", lambda _: F.col("_new"))).otherwise(F.array("_new"))
    given = F.col("_new").isNotNull()
    kind = F.when(F.col("_open"), "unfinished").otherwise("")
    return rows.withColumns({"translation": F.when(given, F.when(F.col("numerus"), F.array_join(forms, " ||| ")).otherwise(F.col("_new"))).otherwise(F.col("translation")), "forms": F.when(given, forms).otherwise(F.col("forms")), "translation_type": F.when(given, kind).otherwise(F.col("translation_type"))}).drop("_new", "_open")


def _render(pdf: pd.DataFrame, language: str | None) -> str:
    pdf = pdf.sort_values("idx")
    root, last, node = ET.Element("TS", version="2.1", language=language or pdf["language"].iloc[0] or ""), None, None
    for r in pdf.itertuples():
        if node is None or r.context != last:
            node, last = ET.SubElement(root, "context"), r.context
            ET.SubElement(node, "name").text = r.context
        m = ET.SubElement(node, "message", **({"numerus": "yes"} if r.numerus else {}))
        for place in r.locations if r.locations is not None else []:
            name, _, line = place.rpartition(":")
            ET.SubElement(m, "location", **({"filename": name, "line": line} if name else {"filename": place}))
        ET.SubElement(m, "source").text = r.source
        for name in ("comment", "extracomment"):
            if getattr(r, name):
                ET.SubElement(m, name).text = getattr(r, name)
        if r.translation_type == "missing_translation_element":
            continue
        t = ET.SubElement(m, "translation", **({"type": r.translation_type} if r.translation_type else {}))
        if r.numerus:
            for form in r.forms:
                ET.SubElement(t, "numerusform").text = form
        else:
            t.text = r.translation
    ET.indent(root)
    return "<?xml version='1.0' encoding='utf-8'?>\n" + ET.tostring(root, encoding="unicode")


def write_catalogues(segments: DataFrame, path: str, language: str | None = None) -> None:
    """One ``.ts`` file per catalogue below ``path``, named like its source; a catalogue is one group and must fit one task.

    Contexts without messages are left out. ``language`` replaces that of the files.
    Tasks write parts, which are then renamed, so a lost task is run again. Two
    catalogues of one name would be one file and are refused.
    """
    spark = segments.sparkSession
    named = segments.withColumn("_name", F.regexp_extract("ts_file", r"([^/]+)\z", 1))
    if named.groupBy("_name").agg(F.countDistinct("ts_file").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("several catalogues have the same file name")
    render = lambda pdf: pd.DataFrame({"name": [pdf["_name"].iloc[0]], "value": [_render(pdf, language)]})
    parts = f"{path.rstrip('/')}/_parts"
    named.groupBy("_name").applyInPandas(render, "name string, value string").write.mode("overwrite").partitionBy("name").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(parts)
    store = where.getFileSystem(conf)
    for row in spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(parts).select("path").collect():  # as many as catalogues
        name = urllib.parse.unquote(urllib.parse.unquote(row.path).rsplit("/name=", 1)[1].rsplit("/", 1)[0])
        target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        store.delete(target, False)
        store.rename(jvm.org.apache.hadoop.fs.Path(row.path), target)
    store.delete(where, True)


def subset(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Only the chosen messages (ts_file, idx)."""
    return segments.join(chosen.select("ts_file", "idx").distinct(), ["ts_file", "idx"], "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line stays as text in ``_json_parse_error``, or fails the read if ``strict``."""
    reader = spark.read.schema(schema if strict else f"{schema}, _json_parse_error string")
    return reader.option("mode", "FAILFAST").json(path) if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_json_parse_error").json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all as text, without a byte order mark."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))


def write_report(df: DataFrame, path: str, first: tuple[str, ...] = (), one_file: bool = False) -> None:
    """CSV with a byte order mark, the columns in ``first`` leading, and maps, arrays and structs as JSON.

    ``one_file`` is for tables with a row per condition or file.
    """
    names = [*(c for c in first if c in df.columns), *(c for c in df.columns if c not in first)]
    kinds = dict(df.dtypes)
    flat = [(F.to_json(c) if kinds[c].startswith(("map", "array", "struct")) else F.col(c)).alias(f"\ufeff{c}" if c == names[0] else c) for c in names]
    out = df.select(*flat)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def subset_report(segments: DataFrame) -> DataFrame:
    """What a subset holds: a row per message with its categories and places joined."""
    return segments.select(F.col("idx").alias("original_index"), "context", "source", "numerus", F.array_join("categories", ";").alias("categories"), "translation_type", F.array_join("locations", "; ").alias("locations"))


def batch_requests(requests: DataFrame, model: str, url: str = "/v1/responses") -> DataFrame:
    """Lines of a batch file: custom id, method, place and body."""
    body = F.struct(F.lit(model).alias("model"), F.col("prompt").alias("input"))
    return requests.select(F.to_json(F.struct(F.col("request_key").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))).alias("value"))


def markdown(df: DataFrame, most: int = 50) -> str:
    """A table of the first rows, for reports."""
    lines = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(most).collect()])
