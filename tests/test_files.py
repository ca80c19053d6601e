"""Sources, sinks and command lines on real files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from verbatix import cli
from verbatix.operators import prompts, variants
from verbatix.sources import catalogue, glossaries, workflow

TS = """<?xml version="1.0" encoding="utf-8"?><TS version="2.1" language="zh_TW">
<context><name>A</name>
<message><location filename="a.cpp" line="3"/><source>Open %1 now please</source><comment>c</comment><translation>開啟 %1 国</translation></message>
<message numerus="yes"><source>%n files were found</source><translation><numerusform>%n 個</numerusform><numerusform>{}</numerusform></translation></message>
</context><context><name>B</name>
<message><source>Raster layer</source><translation type="unfinished">Raster layer</translation></message></context></TS>"""


def run_folder(tmp_path, name, form="%n 個"):
    folder = tmp_path / name / "outputs_ts"
    folder.mkdir(parents=True)
    (folder / "C0_plain.ts").write_text(TS.format(form), encoding="utf-8")
    (folder / "C1_mask.ts").write_text(TS.format("個"), encoding="utf-8")
    return str(tmp_path / name)


def ods(sheets):
    row = lambda r: "<table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" if c else "<table:table-cell/>" for c in r) + '<table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    body = "".join(f'<table:table table:name="{n}">{"".join(map(row, rows))}<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row></table:table>' for n, rows in sheets.items())
    xml = f'<o:document-content xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0">{body}</o:document-content>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", xml)
    return out.getvalue()


def xlsx(rows):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_roles_of_headers():
    assert glossaries.roles(["id", "英語", "繁中"]) == {"source": 1, "target": 2}
    assert glossaries.roles(["English", "ZH-TW", "Severity", "my notes"]) == {"source": 0, "target": 1, "priority": 2, "note": 3}
    assert glossaries.roles(["x", "y"]) == {"source": 0, "target": 1}
    assert glossaries.roles(["x"]) == {"source": 0}


def test_glossaries_of_all_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffEnglish,中文,禁用,Severity\nlayer,圖層;層,图层,HIGH\nLayer,圖層;層,图层,low\n,x,,\nnan,y,,\n".encode())
    (tmp_path / "b.ods").write_bytes(ods({"one": [["id", "英語", "繁中"], ["1", "coordinate system", "坐標系統"], ["2", "raster", ""]], "two": [["only"], ["x"]]}))
    (tmp_path / "c.xlsx").write_bytes(xlsx([["source", "target", "領域"], ["map", "地圖", "core"]]))
    rows = glossaries.read_glossaries(spark, str(tmp_path)).orderBy("entry_pos").collect()
    assert [(r.source_term, r.target_terms, r.priority, r.source_file, r.sheet) for r in rows] == [
        ("coordinate system", ["坐標系統"], "medium", "b.ods", "one"),
        ("layer", ["圖層", "層"], "high", "a.csv", "csv"),
        ("map", ["地圖"], "medium", "c.xlsx", "S"),
    ]
    assert rows[1].forbidden_terms == ["图层"] and rows[2].domain == "core"
    assert glossaries.report(glossaries.read_glossaries(spark, [str(tmp_path / "a.csv")])).first().target_terms == "圖層|層"


def test_catalogues_round_trip(spark, tmp_path):
    folder = run_folder(tmp_path, "w")
    rows = catalogue.read_catalogues(spark, f"{folder}/outputs_ts")
    catalogue.write_catalogues(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("*.ts")) == ["C0_plain.ts", "C1_mask.ts"]
    plain = lambda df: sorted(map(str, df.drop("ts_file").collect()))
    assert plain(catalogue.read_catalogues(spark, str(tmp_path / "out"))) == plain(rows)
    new = rows.where("idx < 3 AND ts_file LIKE '%C0%'").select("ts_file", "idx", F.lit("新").alias("translation"), (F.col("idx") == 1).alias("unfinished"))
    catalogue.write_catalogues(catalogue.subset(catalogue.with_translations(rows, new), new), str(tmp_path / "sub"), "zh-Hant")
    got = catalogue.read_catalogues(spark, str(tmp_path / "sub")).orderBy("idx").collect()
    assert [(r.language, r.context, r.forms, r.translation_type) for r in got] == [("zh-Hant", "A", ["新"], "unfinished"), ("zh-Hant", "A", ["新", "新"], "")]


def test_reports_have_a_mark_and_keep_their_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", {"b": 1}, 'q "r"\nt')], "b string, m map<string,int>, a string")
    catalogue.write_report(df, str(tmp_path / "r"), ("a",), one_file=True)
    assert next((tmp_path / "r").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,b,m")
    got = catalogue.read_rows(spark, str(tmp_path / "r"))
    assert got.columns == ["a", "b", "m"] and tuple(got.first()) == ('q "r"\nt', "x", '{"b":1}')


def test_script_variants(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# c\nU+56FD\tkTraditionalVariant\tU+570B<kX\nU+4E07\tkTraditionalVariant\tU+4E07 U+842C\nU+9EBA\tkSimplifiedVariant\tU+9762\nU+2B5AF\tkTraditionalVariant\tU+9E1D\n", encoding="utf-8")
    chars = variants.letters(variants.read_variants(spark, str(tmp_path / "v.txt")))
    assert chars == "国\U0002b5af"
    df = spark.createDataFrame([(1, "國国\U0002b5af国"), (2, None), (3, ""), (4, "萬万")], "idx int, translation string").withColumn("condition_id", F.lit("C0"))
    assert [r.h for r in df.orderBy("idx").select(variants.hits(F.col("translation"), chars).alias("h")).collect()] == [["国", "\U0002b5af"], [], [], []]
    assert [(r.idx, r.severity) for r in variants.script_issues(df, chars).collect()] == [(1, "minor")]


def test_workflow_of_a_run(spark, tmp_path):
    folder = str(tmp_path)
    assert workflow.read_json(spark, f"{folder}/none.json", 5) == 5
    (tmp_path / "workflow_manifest.json").write_bytes("\ufeff".encode() + json.dumps({"conditions": [{"slug": "C0_plain", "id": "C0", "description": "first"}], "condition_summaries": [{"condition": {"slug": "C0_plain", "id": "C0", "description": "second"}, "status": "ok"}, 3], "subset": {"selected_messages": "12"}}).encode())
    found = workflow.context(spark, folder)
    assert workflow.message_count(found) == 12 and workflow.message_count({"subset": {}}) == 10_000
    assert tuple(workflow.conditions(spark, found).first()) == (0, "C0_plain", "C0", "second", "ok")
    (tmp_path / "x_translation_summary_2.json").write_text('{"n": 1}')
    assert workflow.condition_summary(spark, folder) == {"n": 1}
    names = spark.createDataFrame([("/a/b c.ts",), ("/a/..ts",)], "p string").select(workflow.output_name(F.col("p")).alias("n"))
    assert [r.n[:-9] for r in names.collect()] == ["b_c", "ts_file"]


def test_prompts_and_schemas(spark):
    issues = [(f"k{i}", "minor") for i in range(30)]
    df = spark.createDataFrame([("s", issues, [("T0",), ("T1",)])], "source string, issues array<struct<issue_type:string,severity:string>>, parts array<struct<id:string>>")
    row = df.select(prompts.prompt("Do", "judge", F.col("source"), issues=F.col("issues")).alias("p"), prompts.part_schema(F.col("parts"), 2).alias("s")).first()
    assert row.p.count("\n- ") == 25 and row.p.startswith("Do\n\nSource:\ns")
    one = json.loads(row.s)["properties"]["candidates"]["items"]["properties"]["translations"]
    assert one["required"] == ["T0", "T1"] and one["additionalProperties"] is False
    assert prompts.candidate_schema(3)["properties"]["candidates"]["items"]["required"] == ["candidate_no", "translation"]


def test_commands(spark, tmp_path):
    one, two = run_folder(tmp_path, "one"), run_folder(tmp_path, "two", "檔案")
    (tmp_path / "g.csv").write_text("source,target\nraster layer,網格圖層\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"reference": "C0_plain", "outdir": "ignored"}')
    report = cli.main(["--config", str(tmp_path / "c.json"), "score", one, "--outdir", str(tmp_path / "s"), "--glossary", str(tmp_path / "g.csv")], spark)
    text = spark.read.text(report, wholetext=True).first().value
    assert "## Against C0_plain" in text and "Messages: 3" in text
    got = {r.slug: r for r in catalogue.read_rows(spark, str(tmp_path / "s/condition_summary.csv")).collect()}
    assert set(got) == {"C0_plain", "C1_mask"} and got["C0_plain"].condition_id == "C0"
    assert int(got["C1_mask"].issues) > int(got["C0_plain"].issues)
    kinds = {r.issue_type for r in spark.read.parquet(str(tmp_path / "s/issues")).collect()}
    assert {"glossary_target_missing", "unfinished_translation", "missing_qt_placeholder"} <= kinds
    cli.main(["compare", f"a={one}", f"b={two}", "--outdir", str(tmp_path / "c")], spark)
    assert {r.experiment for r in catalogue.read_rows(spark, str(tmp_path / "c/conditions.csv")).collect()} == {"a", "b"}
    lines = spark.read.text(cli.main(["mqm", one, "--outdir", str(tmp_path / "m"), "--sample-size", "2"], spark)).collect()
    assert len(lines) == 4 and {"custom_id", "body"} <= set(json.loads(lines[0].value))
    cli.main(["translate", f"{one}/outputs_ts/C0_plain.ts", "--subset-mode", "first", "--sample-size", "2", "--outdir", str(tmp_path / "t")], spark)
    assert catalogue.read_catalogues(spark, str(tmp_path / "t/subset")).count() == 2
    assert "C1_mask" in cli.main(["list", one], spark)
