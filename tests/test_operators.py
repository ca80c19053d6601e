import random

from pyspark.sql import functions as F

from verbatix.operators import candidates, checks, glossary, judge, metrics, sampling
from verbatix.sources import catalogue
from verbatix.streaming import resume

SEGMENT = "idx long, condition_id string, context string, source string, translation string, translation_type string"

TS = """<?xml version="1.0"?><TS version="2.1" language="zh_TW"><context><name>A</name>
<message><location filename="a.cpp" line="3"/><source>x
</source><translation>x</translation></message>
<message numerus="yes"><source>%n items</source><translation><numerusform>%n 個</numerusform><numerusform>%n 個</numerusform></translation></message>
<message><source>q <byte/> r</source></message></context></TS>"""


def kinds(df):
    return {(r.idx, r.issue_type) for r in df.collect()}


def test_checks_and_profiles(spark):
    rows = [(1, "C0", "c", "%1 %1", "%1", ""), (2, "C0", "c", "EPSG:4326", "EPSG:4326", ""), (3, "C0", "c", "Plain words to translate", "Plain words to translate", "unfinished"), (4, "C0", "c", "x\n", "x", ""), (5, "C0", "c", "a", "", "missing_translation_element"), (6, "C0", "c", None, None, "")]
    df = spark.createDataFrame(rows, SEGMENT)
    found = kinds(checks.checks(df))
    assert {(1, "missing_qt_placeholder"), (3, "possibly_untranslated"), (3, "unfinished_translation"), (4, "newline_count_mismatch"), (5, "empty_translation"), (5, "missing_translation_element"), (6, "empty_translation")} == found
    lost = checks.checks(df).where("idx = 1").first()
    assert lost.tokens == ["%1"] and lost.severity == "critical"


def test_catalogue_and_plurals(spark, tmp_path):
    (tmp_path / "C1_x.ts").write_text(TS, encoding="utf-8")
    rows = catalogue.read_catalogues(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r.idx for r in rows] == [1, 2, 3]
    assert rows[0].source == "x\n" and rows[0].locations == ["a.cpp:3"] and rows[0].condition_id == "C1"
    assert rows[2].translation_type == "missing_translation_element" and rows[2].source == "q  r"
    assert rows[1].translation == "%n 個 ||| %n 個"
    found = kinds(checks.checks(catalogue.read_catalogues(spark, str(tmp_path))))
    assert found == {(1, "newline_count_mismatch"), (3, "empty_translation"), (3, "missing_translation_element")}
    catalogue.write_catalogues(catalogue.read_catalogues(spark, str(tmp_path)), str(tmp_path / "out"))
    assert "numerusform" in (tmp_path / "out" / "C1_x.ts").read_text(encoding="utf-8")


def test_scores_have_all_groups(spark):
    df = spark.createDataFrame([(1, "C0", "c", "a", "Aa", ""), (2, "C1", "c", "%1", "b", "")], SEGMENT)
    totals = metrics.facts(checks.checked(df))
    scores = metrics.structure_scores(totals).collect()
    assert len(scores) == 16 and {r.score for r in scores} == {0.0, 100.0}
    assert metrics.structure_scores(totals, completion=True).count() == 18
    pair = metrics.compare(totals, "C0").first()
    assert pair.condition_id == "C1" and pair.relative_reduction == 1.0
    again = metrics.facts(metrics.attach(df, checks.checks(df)))
    assert sorted(map(tuple, again.select(totals.columns).collect())) == sorted(map(tuple, totals.collect()))


def test_failed_rate_counts_segments_of_all_groups(spark):
    rows = [(1, "C0", "c", "%1", "a", ""), (2, "C0", "c", "x\ny", "x y", ""), (3, "C0", "c", "same", "Same", ""), *((k, "C1", "c", "a", "Aa", "") for k in (1, 2, 3))]
    pair = metrics.compare(metrics.facts(checks.checked(spark.createDataFrame(rows, SEGMENT))), "C1").first()
    assert pair.failed == 2 and abs(pair.failed_rate - 2 / 3) < 1e-12  # two groups, one segment each


def test_plurals_and_residue(spark):
    df = spark.createDataFrame([(1, "C0", "c", "%n files", "%n x ||| y", "", ["%n x", "y"]), (2, "C0", "c", "Open this file now", "開啟 Open this file now", "", ["開啟 Open this file now"]), (3, "C0", "c", "Open", "Open - 開啟", "", None)], SEGMENT + ", forms array<string>")
    found = {(r.idx, r.issue_type, r.form_index) for r in checks.checks(df).collect()}
    assert found == {(1, "missing_qt_placeholder", 2), (2, "high_english_residue", 0), (3, "bilingual_residue", 0)}


def test_glossary_longest_first(spark):
    df = spark.createDataFrame([(1, "C0", "c", "Add raster layers", "x", "")], SEGMENT)
    g = spark.createDataFrame([(1, "layer", ["圖層"], ["x"], "high"), (2, "raster layer", [], [], "low")], "entry_pos int, source_term string, target_terms array<string>, forbidden_terms array<string>, priority string")
    found = glossary.hits(df, g)
    assert [(r.entry_pos, r["rank"]) for r in found.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert {(r.issue_type, r.severity) for r in glossary.term_checks(df, found, g).collect()} == {("forbidden_term", "major"), ("glossary_target_missing", "major")}


def test_samples_are_seeded(spark):
    df = spark.createDataFrame([(i, "C0", "c", "s", "t", "") for i in range(1, 21)], SEGMENT)
    order = list(range(1, 21))
    random.Random(7).shuffle(order)
    got = [r.idx for r in sampling.random_sample(df, 5, 7).orderBy("sample_position").collect()]
    assert got == order[:5]
    rows = [(i, ["ordinary"] if i % 2 else ["numerus"]) for i in range(40)]
    assert sampling.stratified(rows, 10, 3) == sampling.stratified(rows, 10, 3) and len(sampling.stratified(rows, 10, 3)) == 10


def test_judge(spark):
    good = '{"segment_id":"a","acceptability":"ok","errors":[{"category":"A","severity":"Major","penalty":1},{"category":"B","severity":"Severe"}]}'
    rows = [("1", good), ("2", f"```json\n{good}\n```"), ("3", "no"), ("4", None)]
    out = {r.k: r for r in judge.normalize(spark.createDataFrame(rows, "k string, reply string")).collect()}
    assert (out["1"].points, out["1"].score, out["1"].warnings) == (5.0, 80.0, 1) and out["2"].points == 5.0
    assert out["3"].points is None and not out["4"].valid and out["3"].score is None
    rows = [("1", '{"errors":[{"severity":"Major"}]}'), ("2", '{"acceptability":"Reject"}'), ("3", '{"errors":[1,{"category":"A"}]}'), ("4", '{"errors":"x"}'), ("5", '{"_error":"x"}'), ("6", '{"errors":[{"severity":null}]}')]
    out = {r.k: (r.points, r.warnings) for r in judge.normalize(spark.createDataFrame(rows, "k string, reply string")).collect()}
    assert out == {"1": (5.0, 0), "2": (0.0, 1), "3": (0.0, 1), "4": (0.0, 1), "5": (None, 0), "6": (0.0, 1)}


def test_envelopes_and_languages(spark):
    rows = [('{"output_text":"a"}',), ('{"choices":[{"message":{"content":"b"}}]}',), ('{"output":[{"content":[{"text":"c"}]}]}',), ("d",)]
    assert [r.x for r in spark.createDataFrame(rows, "s string").select(judge.reply_text(F.col("s")).alias("x")).collect()] == list("abcd")
    files = spark.createDataFrame([("a.ts", "zh_TW"), ("b.ts", "de"), ("c.ts", None)], "ts_file string, language string")
    assert [r.ts_file for r in checks.language_issues(files).collect()] == ["b.ts", "c.ts"]


def test_accelerators_and_parts(spark):
    rows = spark.createDataFrame([("A &amp; B&&C &Save E&xit &",), ("&&&x",)], "s string").select(candidates.without_accelerators(F.col("s")).alias("w")).collect()
    assert rows[0].w.text == "A &amp; B&&C Save Exit " and rows[0].w.tokens == ["&S", "&x", "&"] and rows[1].w.text == "&&x"
    back = spark.createDataFrame([("A &amp; B ", ["&a"]), ("x(&S)", ["&S"]), ("y", [])], "s string, t array<string>").select(candidates.with_accelerators(F.col("s"), F.col("t")).alias("x")).collect()
    assert [r.x for r in back] == ["A &amp; B(&a) ", "x(&S)", "y"]
    df = spark.createDataFrame([("Open %1 file<b>42</b>",), ("%1",), ("",)], "s string").withColumn("sp", candidates.mask_spans("s"))
    got = [[(x.id, x.text, x.left_token_slot, x.right_token_slot) for x in r.x] for r in df.select(candidates.text_requests(candidates.parts(F.col("s"), F.col("sp"))).alias("x")).collect()]
    assert got == [[("T0", "Open ", "", "TOK_0"), ("T1", " file", "TOK_0", "TOK_1")], [], []]


def test_fallback_terms_and_request_positions(spark):
    df = spark.createDataFrame([(1, "C0", "c", "開啟圖層", "x", ""), (2, "C0", "c", "圖", "x", ""), (3, "C0", "c", "", "x", "")], SEGMENT)
    g = spark.createDataFrame([(1, "圖層"), (2, "圖"), (3, "開圖"), (4, "layer")], "entry_pos int, source_term string")
    assert {(r.idx, r.entry_pos) for r in glossary.fallback_hits(df, g).collect()} == {(1, 1), (1, 2), (2, 2)}
    rows = spark.createDataFrame([((i * 37) % 101, f"C{i % 2}") for i in range(101)], "idx long, condition_id string")
    one = sorted(map(tuple, sampling.request_rows(rows, "run_01").collect()))
    sampling.RANGE_ROWS, kept = 10, sampling.RANGE_ROWS
    try:
        assert sorted(map(tuple, sampling.request_rows(rows, "run_01").collect())) == one
    finally:
        sampling.RANGE_ROWS = kept
    assert sorted(r[2] for r in one if r[0] == "C0") == list(range(1, 52))


def test_masking_restores(spark):
    rows = spark.createDataFrame([("Open %1 <b>{n}</b> 3.5\n",), ("",), (None,)], "s string").withColumn("sp", candidates.mask_spans("s"))
    got = rows.select("s", "sp", candidates.skeleton(F.col("s"), F.col("sp")).alias("k")).withColumn("back", candidates.assemble(F.col("k"), F.col("sp"))).collect()
    assert got[0].k.startswith("Open ⟦TOK_0⟧ ⟦TOK_1⟧") and got[0].back == got[0].s and got[1].back == ""


def test_stream_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text('{"request_key":"a","segment_id":"1","status":"ok","reply":"x"}\n{"request_key":"b%d","segment_id":"2","status":"ok","reply":"y"}\n' % k)
        resume.collect_results(resume.results(spark, str(src)), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.request_key for r in spark.read.parquet(out).collect()) == ["a", "b0", "b1"]
