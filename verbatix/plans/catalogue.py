"""Named queries over the supplied tables, and the SQL that gives the same rows.

Messages are derived from ``documents``: source and translation are built around the
whole text, and ``doc_id % 10`` chooses how the translation differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, terms
from ..functions import tokens as T
from ..operators import candidates, checks, glossary, judge, metrics, sampling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt to all of them, as texts cost more to check than to move."""
    rows, cores = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


_SEGMENTS = """WITH base AS (SELECT doc_id + 1 AS idx, lang AS condition_id, source AS context,
 coalesce(text, '') AS body, CAST(doc_id AS {S}) AS num, doc_id % 10 AS mut FROM documents),
 made AS (SELECT *, concat('&Open %1 {{n}} %s <b>', body, '</b> &lt; ', num, chr(10)) AS source FROM base)
SELECT idx, condition_id, context, source,
 CASE mut
 WHEN 0 THEN source
 WHEN 1 THEN concat('Öffnen(&O) {{n}} %s <b>', body, '</b> &lt; ', num, chr(10))
 WHEN 2 THEN concat('Öffnen(&O) %1 %1 {{m}} %s <b>', body, '</b> &lt; ', num, chr(10))
 WHEN 3 THEN concat('Öffnen(&O) %1 {{n}} %d ', body, ' &lt; ', num, chr(10))
 WHEN 4 THEN concat('Öffnen(&O) %1 {{n}} %s <b>', body, '</b> < ', num)
 WHEN 5 THEN concat('Öffnen(&X) %1 {{n}} %s <b>', body, '</b> &lt; ', chr(10))
 WHEN 6 THEN ''
 WHEN 8 THEN concat('開啟(&O) %1 {{n}} %s <b>', body, '</b> &lt; ', num, chr(10))
 WHEN 9 THEN concat(source, ' - 開啟')
 ELSE concat('Öffnen(&O) %1 {{n}} %s <b>', body, '</b> &lt; ', num, chr(10)) END AS translation,
 CASE WHEN mut = 7 THEN 'unfinished' WHEN mut = 6 THEN 'missing_translation_element' ELSE '' END AS translation_type
FROM made"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "documents").createOrReplaceTempView("catalogue_documents")  # resolved at once by the next line
    return spark.sql(_SEGMENTS.format(S="STRING").replace("FROM documents", "FROM catalogue_documents"))


def _checked(spark: SparkSession, sf_dir: str, profile: str = "evaluator") -> DataFrame:
    return checks.checked(segments(spark, sf_dir), profile)


def _issues(spark: SparkSession, sf_dir: str, profile: str = "evaluator") -> DataFrame:
    return checks.checks(segments(spark, sf_dir), profile)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.facts(_checked(spark, sf_dir))


def token_counts(spark, sf_dir):
    kinds = ("qt_placeholder", "brace_placeholder", "printf_placeholder", "html_xml_entity", "html_xml_tag", "accelerator", "escaped_control", "raw_tag")
    rows = segments(spark, sf_dir).select("condition_id", "translation", T.marks(F.col("source")).alias("source_marks"), T.marks(F.col("translation")).alias("translation_marks"))
    rows = rows.select("condition_id", *(F.size(T.EXTRACTORS[k](F.col(f"{c}_marks"))).alias(f"{c}_{k}") for k in kinds for c in ("source", "translation")), T.latin_count(F.col("translation")).alias("latin"), T.cjk_count(F.col("translation")).alias("cjk"), T.newline_count(F.col("translation")).alias("newlines"))
    names = [c for c in rows.columns if c != "condition_id"]
    return rows.groupBy("condition_id").agg(*(F.sum(c).cast("long").alias(c) for c in names))


def issue_rows(spark, sf_dir):
    return _issues(spark, sf_dir).select("idx", "condition_id", "issue_type", "severity", F.size("tokens").cast("long").alias("n_tokens"))


def plural_issues(spark, sf_dir):
    """Every message with two plural forms: its translation, and that without its first placeholder."""
    rows = segments(spark, sf_dir).withColumn("forms", F.array("translation", F.replace("translation", F.lit("%1"), F.lit(""))))
    return checks.checks(rows).select("idx", "condition_id", "form_index", "issue_type", "severity", F.size("tokens").cast("long").alias("n_tokens"))


def issue_type_counts(spark, sf_dir):
    return metrics.issue_counts(_checked(spark, sf_dir))


def type_pivot(spark, sf_dir):
    return metrics.pivot_types(issue_type_counts(spark, sf_dir), [*checks.COMPLETION, *checks.CONTENT[:3], "missing_number", "extra_number"])


def structure_scores(spark, sf_dir):
    return metrics.structure_scores(_facts(spark, sf_dir))


def completion_scores(spark, sf_dir):
    return metrics.structure_scores(_facts(spark, sf_dir), completion=True).where("item = 'completion_state'")


def structure_average(spark, sf_dir):
    return metrics.structure_average(structure_scores(spark, sf_dir))


def first_window_scores(spark, sf_dir):
    return metrics.structure_scores(metrics.facts(metrics.first_window(_checked(spark, sf_dir), 100)))


def deterministic_summary(spark, sf_dir):
    return metrics.summary(_facts(spark, sf_dir))


def attached_summary(spark, sf_dir):
    """The summary from a table of issues in place of arrays, with a synthetic issue of each condition's file."""
    rows = segments(spark, sf_dir)
    files = rows.select("condition_id").distinct().select("condition_id", F.lit(0).cast("long").alias("idx"), F.lit("ts_language_mismatch").alias("issue_type"), F.lit("major").alias("severity"))
    return metrics.summary(metrics.facts(metrics.attach(rows, checks.checks(rows).select(*files.columns).unionByName(files))))


def failed_segments(spark, sf_dir):
    return metrics.failed_segments(_issues(spark, sf_dir))


def failed_summary(spark, sf_dir):
    return metrics.failed_summary(failed_segments(spark, sf_dir))


def condition_comparison(spark, sf_dir):
    return metrics.compare(_facts(spark, sf_dir), "en")


def structure_pivot(spark, sf_dir):
    return metrics.pivot_scores(structure_scores(spark, sf_dir))


def best_and_worst(spark, sf_dir):
    return metrics.best_and_worst(structure_scores(spark, sf_dir))


def file_means(spark, sf_dir):
    rows = deterministic_summary(spark, sf_dir).select("deterministic_score", "segment_score", F.when(F.col("condition_id") == "de", "broken").alias("error"))
    return metrics.mean_scores(rows, ["deterministic_score", "segment_score"])


def report_rows(spark, sf_dir):
    """The first rows of the report of structure items; conditions are numbered from their languages."""
    rows = structure_scores(spark, sf_dir).withColumn("condition_id", F.concat(F.lit("C"), F.ascii("condition_id").cast("string"), F.col("condition_id")))
    return metrics.report_order(rows.select("condition_id", "item", "affected")).limit(20)


def described_conditions(spark, sf_dir):
    """Conditions of which some slugs are known, one of them twice."""
    known = spark.createDataFrame([(1, "C1_en", "C1", "first", "ok"), (2, "C1_en", "C1", "second", "failed"), (3, "C2_fr", "C2", "third", None)], "position int, slug string, id string, description string, status string")
    rows = _facts(spark, sf_dir).select(F.concat(F.lit("C"), F.when(F.col("condition_id") == "en", "1").when(F.col("condition_id") == "fr", "2").otherwise("7"), F.lit("_"), "condition_id").alias("slug"), "messages")
    return metrics.described(rows, known)


def labelled_union(spark, sf_dir):
    parts = {"all": deterministic_summary(spark, sf_dir).select("condition_id", "messages", "issues"), "judge": _issues(spark, sf_dir, "judge").groupBy("condition_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"))}
    return metrics.labelled_union(parts)


def profile_severities(spark, sf_dir):
    out = None
    for name in checks.PROFILES:
        part = _issues(spark, sf_dir, name).groupBy("severity").agg(F.count("*").alias("n")).withColumn("profile", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def message_categories(spark, sf_dir):
    """Categories of messages, of bare texts, and of short codes, by turns."""
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("condition_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = segments(spark, sf_dir).select("idx", "source")
    rows = docs.join(made, docs.doc_id + 1 == made.idx)
    source = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("Plain "), F.when(F.col("doc_id") % 2 == 0, "%n words").otherwise("words")))
    return rows.select("condition_id", F.explode(checks.categories(source)).alias("category")).groupBy("condition_id", "category").agg(F.count("*").alias("n"))


def stable_ids(spark, sf_dir):
    return segments(spark, sf_dir).select("idx", T.stable_id(F.col("context"), F.col("source"), F.col("idx")).alias("segment_id"))


def issue_first(spark, sf_dir):
    return sampling.issue_first(_issues(spark, sf_dir), 50)


def request_rows(spark, sf_dir):
    return sampling.request_rows(segments(spark, sf_dir), "run_01")


def pending_requests(spark, sf_dir):
    rows = request_rows(spark, sf_dir)
    return sampling.pending(rows, rows.where("idx % 4 = 0"))


def random_sample(spark, sf_dir):
    return sampling.random_sample(segments(spark, sf_dir), 50, 42).select("idx", "condition_id", "sample_position")


def mixed_sample(spark, sf_dir):
    return sampling.enriched_sample(segments(spark, sf_dir), _issues(spark, sf_dir), 50, 42).select("idx", "condition_id", "sample_position")


def stratified_sample(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("categories", checks.categories(F.col("source")))
    return sampling.stratified_sample(rows, 50, 42).select("idx", "condition_id", "sample_position")


def event_severity(spark, sf_dir):
    """Events as issue facts: their type is the issue type, the user the segment."""
    e = _table(spark, sf_dir, "events")
    level = F.expr("CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'info' END")
    users = e.select("user_id").distinct().agg(F.count("*").alias("checked"))
    rows = e.withColumn("severity", level).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("affected"), F.sum(stats.points(F.col("severity"), stats.ISSUE_POINTS)).alias("points"))
    rows = rows.join(F.broadcast(users), F.lit(True))  # one row
    low, high = stats.wilson(F.col("affected"), F.col("checked"))
    return rows.select("event_type", "n", "affected", "points", stats.safe_rate(F.col("affected"), F.col("checked")).alias("rate"), low.alias("low"), high.alias("high"))


def page_tokens(spark, sf_dir):
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", *(F.size(T.EXTRACTORS[k](html)).cast("long").alias(k) for k in ("html_xml_tag", "raw_tag", "html_xml_entity", "brace_placeholder", "accelerator")))


def _glossary(spark, sf_dir) -> DataFrame:
    """A glossary made from the test items: terms are short, so an entry's is the first one, two or three words of its item, by turns."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +")
    words = F.filter(words, lambda w: w != "")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 1, (F.col("item_id") % 3 + 1).cast("int")), " ").alias("source_term"))
    return rows.where("source_term != ''").select((F.col("item_id") + 1).cast("int").alias("entry_pos"), "source_term", F.array("source_term").alias("target_terms"), F.array(F.lit("Öffnen")).alias("forbidden_terms"), F.expr("CASE item_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END").alias("priority"))


def _ascii_segments(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select((F.col("doc_id") + 1).alias("idx"), F.col("lang").alias("condition_id"), F.regexp_replace(F.lower("text"), "[^a-z0-9 \n]", " ").alias("source"), F.concat(F.lit("Öffnen "), F.lower("text")).alias("translation"))


def glossary_hits(spark, sf_dir):
    return glossary.hits(_ascii_segments(spark, sf_dir), _glossary(spark, sf_dir), cap=12).select("idx", "condition_id", "entry_pos", "size", "rank")


def glossary_issues(spark, sf_dir):
    s, g = _ascii_segments(spark, sf_dir), _glossary(spark, sf_dir)
    return glossary.term_checks(s, glossary.hits(s, g), g).groupBy("condition_id", "issue_type", "severity").agg(F.count("*").alias("n"))


def term_accuracy(spark, sf_dir):
    s, g = _ascii_segments(spark, sf_dir), _glossary(spark, sf_dir)
    return glossary.accuracy(s, glossary.hits(s, g), g)


def singular_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.explode(terms.term_tokens(F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), fold=False)).alias("token"))
    return rows.groupBy("token", terms.singular(F.col("token")).alias("singular")).agg(F.count("*").alias("n"))


def _candidates(spark, sf_dir) -> DataFrame:
    """Turns of a conversation as candidates for its first turn."""
    t = _table(spark, sf_dir, "conversations").where("text is not null")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("source"))
    rows = t.join(first, "conv_id").withColumn("severity", F.expr("CASE turn % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' ELSE 'info' END"))
    issues = F.array(F.struct(F.col("severity").alias("severity")))
    return rows.select("conv_id", F.col("turn").alias("candidate_no"), "source", F.col("text").alias("translation"), (F.col("turn") % 3 == 0).alias("blocking"), candidates.quality(F.col("source"), F.col("text"), issues).alias("quality"))


def candidate_quality(spark, sf_dir):
    return _candidates(spark, sf_dir).select("conv_id", "candidate_no", "blocking", "quality")


def best_candidates(spark, sf_dir):
    return candidates.best_candidate(_candidates(spark, sf_dir), ["conv_id"]).select("conv_id", "candidates", "candidate_no", "quality", "translation")


def masked_choice(spark, sf_dir):
    return candidates.best_candidate(_candidates(spark, sf_dir), ["conv_id"], masked=True).select("conv_id", "candidate_no", "fallback", "translation")


def log_statistics(spark, sf_dir):
    rows = _candidates(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(F.struct("candidate_no", "blocking")).alias("candidates"))
    log = rows.withColumn("grp", F.col("conv_id") % 5).withColumn("status", F.when(F.col("conv_id") % 7 == 0, "source_fallback").otherwise("ok"))
    return candidates.log_statistics(log, ["grp"])


def _judged(spark, sf_dir) -> DataFrame:
    """Replies made from documents; ``doc_id % 13`` chooses their shape, ``doc_id % 5`` the severity of errors."""
    level = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Minor' WHEN 1 THEN 'Major' WHEN 2 THEN 'Critical' WHEN 3 THEN 'Severe' ELSE 'Neutral' END")
    error = F.concat(F.lit('{"category":"Accuracy","severity":"'), level, F.lit('","penalty":99}'))
    kind, two = F.col("doc_id") % 13, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(","), error)).otherwise("")
    plain = (
        F.when(kind == 0, "no answer")
        .when(kind == 1, '{"acceptability":"acceptable","errors":{"a":1}}')
        .when(kind == 2, '{"acceptability":"Major Revision","errors":[]}')
        .when(kind == 3, F.concat(F.lit('{"errors":['), error, F.lit("]}")))
        .when(kind == 4, F.concat(F.lit('{"acceptability":"acceptable","errors":["x",3,'), error, F.lit("]}")))
        .when(kind == 5, '{"_error":"timeout","errors":[]}')
        .when(kind == 6, '{"errors":[{"category":"Style"}]}')
        .otherwise(F.concat(F.lit('{"segment_id":"'), F.col("doc_id").cast("string"), F.lit('","acceptability":"acceptable","errors":['), error, two, F.lit("]}")))
    )
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(plain)
    docs = _table(spark, sf_dir, "documents")
    return judge.normalize(docs.select(F.col("lang").alias("condition_id"), (F.col("doc_id") % 3).alias("run"), "doc_id", F.greatest("n_chars", F.lit(1)).alias("source_chars"), reply.alias("reply")))


def judge_points(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "valid", "points", "score", "warnings")


def judge_runs(spark, sf_dir):
    return judge.run_scores(_judged(spark, sf_dir), ["condition_id", "run"])


def judge_errors(spark, sf_dir):
    return judge.error_counts(_judged(spark, sf_dir), ["condition_id"])


def judge_repeats(spark, sf_dir):
    return metrics.run_summary(judge_runs(spark, sf_dir), ["condition_id"], "weighted_score")


def judge_table(spark, sf_dir):
    return metrics.runs_and_average(judge_runs(spark, sf_dir), ["condition_id"], ["weighted_score", "mean_score"])


def judge_status(spark, sf_dir):
    """States of files whose summaries ``doc_id % 7`` makes."""
    k = F.col("doc_id") % 7
    args = (F.when(k == 0, "no file"), F.when(k.isin(1, 2), 50.0), F.when(k.isin(2, 3, 4), "job"), F.when(k == 4, "now"), F.when(k == 5, 2))
    return _table(spark, sf_dir, "documents").select("doc_id", judge.status(*args).alias("status"))


def judge_requests(spark, sf_dir):
    """Replies joined with their requests; for every fifth document only the key is known."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("run_0"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(":001:seg_"), F.col("doc_id").cast("string")).alias("request_key"), F.col("n_chars").alias("source_chars"))
    known = docs.where("doc_id % 5 != 0").select("request_key", F.lit("run_09").alias("run_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("segment_id"), "source_chars")
    return judge.with_requests(docs.select("doc_id", "request_key"), known).select("doc_id", "run_id", "segment_id", "source_chars")


def log_status(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("lang").alias("condition_id"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'source_fallback' WHEN 2 THEN 'copied' END").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    return metrics.status_counts(rows, ["condition_id"])


def _capital(letter: Column) -> Column:
    """The capital of one letter as one letter, as the SQL has it; where Java has several (SS, FI) the letter stays, but for sharp s, which has a capital of its own."""
    return F.when(F.length(F.upper(letter)) == 1, F.upper(letter)).otherwise(F.replace(letter, F.lit("ß"), F.lit("ẞ")))


def translatable(spark, sf_dir):
    """Whether whole texts, their digits and signs, and their first letters need a translation."""
    text = F.coalesce("text", F.lit(""))
    first = F.concat(*(_capital(F.substring(text, at, 1)) for at in (1, 2)))
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.alias("a"), F.regexp_replace(text, "[a-zA-Z]", "").alias("b"), first.alias("c"))
    return rows.select("doc_id", *(candidates.is_translatable(F.col(c)).alias(f"{c}_wanted") for c in "abc"))


def stripped_replies(spark, sf_dir):
    """Turns of conversations in fences, quotes or behind a label, as models send them."""
    t = _table(spark, sf_dir, "conversations")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\"'「」`\s]+", " ")
    made = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```text\n"), text, F.lit("\n```"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("「"), text, F.lit("」"))).when(F.col("turn") % 4 == 2, F.concat(F.lit(" 譯文： '"), text, F.lit("'"))).otherwise(text)
    made = F.concat(made, F.when(F.col("turn") % 4 == 3, "⟦TOK_0⟧ %1 %12").otherwise(""))
    clean = candidates.sanitized(made, F.array(F.lit("%1"), F.lit("%12"), F.lit("")), F.array(F.lit("TOK_0")))
    return t.select("conv_id", "turn", F.sha1(clean.cast("binary")).alias("digest"), F.length(clean).alias("n_chars"))


def parsed_candidates(spark, sf_dir):
    """Replies with candidates in the shapes that models use; ``doc_id % 6`` chooses."""
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    two = F.concat(F.lit('[{"candidate_no":2,"translation":"\'a'), n, F.lit('\'"},{"translation":"b"},{"candidate_no":"x","translation":"c"},7]'))
    raw = F.when(k == 0, F.concat(F.lit('{"candidates":'), two, F.lit("}"))).when(k == 1, two).when(k == 2, F.concat(F.lit('```json\n{"translation":"a'), n, F.lit('"}\n```'))).when(k == 3, "nothing").when(k == 4, '{"other":1}').otherwise(F.concat(F.lit("Here: "), F.lit('{"candidates":[]}')))
    rows = _table(spark, sf_dir, "documents").select("doc_id", candidates.parse_candidates(raw, 3).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p.candidates", lambda c: F.concat_ws("=", c["candidate_no"].cast("string"), c["translation"])), ";").alias("found"), F.array_join(F.col("p.issues.issue_type"), ";").alias("issues"))


def part_requests(spark, sf_dir):
    """Texts to translate of every masked message, with the slots beside them."""
    rows = segments(spark, sf_dir).withColumn("spans", candidates.mask_spans("source")).withColumn("parts", candidates.parts(F.col("source"), F.col("spans")))
    return rows.select("idx", F.inline(candidates.text_requests(F.col("parts"))))


def mask_skeletons(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("spans", candidates.mask_spans(F.col("source")))
    skeleton = candidates.skeleton(F.col("source"), F.col("spans"))
    return rows.select("idx", F.size("spans").alias("n_spans"), skeleton.alias("skeleton"), (candidates.assemble(skeleton, F.col("spans")) == F.col("source")).alias("restored"))


def number_tokens(spark, sf_dir):
    return segments(spark, sf_dir).select("idx", F.array_join(T.number_tokens(F.col("source")), " ").alias("numbers"))


_NAMES = (
    "token_counts issue_rows plural_issues issue_type_counts type_pivot structure_scores completion_scores structure_average first_window_scores deterministic_summary "
    "attached_summary failed_segments failed_summary file_means report_rows described_conditions judge_table judge_requests log_status translatable stripped_replies "
    "parsed_candidates part_requests "
    "condition_comparison structure_pivot best_and_worst labelled_union profile_severities message_categories stable_ids issue_first request_rows "
    "pending_requests random_sample mixed_sample stratified_sample event_severity page_tokens glossary_hits glossary_issues term_accuracy "
    "singular_tokens candidate_quality best_candidates masked_choice log_statistics judge_points judge_runs judge_errors judge_repeats judge_status "
    "mask_skeletons number_tokens"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}


# SQL for DuckDB. Its regular expressions have no look-around, so numbers are split on what may not touch them.
def _extract(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def _tokens(kind: str, c: str) -> str:
    if kind == "qt_placeholder":
        return _extract(c, T.QT)
    if kind == "brace_placeholder":
        return _extract(c, T.BRACE)
    if kind == "printf_placeholder":
        return f"list_filter({_extract(c, T.PRINTF)}, lambda t: NOT regexp_full_match(t, '{T.QT}'))"
    if kind == "html_xml_entity":
        return f"list_filter({_extract(c, T.ENTITY)}, lambda t: t IN {T.CHECKED_ENTITIES})"
    if kind == "html_xml_tag":
        return f"list_filter(list_transform({_extract(c, T.TAG, 1)}, lambda t: lower(t)), lambda t: t IN {tuple(T.HTML_TAGS)})"
    if kind == "number":
        parted = f"regexp_replace(regexp_replace({c}, '([\\pL\\pN_%])[-+]([0-9])', '\\1 \\2', 'g'), '([\\pL\\pN_%])[-+]([0-9])', '\\1 \\2', 'g')"
        free = f"regexp_replace({parted}, '[\\pL_%][\\pL\\pN_%]*|[\\pN]+[.,]?[\\pN]*[\\pL_%][\\pL\\pN_%]*', ' ', 'g')"
        return _extract(free, "[-+]?[0-9]+(?:[.,][0-9]+)?")
    if kind == "accelerator":
        return f"list_filter({_extract(c, '&&|' + T.ENTITY + '|&[^ \\t\\r\\n\\f\\v]|&')}, lambda t: t <> '&&' AND NOT regexp_full_match(t, '{T.ENTITY}'))"
    return _extract(c, {"escaped_control": T.ESCAPED_CONTROL, "raw_tag": T.RAW_TAG}[kind])


def _less(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE coalesce(list_sum(list_transform(list_distinct({a}), lambda x: greatest(0, len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x))))), 0)::BIGINT END"


_S = f"s AS ({_SEGMENTS.format(S='VARCHAR')})"
_NORM = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _issue_sql(profile: str = "evaluator", name: str = "i", base: str = "s", form: str = "0") -> str:
    """Rules of the checks over ``base``; with ``form`` its rows are plural forms, and those of the whole text stand with the first."""
    rules, kinds = checks.PROFILES[profile], [*checks.GROUPS[:6], "accelerator"]
    if rules["controls"]:
        kinds.insert(6, "escaped_control")
    target = "translation" if form == "0" else "text_of_form"
    cols = ", ".join(f"{_tokens(k, c)} AS {p}_{k}" for k in kinds for p, c in (("s", "source"), ("t", target)))
    s, t = _NORM.format("source"), _NORM.format("translation")
    once = "TRUE" if form == "0" else "form = 1"
    latin, cjk = "len(regexp_extract_all(translation, '[A-Za-z]'))", "len(regexp_extract_all(translation, '[一-鿿]'))"
    parts = [
        ("empty_translation", "critical", 1, f"{once} AND {t} = ''", "0"),
        ("unfinished_translation", "major", 2, f"{once} AND translation_type = 'unfinished'", "0"),
        ("missing_translation_element", "critical", 3, f"{once} AND translation_type = 'missing_translation_element'", "0"),
        ("possibly_untranslated", "major", 4, f"{once} AND {s} = {t} AND {s} <> '' AND NOT regexp_full_match({s}, '{T.COPY_OK}')", "0"),
        ("bilingual_residue", "major", 5, f"{once} AND (" + " OR ".join(f"starts_with({t}, {s} || ' {d}')" for d in "-–—") + ")", "0"),
        ("high_english_residue", "minor", 6, f"{once} AND {cjk} > 0 AND {latin} > greatest(12, 1.2 * {cjk}) AND NOT regexp_matches(source, 'SQL|HTML|API|CRS')", "0"),
    ]
    at = 10
    for k in kinds:
        if k == "accelerator":
            continue
        missing, extra = ("major", "minor") if k == "number" else ("major", "major") if k == "escaped_control" else rules["entity" if k.startswith("html") else "placeholder"]
        for word, level, a, b in (("missing", missing, "s", "t"), ("extra", extra, "t", "s")):
            n = _less(f"{a}_{k}", f"{b}_{k}")
            parts.append((f"{word}_{k}", level, at, f"{n} > 0", n))
            at += 1
    parts.append(("newline_count_mismatch", "minor", 30, f"length(source) - length(replace(source, chr(10), '')) <> length({target}) - length(replace({target}, chr(10), ''))", "0"))
    n = f"{_less('s_accelerator', 't_accelerator')} + {_less('t_accelerator', 's_accelerator')}"
    parts.append(("accelerator_count_mismatch", "minor", 31, f"{n} > 0", n))
    rows = " UNION ALL ".join(f"SELECT idx, condition_id, {o} AS check_ordinal, '{k}' AS issue_type, '{lv}' AS severity, {n} AS n_tokens, {form if o >= 10 else 0} AS form_index FROM {name}_t WHERE {w}" for k, lv, o, w, n in parts)
    return f"{name}_t AS MATERIALIZED (SELECT *, {cols} FROM {base}), {name} AS ({rows})"


_I = f"{_S}, {_issue_sql()}"
_GROUP = "CASE " + " ".join(f"WHEN issue_type IN ('missing_{g}', 'extra_{g}') THEN '{g}'" for g in checks.GROUPS[:6]) + " WHEN issue_type = 'newline_count_mismatch' THEN 'newline' WHEN issue_type = 'accelerator_count_mismatch' THEN 'accelerator'" + f" WHEN issue_type IN {checks.COMPLETION} THEN 'completion_state' WHEN issue_type IN {checks.CONTENT} THEN 'content_or_terminology' ELSE 'other_structure' END"


def _wilson_sql(k: str, n: str, sign: str) -> str:
    m, z = f"greatest({n}, 1)::DOUBLE", "1.96::DOUBLE"
    p, zz = f"({k}::DOUBLE / {m})", f"({z} * {z})"
    d = f"(1 + {zz} / {m})"
    body = f"({p} + {zz} / (2 * {m})) / {d} {sign} {z} * sqrt({p} * (1 - {p}) / {m} + {zz} / (4 * {m} * {m})) / {d}"
    return f"CASE WHEN {n} > 0 THEN {'greatest(' + body + ', 0)' if sign == '-' else 'least(' + body + ', 1)'} ELSE 0 END"


def _scores_sql(limit: str = "") -> str:
    where = f"WHERE idx BETWEEN 1 AND {limit}" if limit else ""
    groups = ", ".join(f"'{g}'" for g in checks.GROUPS)
    return f"""c AS (SELECT condition_id, count(*) AS checked FROM s {where} GROUP BY 1),
 g AS (SELECT condition_id, checked, unnest([{groups}]) AS item FROM c),
 h AS (SELECT condition_id, {_GROUP} AS item, count(DISTINCT idx) AS affected, count(*) AS issues FROM i {where} GROUP BY 1, 2),
 z AS (SELECT g.condition_id, g.item, checked, coalesce(affected, 0) AS affected, coalesce(issues, 0) AS issues FROM g LEFT JOIN h USING (condition_id, item)),
 sc AS (SELECT *, 100.0::DOUBLE * (1 - affected::DOUBLE / checked) AS score, 100 * {_wilson_sql('affected', 'checked', '-')} AS low_pct, 100 * {_wilson_sql('affected', 'checked', '+')} AS high_pct FROM z)"""


_POINTS = "CASE severity WHEN 'critical' THEN 12.0 WHEN 'major' THEN 5.0 WHEN 'minor' THEN 1.5 ELSE 0.0 END::DOUBLE"
_SUMMARY = f"""zc AS (SELECT condition_id, count(*) AS messages, sum(greatest(length(source), 1))::BIGINT AS chars FROM s GROUP BY 1),
 ic AS (SELECT condition_id, count(*) AS issues, sum({_POINTS}) AS points, count(DISTINCT idx) AS affected, count(*) FILTER (severity = 'critical' OR issue_type IN {metrics.BLOCKING}) AS blocking,
 {', '.join(f"count(DISTINCT CASE WHEN starts_with(issue_type, '{p}') THEN idx END) AS _{n}" for n, p in (('placeholder', 'missing_qt_placeholder'), ('brace', 'missing_brace_placeholder'), ('tag', 'missing_html_xml_tag'), ('entity', 'missing_html_xml_entity')))} FROM i GROUP BY 1),
 su AS (SELECT condition_id, messages, chars, coalesce(issues, 0) AS issues, coalesce(points, 0) AS points, coalesce(affected, 0) AS affected, coalesce(blocking, 0) AS blocking,
 coalesce(points, 0) / chars * 1000 AS points_per_1000, greatest(0, 100 - coalesce(points, 0) / chars * 1000) AS deterministic_score, greatest(0, 100 - 10 * coalesce(points, 0) / messages) AS segment_score,
 coalesce(affected, 0)::DOUBLE / messages AS affected_rate, {', '.join(f'1 - coalesce(_{n}, 0)::DOUBLE / messages AS {n}_kept' for n in ('placeholder', 'brace', 'tag', 'entity'))} FROM zc LEFT JOIN ic USING (condition_id))"""
_FAILED = f"fa AS (SELECT condition_id, idx, {_GROUP} AS item, string_agg(issue_type, '; ' ORDER BY check_ordinal) AS issue_types, string_agg(severity, '; ' ORDER BY check_ordinal) AS severities, count(*) AS n FROM i GROUP BY 1, 2, 3 HAVING {_GROUP} IN {checks.GROUPS})"
_REQ = "rq AS (SELECT condition_id, idx, (row_number() OVER (PARTITION BY condition_id ORDER BY idx))::INT AS sample_position FROM s), rk AS (SELECT *, 'run_01:' || printf('%03d', sample_position) || ':' || condition_id || ':' || idx AS request_key FROM rq)"
_CAND = f"""t AS (SELECT * FROM conversations WHERE text IS NOT NULL), f AS (SELECT conv_id, arg_min(text, turn) AS source FROM t GROUP BY 1),
 q AS (SELECT t.conv_id, turn AS candidate_no, source, text AS translation, turn % 3 = 0 AS blocking,
 CASE turn % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE + 2.0 * len(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+.#-]{{2,}}'), lambda w: w NOT IN {tuple(candidates.ALLOWED_LATIN)} AND w <> upper(w)))
 + 3.0 * CASE WHEN length({_NORM.format('text')})::DOUBLE / greatest(length({_NORM.format('source')}), 1) BETWEEN 0.25 AND 2.8 THEN 0 ELSE abs(length({_NORM.format('text')})::DOUBLE / greatest(length({_NORM.format('source')}), 1) - 1) END AS quality
 FROM t JOIN f ON t.conv_id = f.conv_id)"""
_JUDGE = """j0 AS (SELECT doc_id, lang AS condition_id, doc_id % 3 AS run, greatest(n_chars, 1) AS source_chars, doc_id % 13 NOT IN (0, 5) AS valid,
 CASE WHEN doc_id % 13 IN (0, 1, 2, 5, 6) THEN 0 WHEN doc_id % 13 IN (3, 4) THEN 1 ELSE 1 + (doc_id % 2 = 0)::INT END AS n, doc_id % 13 AS kind,
 CASE doc_id % 5 WHEN 0 THEN 'Minor' WHEN 1 THEN 'Major' WHEN 2 THEN 'Critical' ELSE 'Neutral' END AS severity, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 25 ELSE 0 END::DOUBLE AS one, doc_id % 5 = 3 AS odd FROM documents),
 j AS (SELECT *, CASE WHEN valid THEN n * one END AS points, CASE WHEN valid THEN greatest(0, 100 - 4 * n * one) END AS score,
 CASE WHEN valid THEN CASE WHEN odd THEN n ELSE 0 END + CASE kind WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END ELSE 0 END AS warnings FROM j0),
 r0 AS (SELECT condition_id, run, count(*) FILTER (valid) AS valid_n, count(*) FILTER (NOT valid) AS failed_n, sum(points) AS points, sum(CASE WHEN valid THEN source_chars END)::BIGINT AS chars, avg(score) AS mean_score FROM j GROUP BY 1, 2),
 r AS (SELECT *, points / chars * 1000 AS points_per_1000, greatest(0, 100 - points / chars * 1000) AS weighted_score FROM r0)"""
_SINGULAR = "CASE WHEN length({0}) > 5 AND {0} LIKE '%ies' THEN left({0}, -3) || 'y' WHEN length({0}) > 4 AND ({0} LIKE '%ches' OR {0} LIKE '%shes' OR {0} LIKE '%xes' OR {0} LIKE '%zes') THEN left({0}, -2) WHEN length({0}) > 3 AND {0} LIKE '%s' AND NOT ({0} LIKE '%ss' OR {0} LIKE '%us' OR {0} LIKE '%is') THEN left({0}, -1) ELSE {0} END"
_GLOSS = f"""ge AS (SELECT (item_id + 1)::INT AS entry_pos, list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w <> ''), 1, item_id % 3 + 1) AS tk, CASE item_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority FROM benchmark),
 gk AS (SELECT entry_pos, priority, array_to_string(tk, ' ') AS term, array_to_string(list_transform(tk, lambda w: {_SINGULAR.format('w')}), ' ') AS key, len(tk)::INT AS size FROM ge WHERE len(tk) > 0),
 gf AS (SELECT list(DISTINCT string_split(key, ' ')[1]) AS firsts FROM gk),
 sr AS (SELECT doc_id + 1 AS idx, lang AS condition_id, 'Öffnen ' || lower(text) AS translation, regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9 \\n]', ' ', 'g'), '[a-z0-9]+') AS raw FROM documents),
 se AS (SELECT idx, condition_id, translation, raw AS tk FROM sr UNION ALL SELECT idx, condition_id, translation, list_transform(raw, lambda w: {_SINGULAR.format('w')}) FROM sr),
 gr AS (SELECT DISTINCT idx, condition_id, size, unnest(list_transform(list_filter(range(1, len(tk) - size + 2), lambda p: list_contains(firsts, tk[p])), lambda p: array_to_string(list_slice(tk, p, p + size - 1), ' '))) AS key FROM se, gf, (SELECT DISTINCT size FROM gk) WHERE len(tk) >= size),
 hi AS (SELECT DISTINCT gr.idx, gr.condition_id, entry_pos, gk.size, priority, term FROM gr JOIN gk ON gr.key = gk.key AND gr.size = gk.size),
 ht AS (SELECT hi.*, contains(translation, term) AS ok, contains(translation, 'Öffnen') AS bad FROM hi JOIN sr USING (idx, condition_id))"""

ORACLES = {
    "token_counts": f"WITH {_S} SELECT condition_id, {', '.join(f'sum(len({_tokens(k, c)}))::BIGINT AS {c}_{k}' for k in ('qt_placeholder', 'brace_placeholder', 'printf_placeholder', 'html_xml_entity', 'html_xml_tag', 'accelerator', 'escaped_control', 'raw_tag') for c in ('source', 'translation'))}, sum(len(regexp_extract_all(translation, '[A-Za-z]')))::BIGINT AS latin, sum(len(regexp_extract_all(translation, '[一-鿿]')))::BIGINT AS cjk, sum(length(translation) - length(replace(translation, chr(10), '')))::BIGINT AS newlines FROM s GROUP BY 1",
    "issue_rows": f"WITH {_I} SELECT idx, condition_id, issue_type, severity, n_tokens::BIGINT AS n_tokens FROM i",
    "issue_type_counts": f"""WITH {_I}, c AS (SELECT condition_id, count(*) AS checked FROM s GROUP BY 1) SELECT i.condition_id, {_GROUP} AS issue_group, issue_type, count(*) AS issues, count(DISTINCT idx) AS segments, count(DISTINCT idx)::DOUBLE / any_value(checked) AS segment_rate, '{{"' || min(severity) || '":' || count(*) || '}}' AS severities FROM i JOIN c USING (condition_id) GROUP BY ALL""",
    "structure_scores": f"WITH {_I}, {_scores_sql()} SELECT * FROM sc",
    "structure_average": f"WITH {_I}, {_scores_sql()} SELECT condition_id, sum(score) AS score_sum, avg(score) AS score_avg, count(*) AS items FROM sc GROUP BY 1",
    "first_window_scores": f"WITH {_I}, {_scores_sql('100')} SELECT * FROM sc",
    "deterministic_summary": f"WITH {_I}, {_SUMMARY} SELECT * FROM su",
    "failed_segments": f"WITH {_I}, {_FAILED} SELECT * FROM fa",
    "failed_summary": f"WITH {_I}, {_FAILED}, x AS (SELECT condition_id, unnest(string_split(issue_types, '; ')) AS issue_type FROM fa) SELECT condition_id, issue_type, count(*) AS n FROM x GROUP BY 1, 2",
    "condition_comparison": f"""WITH {_I}, {_scores_sql()}, {_SUMMARY}, fx AS (SELECT condition_id, count(DISTINCT idx) AS failed FROM i WHERE {_GROUP} IN {checks.GROUPS} GROUP BY 1),
 fl AS (SELECT condition_id, avg(score) AS score_avg, max(checked) AS checked FROM sc GROUP BY 1), fd AS (SELECT fl.*, deterministic_score, coalesce(failed, 0) AS failed, coalesce(failed, 0)::DOUBLE / checked AS failed_rate FROM fl JOIN su USING (condition_id) LEFT JOIN fx USING (condition_id))
 SELECT r.condition_id AS ref_condition_id, x.condition_id, x.failed, x.failed_rate, 100 * {_wilson_sql('x.failed', 'x.checked', '-')} AS failed_low_pct, 100 * {_wilson_sql('x.failed', 'x.checked', '+')} AS failed_high_pct, r.score_avg - x.score_avg AS delta_score, r.deterministic_score - x.deterministic_score AS delta_deterministic, x.failed_rate - r.failed_rate AS reduction, CASE WHEN x.failed_rate > 0 THEN (x.failed_rate - r.failed_rate) / x.failed_rate WHEN r.failed_rate = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relative_reduction FROM fd x, fd r WHERE r.condition_id = 'en' AND x.condition_id <> 'en'""",
    "structure_pivot": f"WITH {_I}, {_scores_sql()} SELECT condition_id, {', '.join(f'''max(score) FILTER (item = '{g}') AS {g}''' for g in checks.GROUPS)} FROM sc GROUP BY 1",
    "best_and_worst": f"WITH {_I}, {_scores_sql()}, k AS (SELECT condition_id, item, affected, score, (row_number() OVER (ORDER BY affected, condition_id, item))::INT AS best, (row_number() OVER (ORDER BY affected DESC, condition_id, item))::INT AS worst FROM sc) SELECT 'best' AS kind, best AS place, condition_id, item, affected, score FROM k WHERE best <= 10 UNION ALL SELECT 'worst', worst, condition_id, item, affected, score FROM k WHERE worst <= 10",
    "labelled_union": f"WITH {_I}, {_issue_sql('judge', 'jj')}, {_SUMMARY} SELECT 'all' AS experiment, condition_id, messages, issues, NULL::BIGINT AS critical FROM su UNION ALL SELECT 'judge', condition_id, NULL, NULL, count(*) FILTER (severity = 'critical') FROM jj GROUP BY condition_id",
    "profile_severities": f"WITH {_S}, {', '.join(_issue_sql(p, p) for p in checks.PROFILES)} " + " UNION ALL ".join(f"SELECT severity, count(*) AS n, '{p}' AS profile FROM {p} GROUP BY 1" for p in checks.PROFILES),
    "stable_ids": f"WITH {_S} SELECT idx, 'seg_' || printf('%06d', idx) || '_' || left(sha1(context || '␟' || source || '␟' || idx), 12) AS segment_id FROM s",
    "issue_first": f"WITH {_I} SELECT idx, min(CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END)::INT AS rank FROM i GROUP BY 1 ORDER BY 2, 1 LIMIT 50",
    "request_rows": f"WITH {_S}, {_REQ} SELECT condition_id, idx, sample_position, request_key FROM rk",
    "pending_requests": f"WITH {_S}, {_REQ} SELECT condition_id, idx, sample_position, request_key FROM rk WHERE idx % 4 <> 0",
    "event_severity": f"WITH e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'info' END AS severity FROM events), g AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS affected, sum({_POINTS}) AS points, (SELECT count(DISTINCT user_id) FROM events) AS checked FROM e GROUP BY 1) SELECT event_type, n, affected, points, affected::DOUBLE / checked AS rate, {_wilson_sql('affected', 'checked', '-')} AS low, {_wilson_sql('affected', 'checked', '+')} AS high FROM g",
    "page_tokens": f"SELECT page_id, {', '.join(f'len({_tokens(k, chr(104) + chr(116) + chr(109) + chr(108))})::BIGINT AS {k}' for k in ('html_xml_tag', 'raw_tag', 'html_xml_entity', 'brace_placeholder', 'accelerator'))} FROM pages",
    "glossary_hits": f"WITH {_GLOSS}, k AS (SELECT idx, condition_id, entry_pos, size, (row_number() OVER (PARTITION BY condition_id, idx ORDER BY size DESC, entry_pos))::INT AS rank FROM hi) SELECT * FROM k WHERE rank <= 12",
    "glossary_issues": f"WITH {_GLOSS}, x AS (SELECT condition_id, 'forbidden_term' AS issue_type, CASE priority WHEN 'high' THEN 'major' ELSE 'minor' END AS severity FROM ht WHERE bad UNION ALL SELECT condition_id, 'glossary_target_missing', CASE priority WHEN 'high' THEN 'major' WHEN 'medium' THEN 'minor' ELSE 'info' END FROM ht WHERE NOT ok) SELECT condition_id, issue_type, severity, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "term_accuracy": f"WITH {_GLOSS} SELECT condition_id, count(*) AS hits, count(*) FILTER (ok) AS good, count(*) FILTER (ok)::DOUBLE / count(*) AS accuracy FROM ht GROUP BY 1",
    "singular_tokens": f"WITH w AS (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')), '[a-z0-9]+')) AS token FROM benchmark) SELECT token, {_SINGULAR.format('token')} AS singular, count(*) AS n FROM w GROUP BY 1, 2",
    "candidate_quality": f"WITH {_CAND} SELECT conv_id, candidate_no, blocking, quality FROM q",
    "best_candidates": f"WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY quality, candidate_no) AS rn, count(*) OVER (PARTITION BY conv_id) AS candidates FROM q) SELECT conv_id, candidates, candidate_no, quality, translation FROM k WHERE rn = 1",
    "masked_choice": f"WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY blocking, quality, candidate_no) AS rn FROM q) SELECT conv_id, CASE WHEN NOT blocking THEN candidate_no END AS candidate_no, blocking AS fallback, CASE WHEN blocking THEN source ELSE translation END AS translation FROM k WHERE rn = 1",
    "log_statistics": f"WITH {_CAND}, l AS (SELECT conv_id, conv_id % 5 AS grp, count(*) AS n, count(*) FILTER (NOT blocking) AS ok FROM q GROUP BY 1) SELECT grp, count(*) AS rows, count(*) FILTER (conv_id % 7 = 0) AS fallbacks, sum(n)::BIGINT AS candidates, sum(ok)::BIGINT AS valid, avg(n) AS avg_candidates, avg(ok) AS avg_valid, count(*) FILTER (ok = 0) AS rows_without_valid FROM l GROUP BY 1",
    "judge_points": f"WITH {_JUDGE} SELECT doc_id, valid, points, score, warnings FROM j",
    "judge_runs": f"WITH {_JUDGE} SELECT * FROM r",
    "judge_errors": f"WITH {_JUDGE} SELECT condition_id, 'Accuracy' AS category, severity, sum(n)::BIGINT AS n FROM j WHERE valid AND n > 0 GROUP BY 1, 3 UNION ALL SELECT condition_id, 'Style', 'Neutral', count(*) FROM j WHERE kind = 6 GROUP BY 1",
    "judge_repeats": f"WITH {_JUDGE}, m AS (SELECT condition_id, count(weighted_score) AS runs, avg(weighted_score) AS mean, coalesce(stddev_samp(weighted_score), 0) AS sd FROM r GROUP BY 1) SELECT *, greatest(0, mean - 1.96 * sd / sqrt(runs)) AS low, least(100, mean + 1.96 * sd / sqrt(runs)) AS high FROM m",
    "judge_status": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'scored' WHEN 2 THEN 'scored' WHEN 3 THEN 'batch_submitted_pending' WHEN 4 THEN 'batch_collected_no_scores' WHEN 5 THEN 'grok_failed_or_partial' ELSE 'grok_not_run' END AS status FROM documents",
    "plural_issues": f"WITH {_S}, p AS (SELECT *, 1 AS form, translation AS text_of_form FROM s UNION ALL SELECT *, 2, replace(translation, '%1', '') FROM s), {_issue_sql('evaluator', 'i', 'p', 'form')} SELECT idx, condition_id, form_index, issue_type, severity, n_tokens::BIGINT AS n_tokens FROM i",
    "type_pivot": f"WITH {_I}, c AS (SELECT DISTINCT condition_id FROM i) SELECT c.condition_id, " + ", ".join(f"count(*) FILTER (issue_type = '{t}') AS {t}" for t in (*checks.COMPLETION, *checks.CONTENT[:3], "missing_number", "extra_number")) + " FROM c JOIN i USING (condition_id) GROUP BY 1",
    "completion_scores": f"WITH {_I}, c AS (SELECT condition_id, count(*) AS checked FROM s GROUP BY 1), h AS (SELECT condition_id, count(DISTINCT idx) AS affected, count(*) AS issues FROM i WHERE issue_type IN {checks.COMPLETION} GROUP BY 1), z AS (SELECT condition_id, checked, coalesce(affected, 0) AS affected, coalesce(issues, 0) AS issues FROM c LEFT JOIN h USING (condition_id)) SELECT condition_id, 'completion_state' AS item, checked, affected, issues, 100.0::DOUBLE * (1 - affected::DOUBLE / checked) AS score, 100 * {_wilson_sql('affected', 'checked', '-')} AS low_pct, 100 * {_wilson_sql('affected', 'checked', '+')} AS high_pct FROM z",
    "attached_summary": f"WITH {_S}, {_issue_sql('evaluator', 'i0')}, i AS (SELECT idx, condition_id, issue_type, severity FROM i0 UNION ALL SELECT DISTINCT 0, condition_id, 'ts_language_mismatch', 'major' FROM s), {_SUMMARY} SELECT * FROM su",
    "file_means": f"WITH {_I}, {_SUMMARY} SELECT count(*) AS files, count(*) FILTER (condition_id = 'de') AS failed, round(avg(deterministic_score), 3) AS deterministic_score, round(avg(segment_score), 3) AS segment_score FROM su",
    "report_rows": f"WITH {_I}, {_scores_sql()}, k AS (SELECT 'C' || ascii(condition_id) || condition_id AS condition_id, item, affected, ascii(condition_id) AS number FROM sc) SELECT condition_id, item, affected FROM k ORDER BY number, condition_id, list_position({list(checks.GROUPS)}, item) LIMIT 20",
    "described_conditions": f"WITH {_S}, m AS (SELECT condition_id, count(*) AS messages FROM s GROUP BY 1) SELECT 'C' || CASE condition_id WHEN 'en' THEN '1' WHEN 'fr' THEN '2' ELSE '7' END || '_' || condition_id AS slug, messages, CASE condition_id WHEN 'en' THEN 'C1' WHEN 'fr' THEN 'C2' ELSE 'C7' END AS condition_id, CASE condition_id WHEN 'en' THEN 'second' WHEN 'fr' THEN 'third' ELSE '' END AS description, CASE condition_id WHEN 'en' THEN 'failed' ELSE '' END AS workflow_status FROM m",
    "judge_table": f"WITH {_JUDGE} SELECT condition_id, 'run' AS row_type, run::VARCHAR AS run_id, valid_n, failed_n, weighted_score, mean_score FROM r UNION ALL SELECT condition_id, 'average', NULL, sum(valid_n)::BIGINT, sum(failed_n)::BIGINT, avg(weighted_score), avg(mean_score) FROM r WHERE valid_n > 0 GROUP BY 1",
    "judge_requests": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'run_0' || (doc_id % 3 + 1) ELSE 'run_09' END AS run_id, CASE WHEN doc_id % 5 = 0 THEN 'seg_' ELSE 's' END || doc_id AS segment_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE greatest(coalesce(n_chars, 1), 1) END AS source_chars FROM documents",
    "log_status": "WITH x AS (SELECT lang AS condition_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'source_fallback' WHEN 2 THEN 'copied' END AS status FROM documents UNION ALL SELECT lang, 'segments_with_issues' FROM documents WHERE doc_id % 3 = 0) SELECT condition_id, status, count(*) AS n FROM x WHERE status IS NOT NULL GROUP BY 1, 2",
    "translatable": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, t AS a, regexp_replace(t, '[a-zA-Z]', '', 'g') AS b, upper(substr(t, 1, 2)) AS c FROM d) SELECT doc_id, " + ", ".join(f"regexp_matches({c}, '[A-Za-z]') AND (regexp_matches({c}, '[a-z]') OR (NOT regexp_full_match({_NORM.format(c)}, '{T.COPY_OK}') AND length({_NORM.format(c)}) > 2)) AS {c}_wanted" for c in "abc") + " FROM x",
    "stripped_replies": "WITH t AS (SELECT conv_id, turn, replace(replace(regexp_replace(coalesce(text, ''), '[\"''「」`\\s]+', ' ', 'g'), '%12', ''), '%1', '') AS y FROM conversations), w AS (SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN chr(39) || y || chr(39) WHEN 3 THEN ltrim(y) || '  ' ELSE trim(y) END AS x FROM t) SELECT conv_id, turn, sha1(x) AS digest, length(x) AS n_chars FROM w",
    "parsed_candidates": "SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN '2=a' || doc_id || ';2=b;3=c' WHEN doc_id % 6 = 2 THEN '1=a' || doc_id ELSE '' END AS found, CASE doc_id % 6 WHEN 2 THEN 'missing_candidate_count' WHEN 3 THEN 'model_json_parse_failed' WHEN 4 THEN 'model_json_unexpected_shape' WHEN 5 THEN 'missing_candidate_count' ELSE '' END AS issues FROM documents",
    "number_tokens": f"WITH {_S} SELECT idx, array_to_string({_tokens('number', 'source')}, ' ') AS numbers FROM s",
    "message_categories": f"""WITH {_S}, d AS (SELECT lang AS condition_id, CASE doc_id % 3 WHEN 0 THEN s.source WHEN 1 THEN coalesce(text, '') ELSE 'Plain ' || CASE WHEN doc_id % 2 = 0 THEN '%n words' ELSE 'words' END END AS x FROM documents JOIN s ON s.idx = doc_id + 1),
 f AS (SELECT condition_id, list_filter([CASE WHEN len({_tokens('accelerator', 'x')}) > 0 THEN 'accelerator' END, CASE WHEN regexp_matches(x, '{T.ENTITY}') OR regexp_matches(x, '{T.RAW_TAG}') THEN 'html_xml' END, CASE WHEN length({_NORM.format('x')}) >= 120 THEN 'long' END,
 CASE WHEN regexp_matches(x, '{T.ESCAPED_CONTROL}') OR regexp_matches(x, '[\n\t\r]') OR len({_tokens('number', 'x')}) > 0 THEN 'number_code_newline' END, CASE WHEN contains(x, '%n') THEN 'numerus' END, CASE WHEN regexp_matches(x, '{T.BRACE}') OR regexp_matches(x, '{T.PRINTF}') THEN 'other_placeholder' END, CASE WHEN regexp_matches(x, '{T.QT}') THEN 'qt_placeholder' END], lambda v: v IS NOT NULL) AS l FROM d),
 e AS (SELECT condition_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['ordinary'] END) AS category FROM f) SELECT condition_id, category, count(*) AS n FROM e GROUP BY 1, 2""",
}
