"""Deterministic checks of translations: one pass that yields the long issue table.

Input rows are segments: idx, condition_id, context, source, translation, translation_type,
optionally ``forms`` (plural forms). Each check is a conditional struct; one array
of them is filtered, and aggregated as it is or exploded, so no check needs a join or a
second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T

PROFILES = {
    # severities of missing and extra tokens, and whether escaped controls are checked
    "evaluator": {"entity": ("critical", "major"), "placeholder": ("critical", "major"), "controls": False},
    "judge": {"entity": ("major", "major"), "placeholder": ("critical", "major"), "controls": False},
    "translator": {"entity": ("major", "major"), "placeholder": ("critical", "critical"), "controls": True},
}
GROUPS = ("qt_placeholder", "brace_placeholder", "printf_placeholder", "html_xml_entity", "html_xml_tag", "number", "newline", "accelerator")
COMPLETION = ("unfinished_translation", "empty_translation", "missing_translation_element")
CONTENT = ("possibly_untranslated", "bilingual_residue", "high_english_residue", "script_variant_risk", "glossary_target_missing", "forbidden_term", "ts_language_mismatch")
LANGUAGES = ("zh_TW", "zh-TW", "zh-Hant", "zh_Hant")


def _issue(when: Column, ordinal: int, kind: str, severity: str) -> Column:
    return F.when(when, F.expr(_struct(ordinal, kind, severity, _NONE, "0")))


_NONE = "cast(array() as array<string>)"


def _struct(ordinal: int, kind: str, severity: str, tokens: str, form: str) -> str:
    return f"named_struct('check_ordinal', {ordinal}, 'issue_type', '{kind}', 'severity', '{severity}', 'tokens', {tokens}, 'form_index', {form})"


def _severities(kind: str, profile: dict) -> tuple[str, str]:
    if kind == "number":
        return "major", "minor"
    if kind == "escaped_control":
        return "major", "major"
    return profile["entity" if kind.startswith("html") else "placeholder"]


def _pairs(kinds: list[str], profile: dict, number: str) -> str:
    """SQL of the checks that compare tokens of a source (struct ``_own``) with those of a translation or one plural form (struct ``f``)."""
    out = []
    for at, kind in enumerate(kinds):
        a, b = f"_own.{kind}", f"f.{kind}"
        lost, more = T.bag_minus_sql(a, b), T.bag_minus_sql(b, a)
        if kind == "accelerator":
            out.append(_struct(31, "accelerator_count_mismatch", "minor", f"concat({lost}, {more})", number))
            continue
        missing, extra = _severities(kind, profile)
        out += [_struct(10 + 2 * at, f"missing_{kind}", missing, lost, number), _struct(11 + 2 * at, f"extra_{kind}", extra, more, number)]
    line = _struct(30, "newline_count_mismatch", "minor", _NONE, number)
    return f"array_sort(filter(array({', '.join(out)}, if(_own.newline <> f.newline, {line}, null)), x -> size(x.tokens) > 0 or x.check_ordinal = 30))"


def checked(segments: DataFrame, profile: str = "evaluator") -> DataFrame:
    """Segments with ``issues``, an array of (check_ordinal, issue_type, severity, tokens, form_index) in check order.

    Tokens of both sides are projected once, from the marks of a text; comparisons then
    read these columns. Two texts are normalized in full only where one's beginning goes
    on as the other's does, as else neither can begin with the other.
    """
    rules = PROFILES[profile]
    kinds = [*GROUPS[:6], *(["escaped_control"] if rules["controls"] else []), "accelerator"]
    src, out = F.coalesce("source", F.lit("")), F.coalesce("translation", F.lit(""))
    s, t = T.head(src), T.head(out)
    near = s.startswith(t) | t.startswith(s)
    plural = "forms" in segments.columns
    forms = F.when(F.size("forms") > 1, F.col("forms")).otherwise(F.array(out)) if plural else F.array(out)
    tokens = lambda text: F.transform(F.array(T.marks(text)), lambda m: F.struct(*(T.EXTRACTORS[k](text if k == "number" else m).alias(k) for k in kinds), T.newline_count(text).alias("newline")))[0]
    base = segments.withColumns({"_own": tokens(src), "_forms": F.transform(forms, tokens), "_s": F.when(near, T.normalized(src)), "_t": F.when(near, T.normalized(out)), "_cjk": T.cjk_count(out)})
    same = (F.col("_s") == F.col("_t")) & (F.col("_s") != "") & ~F.col("_s").rlike(rf"\A{T.COPY_OK}\z")
    residue = [F.col("_t").startswith(F.concat(F.col("_s"), F.lit(f" {dash}"))) for dash in "-–—"]
    found = [
        _issue((t == "") & ~out.rlike(r"(?U)\S"), 1, "empty_translation", "critical"),
        _issue(F.col("translation_type") == "unfinished", 2, "unfinished_translation", "major"),
        _issue(F.col("translation_type") == "missing_translation_element", 3, "missing_translation_element", "critical"),
        _issue(same, 4, "possibly_untranslated", "major"),
        _issue((F.col("_s") != "") & (residue[0] | residue[1] | residue[2]), 5, "bilingual_residue", "major"),
        _issue((F.col("_cjk") > 0) & (T.latin_count(out) > F.greatest(F.lit(12.0), F.col("_cjk") * 1.2)) & ~src.rlike("SQL|HTML|API|CRS"), 6, "high_english_residue", "minor"),
    ]
    per_form = F.expr(f"flatten(transform(_forms, (f, i) -> {_pairs(kinds, rules, 'i + 1' if plural else '0')}))")
    issues = F.concat(F.array_compact(F.array(*found)), per_form)
    return base.select(*segments.columns, issues.alias("issues"))


def checks(segments: DataFrame, profile: str = "evaluator") -> DataFrame:
    """The long issue table: idx, condition_id, context, check_ordinal, form_index, issue_type, severity, tokens."""
    keep = [c for c in ("ts_file", "segment_id", "idx", "condition_id", "context") if c in segments.columns]
    # Not ``inline``: it would have the arrays computed a second time, for a filter on their size.
    return checked(segments, profile).select(*keep, F.inline_outer("issues")).where("issue_type is not null")


def language_issues(files: DataFrame, target: str = "zh_TW") -> DataFrame:
    """A synthetic row (index 0) for files whose language is another."""
    wrong = ~F.coalesce("language", F.lit("")).isin(target, *LANGUAGES)
    return files.where(wrong).select("ts_file", F.lit("file_metadata").alias("segment_id"), F.lit(0).alias("idx"), F.lit("ts_language_mismatch").alias("issue_type"), F.lit("major").alias("severity"))


def issue_group(issue_type: Column) -> Column:
    """The structure group of an issue type, or the kind of issue that it is."""
    base = F.regexp_replace(issue_type, "^(?:missing|extra)_", "")
    paired = issue_type.rlike("^(?:missing|extra)_") & base.isin(*GROUPS[:6])
    return (
        F.when(paired, base)
        .when(issue_type == "newline_count_mismatch", "newline")
        .when(issue_type == "accelerator_count_mismatch", "accelerator")
        .when(issue_type.isin(*COMPLETION), "completion_state")
        .when(issue_type.isin(*CONTENT), "content_or_terminology")
        .when(issue_type.rlike("^(?:missing|extra)_|_mismatch$"), "other_structure")
        .otherwise("other")
    )


def categories(source: Column, numerus: Column | None = None, has_term: Column | None = None) -> Column:
    """The sorted categories of a message; ``ordinary`` only if no other fits."""
    any_of = lambda *patterns: source.rlike("|".join(f"(?:{p})" for p in patterns))
    plural = source.contains("%n") if numerus is None else numerus | source.contains("%n")
    tests = {
        "accelerator": F.size(T.accelerator_tokens(source)) > 0,
        "glossary": F.lit(False) if has_term is None else has_term,
        "html_xml": any_of(T.ENTITY, T.RAW_TAG),
        "long": F.length(T.normalized(source)) >= 120,
        "number_code_newline": any_of(T.ESCAPED_CONTROL, "[\n\t\r]") | (F.size(T.number_tokens(source)) > 0),
        "numerus": plural,
        "other_placeholder": any_of(T.BRACE, T.PRINTF),
        "qt_placeholder": any_of(T.QT),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ordinary")))
