"""Requests to language models as text, and the JSON schemas of their replies."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glossary entries and issues that a request shows, by purpose.
SHOWN = {"evaluate": (30, 20), "translate": (8, 0), "judge": (12, 25)}


def strict(schema: dict) -> dict:
    """The schema with all properties required and no others allowed, at every depth."""
    out = {k: strict(v) if isinstance(v, dict) else [strict(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if schema.get("type") == "object" and isinstance(schema.get("properties"), dict):
        out |= {"additionalProperties": False, "required": list(schema["properties"])}
    return out


def candidate_schema(wanted: int) -> dict:
    """Replies with ``wanted`` whole translations."""
    one = {"type": "object", "properties": {"candidate_no": {"type": "integer"}, "translation": {"type": "string"}}}
    return strict({"type": "object", "properties": {"candidates": {"type": "array", "minItems": wanted, "maxItems": wanted, "items": one}}})


def part_schema(requests: Column, wanted: int) -> Column:
    """Per row, the JSON schema of replies with ``wanted`` translations of the parts (id, ...) that the row asks for."""
    ids = F.transform(requests, lambda r: r["id"])
    quoted = F.array_join(F.transform(ids, lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ",")
    each = F.array_join(F.transform(ids, lambda i: F.concat(F.lit('"'), i, F.lit('":{"type":"string"}'))), ",")
    mark = ["\x01", "\x02"]
    whole = strict({"type": "object", "properties": {"candidates": {"type": "array", "minItems": wanted, "maxItems": wanted, "items": {"type": "object", "properties": {"candidate_no": {"type": "integer"}, "translations": mark[0]}}}}})
    before, after = json.dumps(whole).split(json.dumps(mark[0]))
    return F.concat(F.lit(before), F.lit('{"type":"object","properties":{'), each, F.lit('},"required":['), quoted, F.lit('],"additionalProperties":false}'), F.lit(after))


def _listed(title: str, items: Column, most: int, line) -> Column:
    lines = F.array_join(F.transform(F.slice(items, 1, most), line), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}:\n"), lines)).otherwise("")


def prompt(task: str, purpose: str, source: Column, translation: Column | None = None, terms: Column | None = None, issues: Column | None = None) -> Column:
    """The text of a request: the task, the message, and as many of its terms (source_term, target_terms, forbidden_terms) and issues (issue_type, severity) as its purpose shows."""
    most_terms, most_issues = SHOWN[purpose]
    out = [F.lit(f"{task}\n\nSource:\n"), F.coalesce(source, F.lit(""))]
    if translation is not None:
        out += [F.lit("\n\nTranslation:\n"), F.coalesce(translation, F.lit(""))]
    if terms is not None:
        avoid = lambda t: F.when(F.size(t["forbidden_terms"]) > 0, F.concat(F.lit("; avoid "), F.array_join(t["forbidden_terms"], " | "))).otherwise("")
        out.append(_listed("\nTerms", terms, most_terms, lambda t: F.concat(F.lit("- "), t["source_term"], F.lit(" => "), F.array_join(t["target_terms"], " | "), avoid(t))))
    if issues is not None and most_issues:
        out.append(_listed("\nFound by rules", issues, most_issues, lambda i: F.concat(F.lit("- "), i["issue_type"], F.lit(" ("), i["severity"], F.lit(")"))))
    return F.concat(*out)
