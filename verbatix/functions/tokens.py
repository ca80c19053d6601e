"""Format tokens of software messages, as column expressions.

Every function maps a string column to an array of tokens in text order (or a count).
A null text has no tokens. ``(?U)`` makes Java's classes Unicode-aware, and the astral
letter in the look-around classes makes them step by code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns.
QT = r"%(?:L)?\d+|%n"
BRACE = r"\{[^{}\n]*\}"
PRINTF = r"%(?:[+#0\-]*)?(?:\d+|\*)?(?:\.\d+)?[hlL]?[diouxXeEfFgGcs]"
ENTITY = r"&(?:amp|lt|gt|quot|apos|nbsp|hellip|[A-Za-z][A-Za-z0-9]+|#[0-9]+|#x[0-9A-Fa-f]+);"
TAG = r"</?\s*([A-Za-z][\w:.-]*)(?:\s+[^<>]*)?/?>"
RAW_TAG = r"</?[^<>]+>"
ESCAPED_CONTROL = r"\\[nrt]"
COPY_OK = r"(?:[A-Z0-9_+\-./:%#(){}\[\]<>*|\\ ]+|[A-Za-z0-9_+\-./:%#(){}\[\]<>*|\\ ]{1,12})"
CHECKED_ENTITIES = ("&lt;", "&gt;", "&amp;", "&quot;", "&apos;", "&nbsp;")
HTML_TAGS = (
    "html", "head", "body", "p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "a", "span", "div", "b", "i", "u", "strong", "em",
    "code", "pre", "ul", "ol", "li", "table", "thead", "tbody", "tr", "td", "th", "font", "style", "img", "blockquote",
)

_ASTRAL = "\U00020bb7"
# (?<![%\w])[-+]?\d+(?:[.,]\d+)?(?![%\w]) with its first character in front, so that most places fail at once.
NUMBER = rf"(?Us)[-+\d](?<![%\w{_ASTRAL}].)(?:(?<=[-+])\d+|(?<=\d)\d*)(?:[.,]\d+)?(?![%\w{_ASTRAL}])"

# A sign of a token with all that a token from there can hold, or a run of other text with its first character.
_MARKS = r"(?U)(%[-+#*.hlL\d]*+[A-Za-z]?|&(?:[#A-Za-z0-9]++;?|[^\s%&<{\\])?|<[^<>{]*+>?|\{[^{}\n<]*+\}?|\\[nrt]?)|([^%{&<\\])[^%{&<\\]*+"
_NESTED = r"<[^<>{]*\{|\{[^{}\n<]*<"


def _all(text: Column, pattern: str, group: int = 0, sign: str | None = None) -> Column:
    """All matches; texts without the ``sign`` that every match holds don't go through the pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.coalesce(found if sign is None else F.when(text.contains(sign), found), F.array().cast("array<string>"))


def marks(text: Column) -> Column:
    """A text in which every token but a number is as before, while of all other text a character a run is left.

    The extractors find the same in it, and pass over whole texts once instead of once for
    each kind. No token looks back, and the character behind a sign stays. Where a brace
    opens within a tag, or a tag within braces, the text stays as it is.
    """
    short = F.regexp_replace(text, _MARKS, "$1$2")
    return F.transform(F.array(short), lambda t: F.when(t.rlike(_NESTED), text).otherwise(t))[0]


def qt_tokens(text: Column) -> Column:
    """Numbered and plural placeholders."""
    return _all(text, f"(?U){QT}", sign="%")


def brace_tokens(text: Column) -> Column:
    """Brace placeholders on one line."""
    return _all(text, BRACE, sign="{")


def printf_tokens(text: Column) -> Column:
    """Printf conversions that are not numbered placeholders."""
    return F.filter(_all(text, f"(?U){PRINTF}", sign="%"), lambda t: ~t.rlike(rf"(?U)\A(?:{QT})\z"))


def entity_tokens(text: Column) -> Column:
    """Those entities that a translation must keep."""
    return F.filter(_all(text, ENTITY, sign="&"), lambda t: t.isin(*CHECKED_ENTITIES))


def tag_names(text: Column) -> Column:
    """Lower-cased names of known tags; opening and closing ones both count."""
    return F.filter(F.transform(_all(text, f"(?U){TAG}", 1, sign="<"), F.lower), lambda t: t.isin(*HTML_TAGS))


def raw_tags(text: Column) -> Column:
    return _all(text, RAW_TAG, sign="<")


def number_tokens(text: Column) -> Column:
    """Numbers that touch neither a percent sign nor a word character."""
    return _all(text, NUMBER)


def accelerator_tokens(text: Column) -> Column:
    """Keyboard mnemonics: an ampersand with its letter, not a doubled one or an entity."""
    found = _all(text, rf"(?U)&&|{ENTITY}|&\S|&", sign="&")
    return F.filter(found, lambda t: (t != "&&") & ~t.rlike(rf"\A{ENTITY}\z"))


def escaped_controls(text: Column) -> Column:
    return _all(text, ESCAPED_CONTROL, sign="\\")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class a text has; runs of them are taken out, as matches cost more than characters."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", "")), F.lit(0))


def latin_count(text: Column) -> Column:
    return count_of(text, "[A-Za-z]")


def cjk_count(text: Column) -> Column:
    return count_of(text, "[一-鿿]")


def newline_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))


def normalized(text: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s(?:(?<! )\s*|\s+)", " "))  # single spaces are passed over


#: Characters that ``head`` reads.
HEAD = 200


def head(text: Column) -> Column:
    """A beginning of the normalized text, for tests that whole texts follow."""
    return normalized(F.substring(text, 1, HEAD))


def _numbered(bag: str) -> str:
    """SQL of each token with its number among equal ones, in sorted order; one sort and passes over it.

    ``transform(array(x), v -> ...)[0]`` binds a value that is computed once.
    """
    starts = "filter(if(size(s) > 0, sequence(0, size(s) - 1), cast(array() as array<int>)), i -> i = 0 or s[i] <> s[i - 1])"
    numbers = "flatten(transform(at, (i, k) -> sequence(1, coalesce(get(at, k + 1), size(s)) - i)))"
    return f"transform(array(array_sort({bag})), s -> transform(array({starts}), at -> zip_with(s, {numbers}, (x, k) -> concat(x, '\\u0001', k)))[0])[0]"


def bag_minus_sql(a: str, b: str) -> str:
    """SQL of ``bag_minus``; ``a`` and ``b`` name columns, fields or lambda variables."""
    number = "substring_index(x, '\\u0001', -1)"
    token = f"left(x, length(x) - length({number}) - 1)"
    listed = f"transform(lost, x -> named_struct('at', array_position({a}, {token}), 'k', int({number}), 'token', {token}))"
    rest = f"transform(array(array_except({_numbered(a)}, {_numbered(b)})), lost -> transform(array_sort({listed}), x -> x.token))[0]"
    return f"if({a} = {b} or size({a}) = 0, cast(array() as array<string>), {rest})"


def stable_id(context: Column, source: Column, index: Column) -> Column:
    """An id from place and content of a message."""
    digest = F.sha1(F.concat_ws("␟", F.coalesce(context, F.lit("")), F.coalesce(source, F.lit("")), index.cast("string")).cast("binary"))
    return F.concat(F.lit("seg_"), F.format_string("%06d", index), F.lit("_"), F.substring(digest, 1, 12))


#: By name, for callers that choose extractors.
EXTRACTORS = {
    "qt_placeholder": qt_tokens,
    "brace_placeholder": brace_tokens,
    "printf_placeholder": printf_tokens,
    "html_xml_entity": entity_tokens,
    "html_xml_tag": tag_names,
    "number": number_tokens,
    "accelerator": accelerator_tokens,
    "escaped_control": escaped_controls,
    "raw_tag": raw_tags,
}
