"""Terms: splitting, tokenizing and reducing to a canonical key."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TERM = r"[A-Za-z0-9]+(?:[+#._-]+[A-Za-z0-9]+)*[+#]*"
SEPARATORS = r"\s*[|;；]\s*"


def split_terms(text: Column) -> Column:
    """Alternatives in a glossary cell; an empty cell or ``nan`` has none, a cell of separators alone is one."""
    none = F.array().cast("array<string>")
    cell = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    parts = F.filter(F.transform(F.split(cell, SEPARATORS), lambda t: F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")), lambda t: t != "")
    return F.when((cell == "") | (F.lower(cell) == "nan"), none).when(F.size(parts) > 0, parts).otherwise(F.array(cell))


@F.pandas_udf(StringType())
def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: None if x is None else html.unescape(x).casefold())


def folded(text: Column) -> Column:
    """Entities resolved and case folded; texts of plain ASCII without an ampersand stay in the JVM."""
    plain = text.rlike(r"\A[\x00-\x25\x27-\x7f]*\z")
    return F.when(plain, F.lower(text)).otherwise(_folded(F.when(~plain, text)))


@F.pandas_udf(StringType())
def _cased(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: None if x is None else x.casefold())


def folded_case(text: Column) -> Column:
    """Case folded; plain ASCII stays in the JVM."""
    plain = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, F.lower(text)).otherwise(_cased(F.when(~plain, text)))


def term_tokens(text: Column, fold: bool = True, colon: bool = False) -> Column:
    """Words of a term or text, folded; ``colon`` lets a colon join them, as the judge's and the translator's profile do."""
    # A match starts with a letter or digit and ends with one or with a plus or hash sign, so nothing is left to trim.
    return F.regexp_extract_all(folded(text) if fold else F.lower(text), F.lit(TERM.replace("+#._-]+[", "+#.:_-]+[") if colon else TERM), F.lit(0))


def singular(token: Column) -> Column:
    """A light English singular of a lower-case token; ss, us and is stay."""
    n = F.length(token)

    def ends(*suffixes: str) -> Column:
        out = token.endswith(suffixes[0])
        for suffix in suffixes[1:]:
            out = out | token.endswith(suffix)
        return out

    return (
        F.when((n > 5) & ends("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & ends("ches", "shes", "xes", "zes"), F.substring(token, F.lit(1), n - 2))
        .when((n > 3) & ends("s") & ~ends("ss", "us", "is"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def reducible(token: str) -> set[str]:
    """All tokens that ``singular`` may make this one of, and itself."""
    return {token, f"{token}s", f"{token}es", *([f"{token[:-1]}ies"] if token.endswith("y") else [])}


def canonical_text(text: Column) -> Column:
    """The singulars of tokens that spaces part. All go through three patterns at once; a text of thousands of tokens then needs no call for each."""
    # Endings come first and look back from there, so that other letters fail at once.
    text = F.regexp_replace(text, r"ies(?= |\z)(?<=[^ ]{3}ies)", "y")
    text = F.regexp_replace(text, r"es(?= |\z)(?<=[^ ](?:[cs]h|[^ ][xz])es)", "")
    return F.regexp_replace(text, r"s(?= |\z)(?<=[^ ]{2}[^ sui]s)", "")


def canonical(tokens: Column) -> Column:
    """The singulars of tokens, none of which holds a space."""
    return F.when(F.size(tokens) > 0, F.split(canonical_text(F.array_join(tokens, " ")), " ")).otherwise(tokens)
