"""PII: detected entities get keyed, type-consistent surrogates.

Patterns find e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards,
IBANs, US social security numbers and names after a title. Surrogates are made by a
keyed format-preserving permutation: a Feistel network over the characters, each within
its own class (digits, and letters by script and case), so equal originals get equal
surrogates everywhere (coreference), length, punctuation, case and script stay, and
different originals of a format get different surrogates. Letters outside the listed
alphabets move among the letters of their script and case in the Unicode data. Cards
keep their issuer digit and a right check digit, IBANs their country and right check
digits, IP addresses stay addresses, mail addresses their domain's form; a phone number
goes by its digits alone, so its layouts agree. Names keep the title's gender and the
script: Latin given names come from lists by gender, family names are permuted, by the
same key with and without a given name; other scripts are permuted letter by letter.

A collision check covers all distinct entities: a surrogate that another entity has,
or that stands in the corpus as an original (its own included), sends its entity to the
next round with a new tweak. Formats of which the corpus holds nearly all values (two
free letters, say) leave none to move to: what still collides after ``ROUNDS`` rounds is
replaced all the same and marked ``settled`` = false in the output. Only the exceptions
go to the tasks; their number is checked, and if it is over ``EXCEPTIONS`` they are
joined instead.

Edge cases: a null text stays null and has no entities; an empty text stays empty;
overlapping finds keep the leftmost, then the first kind listed; repeated rows are replaced alike;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY = b"surrogate-key-1"
EXCEPTIONS = 100_000
#: Rounds of the collision check, and those in which given names come from the lists.
ROUNDS, LISTED = 12, 8

_UP, _WORD = r"[^\W\d_a-zß-öø-ÿ]", r"[^\W\d_]*(?:[-'’][^\W\d_]+)*"
FEMALE_TITLES, MALE_TITLES, ANY_TITLES = "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Signora", "Mr|Herr|Monsieur|Señor|Sr|Signor", "Dr|Prof"
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ipv6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("name", rf"\b(?:{FEMALE_TITLES}|{MALE_TITLES}|{ANY_TITLES})\.? +{_UP}{_WORD}(?: +{_UP}{_WORD})?"),
)
FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
MAYBE = re.compile(rf"@|\d{{2}}|\d\.\d|[0-9A-Fa-f]:[0-9A-Fa-f]|\b(?:{FEMALE_TITLES}|{MALE_TITLES}|{ANY_TITLES})\b")
#: Given names by gender.
FEMALE = "Anna Maria Clara Emma Julia Laura Sofia Elena Marta Nina Paula Rosa Sara Vera Alice Irene Louise Helen Greta Ida".split()
MALE = "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Lukas Martin Oskar Paul Robert Simon Thomas Viktor Walter".split()
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "äöüßéèêëçñáíóúàâîôûœæø", "ÄÖÜÉÈÊËÇÑÁÍÓÚÀÂÎÔÛŒÆØ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_CLASS = {c: (k, i) for k, a in enumerate(_ALPHABETS) for i, c in enumerate(a)}
#: Scripts whose letters are named by number, as ranges of code points.
_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF))


@cache
def _scripts() -> dict[tuple[str, str, int], list[str]]:
    """Letters and digits of the basic plane by the first word of their name, category and 1,024 code points, less those of ``_ALPHABETS`` and of ``_RANGES``."""
    out: dict[tuple[str, str, int], list[str]] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nd") and c not in _CLASS and not any(a <= code <= b for a, b in _RANGES):
            out.setdefault((unicodedata.name(c, "?").split()[0], unicodedata.category(c), code >> 10), []).append(c)
    return out


@cache
def _place(c: str) -> tuple[str | range | list[str], int] | None:
    """The alphabet of a character, as characters or code points, and its place there; None for what stays."""
    if c in _CLASS:
        k, i = _CLASS[c]
        return _ALPHABETS[k], i
    code = ord(c)
    for a, b in _RANGES:
        if a <= code <= b:
            return range(a, b + 1), code - a
    letters = _scripts().get((unicodedata.name(c, "?").split()[0], unicodedata.category(c), code >> 10), ()) if code >= 0x80 else ()
    return (letters, letters.index(c)) if len(letters) > 1 and c in letters else None


def _digits(tweak: str, half: list[int], width: int) -> int:
    """A keyed number from one half of the characters."""
    return int.from_bytes(hmac.new(KEY, f"{tweak}|{width}|{half}".encode(), hashlib.sha256).digest(), "big")


def permute(text: str, tweak: str) -> str:
    """A keyed permutation of the texts with the same classes at the same places; other characters stay."""
    found = [(i, *p) for i, c in enumerate(text) if (p := _place(c))]
    at, sizes, x = [f[0] for f in found], [len(f[1]) for f in found], [f[2] for f in found]
    half = len(at) // 2
    if len(at) == 1:  # a single place: a keyed rotation
        x = [(x[0] + _digits(tweak, [], 1)) % sizes[0]]
    for k in range(10 if half else 0):
        here, there = (range(half), range(half, len(at))) if k % 2 else (range(half, len(at)), range(half))
        n = _digits(f"{tweak}|{k}", [x[i] for i in there], len(at))
        for i in here:
            n, d = divmod(n, sizes[i])
            x[i] = (x[i] + d) % sizes[i]
            if n < sizes[i]:
                n = _digits(f"{tweak}|{k}|{i}", [x[j] for j in there], len(at))
    out = list(text)
    for (i, alphabet, _), d in zip(found, x, strict=True):
        out[i] = chr(alphabet[d]) if isinstance(alphabet, range) else alphabet[d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    doubled = (2 * int(c) for c in digits[::-2])
    return -(sum(d // 10 + d % 10 for d in doubled) + sum(map(int, digits[-2::-2]))) % 10


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _layout(like: str, chars: str) -> str:
    """``chars`` put where ``like`` has letters and digits."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in like)


def surrogate(kind: str, value: str, tries: int = 0) -> str:
    """The replacement of an entity; ``tries`` counts collisions so far."""
    tweak = f"{kind}|{tries}"
    if kind == "card":
        plain = re.sub(r"\D", "", value)
        body = plain[0] + permute(plain[1:-1], tweak)
        return _layout(value, body + str((luhn(body) + int(plain[-1]) - luhn(plain[:-1])) % 10))
    if kind == "iban":
        plain = value.replace(" ", "")
        rest = permute(plain[4:], tweak)
        shift = (int(plain[2:4]) - _iban_check(plain[:2], plain[4:])) % 97
        return _layout(value, f"{plain[:2]}{(_iban_check(plain[:2], rest) + shift - 2) % 97 + 2:02d}{rest}")
    if kind == "ip":
        n = 0
        for c in value.split("."):
            n = n * 256 + int(c)
        left, right = n >> 16, n & 0xFFFF
        for k in range(8):
            left, right = right, left ^ (_digits(f"{tweak}|{k}", [right], 2) & 0xFFFF)
        return ".".join(str(b) for b in (left << 16 | right).to_bytes(4, "big"))
    if kind == "email":
        name, host = value.rsplit("@", 1)
        labels = host.split(".")
        return f"{permute(name, tweak)}@{'.'.join([permute('.'.join(labels[:-1]), tweak + name.lower()), labels[-1]])}"
    if kind == "ipv6":
        groups = value.split(":")
        n = int("".join(g.zfill(4) for g in groups), 16)
        left, right = n >> 64, n & (1 << 64) - 1
        for k in range(8):
            left, right = right, left ^ (_digits(f"{tweak}|{k}", [right], 8) & (1 << 64) - 1)
        made = f"{left << 64 | right:032x}"
        made = ":".join(made[i : i + 4] for i in range(0, 32, 4))
        return made.upper() if value != value.lower() else made
    if kind == "phone":
        plain = re.sub(r"\D", "", value)
        kept = 1 if value[0] == "+" else 0
        return _layout(value, plain[:kept] + permute(plain[kept:], f"{tweak}|{plain[:kept]}"))
    if kind == "name":
        title, *names = value.split()
        word = title.rstrip(".")
        pool = FEMALE if word in FEMALE_TITLES.split("|") else MALE if word in MALE_TITLES.split("|") else FEMALE + MALE
        # The family name keeps its surrogate where a given name can part two persons.
        out = [*(permute(x, tweak) for x in names[:-1]), permute(names[-1], "name|0" if len(names) > 1 and tries < LISTED else tweak)]
        if len(names) > 1 and tries < LISTED and all("LATIN" in unicodedata.name(c, "") for c in names[0] if c.isalpha()):
            out[0] = pool[_digits(tweak, [ord(c) for c in names[0]], 1) % len(pool)]
        gaps = re.findall(r" +", value)
        return title + "".join(g + x for g, x in zip(gaps, out, strict=True))
    return permute(value, tweak)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text; IBANs need right check digits."""
    if not MAYBE.search(text):
        return []
    out = []
    for m in FIND.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "iban":
            plain = value.replace(" ", "")
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                continue
        out.append((m.start(), m.end(), kind))
    return out


def _entities(docs: DataFrame) -> DataFrame:
    """(kind, value) of all distinct entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(kind, text[a:b]) for text in batch.column("text").to_pylist() if text for a, b, kind in find(text)}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in (0, 1)], names=["kind", "value"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value string").distinct()


def assign(entities: DataFrame) -> DataFrame:
    """(kind, value, tries, made, settled): how often each entity had to be tried until no surrogate was another's or an original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "tries")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(*r) for r in rows], pa.string())], names=[*batch.schema.names, "made"])

    schema = "kind string, value string, tries int, made string"
    rows = common.materialize(entities.withColumn("tries", F.lit(0)).mapInArrow(run, schema))
    originals = rows.select("kind", F.col("value").alias("made")).withColumn("taken", F.lit(True))
    for k in range(ROUNDS + 1):
        first = rows.groupBy("kind", "made").agg(F.min("value").alias("owner"))
        checked = rows.join(first, ["kind", "made"]).join(originals, ["kind", "made"], "left")
        checked = common.materialize(checked.withColumn("bad", (F.col("value") != F.col("owner")) | F.col("taken").isNotNull()))
        if k == ROUNDS or not checked.where("bad").limit(1).count():
            return checked.select("kind", "value", "tries", "made", (~F.col("bad")).alias("settled"))
        again = checked.where("bad").select("kind", "value", (F.col("tries") + 1).cast("int").alias("tries")).mapInArrow(run, schema)
        rows = common.materialize(checked.where("not bad").select("kind", "value", "tries", "made").unionByName(again))


def replace(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_entities, entities): texts with surrogates; entities are (kind, start, end, surrogate, settled) in the new text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tried = common.materialize(assign(common.materialize(_entities(rows))).where("tries > 0").select("kind", "value", "tries", "settled"))
    few = tried.count() <= EXCEPTIONS
    known = rows.sparkSession.sparkContext.broadcast({(r.kind, r.value): (r.tries, r.settled) for r in tried.collect()} if few else {})  # at most EXCEPTIONS
    entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("settled", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str] = {}
        for batch in batches:
            own = [dict(((e["kind"], e["value"]), (e["tries"], e["settled"])) for e in x or []) for x in batch.column("own").to_pylist()] if "own" in batch.schema.names else None
            texts, lists = [], []
            if len(memo) > 100_000:
                memo.clear()
            for r, text in enumerate(batch.column("text").to_pylist()):
                found = find(text) if text else []
                parts, at, length, made = [], 0, 0, []
                for a, b, kind in found:
                    value = text[a:b]
                    tries, settled = (own[r] if own else known.value).get((kind, value), (0, True))
                    new = memo.get((kind, value, tries)) or memo.setdefault((kind, value, tries), surrogate(kind, value, tries))
                    length += a - at
                    parts += [text[at:a], new]
                    made.append({"kind": kind, "start": length, "end": length + len(new), "surrogate": new, "settled": settled})
                    length, at = length + len(new), b
                texts.append("".join([*parts, text[at:]]) if found else text)
                lists.append(made)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, entity)], names=["doc_id", "text", "n_entities", "entities"])

    if not few:  # each text meets its own exceptions
        def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(h, k, t[a:b]) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for a, b, k in find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.string()) for k in (1, 2))], names=["h", "kind", "value"])

        hashed = rows.withColumn("h", F.when(F.length("text") > 0, F.xxhash64("text")))  # adaptive execution splits a hot text's rows
        own = hashed.where("h is not null").select("h", "text").mapInArrow(spots, "h long, kind string, value string").distinct().join(tried, ["kind", "value"])
        rows = hashed.join(own.groupBy("h").agg(F.collect_list(F.struct("kind", "value", "tries", "settled")).alias("own")), "h", "left").drop("h")
    return rows.mapInArrow(run, "doc_id long, text string, n_entities int, entities array<struct<kind:string,start:int,end:int,surrogate:string,settled:boolean>>")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(common.table(spark, sf_dir, "documents"))
