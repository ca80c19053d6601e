"""Secret scanning: base patterns, and a linear-chain conditional random field.

Texts fall into tokens (runs of letters, digits and ``_+/.-=``). Every token of every
text gets features: its shape (character classes, their changes, length), the sign
before it, whether a word before it names a secret, the next token's shape, and a
feature of its file (how many tokens bear digits). The field tags tokens as begin,
inside or outside of a secret; weights come from its log-likelihood, fitted here on
texts of the corpus (a bounded sample, ``TRAIN_TEXTS``) with made-up secrets of known
forms put in, and Viterbi decodes.

Decoding is exact without a pass over plain prose: where a token's score for outside
leads by more than two transitions can give back, outside is certain, and the runs of
tokens between are decoded on their own.

The field adds spans; base spans stay, and added ones that touch them are dropped.
Offsets are code points, ends exclusive.

Edge cases: a null or empty text has no spans (the digest is that of an empty
string); repeated rows come back each; a null id stays null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
#: Words before a token that name a secret.
NAMES = "password passwd pwd secret token api apikey api_key key auth authorization bearer credential credentials private access session cookie signature passphrase"
TRAIN_TEXTS, TRAIN_ROUNDS, SEED = 1500, 120, 11
#: Words of each training text, and the length from which a word is left out.
TRAIN_WORDS, LONG_WORD = 40, 60
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "_+/.-="), *range(128, 256)]] = True
#: Character classes: 0 lower, 1 upper, 2 digit, 3 sign, 4 other letter.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_HEXA = np.zeros(256, bool)
_HEXA[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
_BEFORE = np.zeros(256, np.int64)
for _chars, _k in (("=", 1), (":", 2), ("\"'`", 3), ("\n", 4), ("([{<", 5), (",;|", 6)):
    for _c in _chars:
        _BEFORE[ord(_c)] = _k
SHAPES, SIGNS, FILES = 6 * 5 * 4 * 2 * 2 * 2, 7, 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _may_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which a base pattern is possible: a sign of assignment, ``AKIA``, or 24 hexadecimal digits in a run."""
    at = [np.flatnonzero((data == 0x3A) | (data == 0x3D))]
    if len(data) >= 24:
        k = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65))
        inside, edge = _HEXA[data], np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a run ends with its text
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
        ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
        at += [k, starts[ends - starts >= 24]]
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(at), side="right") - 1] = True
    return out


def _keywords() -> np.ndarray:
    data, offsets = common.buffers(pa.array([NAMES]))
    return np.sort(common.words(data, offsets)[0])


_NAMED = _keywords()


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, first token of each row (n + 1), and the feature indexes of each token (columns)."""
    hashes, first, starts, ends = common.words(data, offsets, ~_TOKEN)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros((0, len(_SIZES)), np.int64)
    kind = _CLASS[data]
    sums = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    between = lambda s, a, b: s[b] - s[a]
    length = ends - starts
    low, up, digit, sign, other = (between(sums(kind == c), starts, ends) for c in range(5))
    turns = between(sums(np.concatenate(([False], kind[1:] != kind[:-1]))), np.minimum(starts + 1, ends), ends)
    hexa = between(sums(_HEXA[data]), starts, ends) == length
    lengths = np.searchsorted([8, 12, 16, 24, 40], length, side="right")
    turned = np.searchsorted([2, 4, 8, 16], turns, side="right")
    mixed = (low > 0).astype(np.int64) + (up > 0) + (digit > 0)
    shape = ((((lengths * 5 + turned) * 4 + mixed) * 2 + (digit > 0)) * 2 + (hexa & (length >= 12))) * 2 + ((other > 0) | (sign * 3 > length))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.where((starts > 0) & ~edge[starts], _BEFORE[data[np.maximum(starts - 1, 0)]], 4)
    spaced = (starts > 1) & (data[np.maximum(starts - 1, 0)] == 32)
    before = np.where(spaced & (before == 0), _BEFORE[data[np.maximum(starts - 2, 0)]], before)
    named = np.isin(hashes, _NAMED)
    row_start = np.zeros(n + 2, bool)
    row_start[first] = True
    ahead = np.zeros(n, np.int64)
    for back in (1, 2):
        near = np.concatenate((np.zeros(back, bool), named[:-back]))[:n]
        for k in range(back):
            near &= ~np.concatenate((np.zeros(k, bool), row_start[: n - k]))[:n]
        ahead = np.where(near & (ahead == 0), back, ahead)
    after = np.where(row_start[1 : n + 1], 0, 1 + np.concatenate((mixed[1:] + 4 * (lengths[1:] > 1), [0])))
    digits = sums(digit > 0)
    share = (digits[first[1:]] - digits[first[:-1]]) / np.maximum(np.diff(first), 1)
    file = np.repeat(np.searchsorted([0.01, 0.05, 0.25], share, side="right"), np.diff(first))
    return starts, ends, first, np.stack([shape, before, ahead, after, file, lengths * 4 + mixed, turned * 8 + mixed * 2 + (digit > 0)], 1)


_SIZES = (SHAPES, SIGNS, 3, 10, FILES, 24, 40)
_AT = np.concatenate(([0], np.cumsum(_SIZES)))


class Field:
    """Weights by feature and tag (outside, begin, inside), and transitions."""

    def __init__(self):
        self.weights, self.moves = np.zeros((int(_AT[-1]), 3)), np.zeros((3, 3))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k in range(len(_SIZES)):
            out += self.weights[_AT[k] + features[:, k]]
        return out

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Gradient ascent (Adam) on the penalised log-likelihood, forward and backward over padded sequences."""
        most = max(len(t) for _, t in sequences)
        x = np.zeros((len(sequences), most, len(_SIZES)), np.int64)
        y, on = np.zeros((len(sequences), most), np.int64), np.zeros((len(sequences), most), bool)
        for i, (f, t) in enumerate(sequences):
            x[i, : len(t)], y[i, : len(t)], on[i, : len(t)] = f + _AT[:-1], t, True
        flat = x[on]
        first, second = [[np.zeros_like(w) for w in (self.weights, self.moves)] for _ in range(2)]
        pairs = on[:, 1:]
        seen_moves = np.zeros((3, 3))
        np.add.at(seen_moves, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        for step in range(1, TRAIN_ROUNDS + 1):
            e = self.weights[x].sum(2)
            a, scale = np.zeros(e.shape), np.zeros(e.shape[:2])
            m = np.exp(self.moves)
            p = np.exp(e - e.max(2, keepdims=True))
            for t in range(most):
                now = p[:, t] * (a[:, t - 1] @ m if t else 1)
                now = np.where(on[:, t, None], now, a[:, t - 1] if t else now)
                scale[:, t] = now.sum(1)
                a[:, t] = now / scale[:, t, None]
            b, joint = np.ones(e.shape), np.zeros((3, 3))
            for t in range(most - 2, -1, -1):
                later = p[:, t + 1] * b[:, t + 1]
                two = a[:, t, :, None] * m * later[:, None, :]
                two /= two.sum((1, 2), keepdims=True)
                joint += two[pairs[:, t]].sum(0)
                back = later @ m.T
                b[:, t] = np.where(on[:, t + 1, None], back / back.sum(1, keepdims=True), 1)
            g = a * b
            g /= g.sum(2, keepdims=True)
            miss = -g[on]
            miss[np.arange(len(miss)), y[on]] += 1
            up = np.zeros_like(self.weights)
            for k in range(len(_SIZES)):
                np.add.at(up, flat[:, k], miss)
            for k, (w, d) in enumerate(((self.weights, up - 0.05 * self.weights), (self.moves, seen_moves - joint - 0.05 * self.moves))):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                w += 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of all tokens; runs between tokens that are certainly outside are decoded side by side."""
        e = self.emissions(features)
        tags = np.zeros(len(e), np.int64)
        sure = e[:, 0] - e[:, 1:].max(1) > 2 * (self.moves.max() - self.moves.min())
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        starts_row = np.zeros(len(e) + 1, bool)
        starts_row[first] = True
        new = np.concatenate(([True], (np.diff(open_) > 1) | starts_row[open_[1:]]))
        begins = open_[new]
        ends = np.concatenate((open_[np.flatnonzero(new)[1:] - 1], open_[-1:])) + 1
        from_out = ~starts_row[begins]  # the token before is outside, or none
        to_out = (ends < len(e)) & ~starts_row[ends]
        order = np.argsort(begins - ends, kind="stable")  # longest first, so that the open ones come first
        begins, ends, from_out, to_out = begins[order], ends[order], from_out[order], to_out[order]
        lengths, v, backs = ends - begins, np.zeros((len(begins), 3)), []
        for t in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            if t == 0:
                v[:n] = e[begins[:n]] + np.where(from_out[:n, None], self.moves[0], 0)
            else:
                ways = v[:n, :, None] + self.moves
                backs.append(ways.argmax(1))
                v[:n] = ways.max(1) + e[begins[:n] + t]
        last = (v + np.where(to_out[:, None], self.moves[:, 0], 0)).argmax(1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            tags[begins[:n] + t] = last[:n]
            if t:
                last[:n] = backs[t - 1][np.arange(n), last[:n]]
        return tags


def _made_up(rng: random.Random) -> str:
    """A made-up secret of a known form."""
    text = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = letters + letters.upper() + digits
    raw = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    forms = (
        lambda: "ghp_" + text(mixed, 36),
        lambda: "sk-" + text(mixed, 40),
        lambda: "xoxb-" + text(digits, 11) + "-" + text(mixed, 24),
        lambda: "eyJ" + text(mixed, 18) + "." + text(mixed + "_-", 40) + "." + text(mixed + "_-", 30),
        lambda: raw(rng.randint(18, 48)),
        lambda: text(mixed, rng.randint(20, 44)),
        lambda: rng.randbytes(20).hex(),
        lambda: "AKIA" + text(letters.upper() + digits, 16),
        lambda: raw(24) + " " + raw(24) + " " + raw(20),
    )
    return rng.choice(forms)()


def _fit(texts: list[str]) -> Field:
    """A field fitted on runs of words with made-up secrets put in; also lures: long words, numbers, addresses and dates."""
    rng, field, sequences = random.Random(SEED), Field(), []
    names = NAMES.split()
    for text in texts or ["a few plain words to learn from and nothing else"] * 50:
        plain = [x for x in text.split(" ") if not any(c.isdigit() for c in x)] or ["plain"]
        lure = rng.choice(["2024-05-17", "+1 (415) 555-2671", "192.168.10.24", "name.surname42@mail3.example.com", "4465758382889437", "https://www.example.org/en/4711?page=2", "v1.20.3-beta", "tionrelyandthoned" * 2, "HeadlineWithCamelCase", "DE44500105175407324931"])
        piece, secret = list(plain), _made_up(rng)
        lead = rng.choice(["", "", rng.choice(names) + rng.choice([" = ", ": ", "=", " "]), rng.choice(names).upper() + "="])
        quote = rng.choice(["", '"', "'"])
        spot = rng.randrange(len(piece) + 1)
        head = " ".join(piece[:spot]) + " " + lead + quote
        marked = [(len(head.encode()), len((head + secret).encode()))]
        whole = head + secret + quote + " " + " ".join(piece[spot:] + [lure, *plain[:5]])
        if rng.random() < 0.3:
            whole, marked = " ".join([*plain, lure, *plain[:8]]), []
        data, offsets = common.buffers(pa.array([whole]))
        starts, ends, _, f = _features(data, offsets)
        tags = np.zeros(len(starts), np.int64)
        for a, b in marked:
            inside = np.flatnonzero((starts >= a) & (ends <= b))
            tags[inside] = 2
            tags[inside[:1]] = 1
        sequences.append((f, tags))
    field.fit([s for s in sequences if len(s[1])])
    return field


def train(docs: DataFrame) -> Field:
    """A field from a run of ``TRAIN_WORDS`` words of each of the ``TRAIN_TEXTS`` texts with the smallest hash (equal texts once)."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text is not null and length(text) > 0")
    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    # Hashes alone are ordered first: a limit on rows with texts would send that many whole texts of every partition to the driver.
    bound = hashed.select("h").orderBy("h").limit(TRAIN_TEXTS).agg(F.max("h")).first()[0]
    # The run is cut in the tasks, and long words go there, so what comes to the driver has a bound.
    words = F.split("text", " ")
    start = F.pmod(F.col("h"), F.greatest(F.size(words) - TRAIN_WORDS, F.lit(1))) + 1
    run = F.array_join(F.filter(F.slice(words, start.cast("int"), TRAIN_WORDS), lambda x: F.length(x) < LONG_WORD), " ")
    some = hashed.where(F.col("h") <= F.lit(bound)).select("h", run.alias("run")).distinct()  # at most TRAIN_TEXTS texts
    return _fit([r.run for r in sorted(some.collect())])


def scan(docs: DataFrame) -> DataFrame:
    """Spans of each text with counts and digest of the base ones; see ``SCHEMA``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            out = []
            for a, b in common.slices(offsets):
                part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first, features = _features(part, edges)
                tags = field.decode(features, first)
                hits = np.flatnonzero(tags)
                hit_rows = np.searchsorted(first, hits, side="right") - 1
                possible = _may_match(part, edges)
                for r in range(b - a):
                    out.append(([], []))
                todo = np.unique(np.concatenate((np.flatnonzero(possible), hit_rows)))
                bounds = np.searchsorted(hit_rows, np.stack((todo, todo + 1))) if len(todo) else np.zeros((2, 0), int)
                for r, lo, hi in zip(todo.tolist(), *bounds.tolist(), strict=True):
                    raw = part[edges[r] : edges[r + 1]].tobytes()
                    found = base_spans(raw.decode("utf-8", "replace")) if possible[r] else []
                    spans: list[list[int]] = []
                    for t in hits[lo:hi].tolist():
                        if tags[t] == 2 and spans and spans[-1][2] == t - 1:
                            spans[-1][1], spans[-1][2] = int(ends[t] - edges[r]), t
                        else:
                            spans.append([int(starts[t] - edges[r]), int(ends[t] - edges[r]), t])
                    heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))) if spans else []
                    added = [(int(heads[x]), 3, int(heads[y])) for x, y, _ in spans]
                    out[a + r] = found, [s for s in added if not any(s[0] < e and f < s[2] for f, _, e in found)]
            show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            cols = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in out], pa.int64()) for kind in range(3)]
            cols.append(pa.array([hashlib.sha256(show(base).encode()).hexdigest() for base, _ in out], pa.string()))
            cols.append(pa.array([show(sorted(base + added)) for base, added in out], pa.string()))
            cols.append(pa.array([len(added) for _, added in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
