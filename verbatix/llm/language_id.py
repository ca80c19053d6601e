"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter's place in an n-gram permutes
(rotates) its vector, and an n-gram's vector binds (multiplies) those of its letters.
A text's profile bundles (adds) the vectors of all its n-grams; a language's prototype
bundles the profiles of its training texts, each weighing alike. The prediction is the
prototype with the largest cosine.

Training covers all documents that may be learnt from: tasks add up n-gram shares by
language and bundle them, so that only one vector for each language (2 KB) reaches the
driver. Beyond ``MAX_LANGS`` languages (100 MB of vectors) it raises.

Edge cases: a text that is null or has no letter gives ``und`` and score 0; without
anything learnt all predictions are ``und``; ties go to the language first by name;
repeated rows count each; a null ``doc_id`` may not be learnt from and comes back
with held_out null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Symbols: 0 parts words, 1 to 26 are a to z, other letters share the rest by code point.
SYMBOLS, N, SIZE = 44, 3, 512
SEED = 7
MAX_LANGS = 50_000
#: Languages a task counts before it hands on their sums (0.7 MB each).
HELD_LANGS = 64
SLICE = 96 << 10


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class Profiles:
    """N-gram counts of texts, and the vectors of n-grams."""

    table: np.ndarray | None = None
    symbols: np.ndarray | None = None

    @classmethod
    def vectors(cls) -> np.ndarray:
        if cls.table is None:
            letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, SIZE))
            table = np.ones((1, SIZE), np.int8)
            for place in range(N):
                turned = np.roll(letters, N - 1 - place, axis=1)
                table = (table[:, None, :] * turned[None, :, :]).reshape(-1, SIZE)
            cls.table = table
        return cls.table

    @classmethod
    def symbol(cls) -> np.ndarray:
        if cls.symbols is None:
            out = np.zeros(0x110000, np.uint8)
            for c in range(0x110000):
                x = chr(c)
                if x.isalpha():
                    low = ord(x.lower()[0])
                    out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % (SYMBOLS - 27)
            cls.symbols = out
        return cls.symbols

    @classmethod
    def counts(cls, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first row, codes of the n-grams that occur, and a matrix of counts."""
        data, offsets = common.buffers(column)
        for a, b in common.slices(offsets, SLICE):
            part = data[offsets[a] : offsets[b]]
            points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            starts = heads[offsets[a : b + 1] - offsets[a]]
            symbol = cls.symbol()[points]
            # A part between words before each text, and runs of them as one.
            row = np.repeat(np.arange(b - a), np.diff(starts))
            symbol, row = np.insert(symbol, starts, 0).astype(np.int64), np.insert(row, starts, np.minimum(np.arange(b - a + 1), b - a - 1))
            keep = np.ones(len(symbol), bool)
            keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
            symbol, row = symbol[keep], row[keep]
            code = symbol[: len(symbol) - N + 1] * SYMBOLS**2 + symbol[1 : len(symbol) - N + 2] * SYMBOLS + symbol[2:] if len(symbol) >= N else symbol[:0]
            # An n-gram lies in the text of its middle letter; those around two texts have a part in the middle.
            where, inner = row[1 : len(code) + 1], symbol[1 : len(code) + 1] > 0
            code, where = code[inner], where[inner]
            if (b - a) * SYMBOLS**N <= 1 << 22:
                full = np.bincount(where * SYMBOLS**N + code, minlength=(b - a) * SYMBOLS**N).reshape(b - a, -1)
                used = np.flatnonzero(full.any(0))
                yield a, used, full[:, used].astype(np.float32)
            else:
                used, code = np.unique(code, return_inverse=True)
                full = np.bincount(where * max(1, len(used)) + code, minlength=(b - a) * len(used)).reshape(b - a, -1) if len(used) else np.zeros((b - a, 0))
                yield a, used, full.astype(np.float32)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit vectors) from all documents that may be learnt from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at])], names=["lang", "code", "n"])
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, used, m in Profiles.counts(batch.column("text")):
                m = m / np.maximum(m.sum(1, keepdims=True), 1)
                own = langs[a : a + len(m)]
                for lang in sorted(set(own)):
                    sums.setdefault(lang, np.zeros(SYMBOLS**N))[used] += m[own == lang].sum(0)
                    if len(sums) >= HELD_LANGS:
                        yield from flush()
        yield from flush()

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of the prototypes; its rows come sorted by language."""
        last, sums = None, np.zeros(SIZE)
        part = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["lang", "part"])
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            codes, shares = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if last is not None and langs[a] != last:
                        yield part()
                        sums = np.zeros(SIZE)
                    last = langs[a]
                    sums = sums + shares[a:b] @ Profiles.vectors()[codes[a:b]].astype(np.float64)
        if last is not None:
            yield part()

    def prototype(group: pa.Table) -> pa.Table:
        x = np.stack(group.column("part").to_pylist()).sum(0)
        x = x / max(float(np.linalg.norm(x)), 1e-30)
        return pa.table({"lang": group.column("lang").slice(0, 1), "vector": pa.array([x.astype(np.float32).tolist()], pa.list_(pa.float32()))})

    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(count, "lang string, code int, n double").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = sums.sortWithinPartitions("lang", "code").mapInArrow(bundle, "lang string, part array<double>")
    vectors = parts.groupBy("lang").applyInArrow(prototype, "lang string, vector array<float>")  # a group has a row for each task
    got = vectors.orderBy("lang").limit(MAX_LANGS + 1).toArrow()
    if got.num_rows > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    order = np.argsort(np.array(got.column("lang").to_pylist(), object), kind="stable")
    flat = got.column("vector").combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0, np.float32)
    return [got.column("lang")[int(k)].as_py() for k in order], flat.reshape(-1, SIZE)[order]


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns from the rows that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = model.value
        for batch in batches:
            n = batch.num_rows
            best, cosine = np.full(n, -1), np.zeros(n)
            for a, used, m in Profiles.counts(batch.column("text")):
                if not len(used) or not langs:
                    continue
                bundle = m @ Profiles.vectors()[used].astype(np.float32)
                near = bundle @ prototypes.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-30)
                some = m.any(1)
                best[a : a + len(m)] = np.where(some, near.argmax(1), -1)
                cosine[a : a + len(m)] = np.where(some, np.clip(near.max(1), 0, 1), 0)
            names = [langs[k] if k >= 0 else "und" for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(cosine)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(common.table(spark, sf_dir, "documents"))
