"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The document frequency of every n-gram of the test items is counted over all
documents. An item's seeds are the rarest n-gram of each window of ``WINDOW``
consecutive ones, so every unedited run of ``SEED_WORDS + WINDOW - 1`` words of an
item holds a seed, whatever the frequencies are. Where a document holds seeds, the
item is aligned locally (words; match 1, mismatch and gap -1) with the region around
them, and the pair is reported if the score reaches ``RATIO`` of the item's words.
Edited, shortened and extended copies keep most of the score.

Items come in blocks of about ``BLOCK_CHARS`` characters; a block's seeds are what
is broadcast. More items make more blocks, each a pass over the documents; ``clean``
writes what a block leaves before the next one.

Edge cases: null or wordless texts have no match; an item of fewer than ``SEED_WORDS``
words has no seeds and is matched by documents of exactly its words (in longer ones
the chance of meeting it is too high), a wordless item by none; repeated rows are reported each, a null id stays null; empty tables give no rows;
extra columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED_WORDS, WINDOW = 3, 3
RATIO, LEAST = 0.45, 6
BLOCK_CHARS = 16 << 20


def _item_words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = common.buffers(pa.array(texts, pa.string()))
    hashes, first, _, _ = common.words(data, offsets, common.NOT_WORD)
    return [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two word sequences, and where in ``text`` it ends."""
    n = len(text)
    place = np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, 1, -1))
        row = np.maximum.accumulate(new + place) - place  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _short(batch: pa.RecordBatch, items: dict[tuple[int, ...], list[int]]) -> Iterator[tuple[int, int, int]]:
    """Row, index of the item and number of words, for each text that consists of the words of a short item."""
    if not items:
        return
    data, offsets = common.buffers(batch.column("text"))
    for a, b in common.slices(offsets):
        hashes, first, _, _ = common.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common.NOT_WORD)
        many = np.diff(first)
        for r in np.flatnonzero((many > 0) & (many < SEED_WORDS)).tolist():
            for k in items.get(tuple(hashes[first[r] : first[r + 1]].tolist()), ()):
                yield a + r, k, int(many[r])


def _hits(batch: pa.RecordBatch, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row that has any of the sorted n-gram hashes: the row, its words, places, and indexes into ``wanted``."""
    sieve = np.zeros(1 << 20, bool)
    sieve[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    data, offsets = common.buffers(batch.column("text"))
    for a, b in common.slices(offsets):
        hashes, first, _, _ = common.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common.NOT_WORD)
        codes = common.grams(hashes, SEED_WORDS)
        at = np.flatnonzero(sieve[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(wanted):
            continue
        index = np.minimum(np.searchsorted(wanted, codes[at]), len(wanted) - 1)
        row = np.searchsorted(first, at, side="right") - 1
        good = (wanted[index] == codes[at]) & (at + SEED_WORDS <= first[row + 1])
        at, index, row = at[good], index[good], row[good]
        if not len(row):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(row)], strict=True):
            r = int(row[i])
            yield a + r, hashes[first[r] : first[r + 1]], at[i:j] - first[r], index[i:j]


def frequencies(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted n-gram hashes stands."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, _, _, index in _hits(batch, shared.value):
                n[np.unique(index)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["k", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got, out = rows.toArrow(), np.zeros(len(wanted), np.int64)  # at most a row for each n-gram of the block
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def _seeds(docs: DataFrame, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes with item and place of each; a hash may stand for several items."""
    codes = [common.grams(x, SEED_WORDS) for x in items]
    wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]))
    df = frequencies(docs, wanted)
    found = set()
    for k, c in enumerate(codes):
        rank = df[np.searchsorted(wanted, c)]
        for a in range(max(0, len(c) - WINDOW + 1)) if len(c) >= WINDOW else [0] if len(c) else []:
            some = range(a, min(a + WINDOW, len(c)))
            p = min(some, key=lambda i: (rank[i], c[i]))
            found.add((int(c[p]), k, p))
    rows = sorted(found)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def _matcher(docs: DataFrame, items: list[tuple[int, str]]) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, int, float, int, int]]]:
    """A function from a batch with texts to its matches: row, item, score, ratio, first and last word of the region."""
    words = _item_words([x for _, x in items])
    short: dict[tuple[int, ...], list[int]] = {}
    for k, x in enumerate(words):
        if 0 < len(x) < SEED_WORDS:
            short.setdefault(tuple(x.tolist()), []).append(k)
    model = docs.sparkSession.sparkContext.broadcast((words, [i for i, _ in items], short, *_seeds(docs, words)))

    def match(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, float, int, int]]:
        words, ids, short, seeds, owner, spot = model.value
        for row, k, n in _short(batch, short):
            yield row, ids[k], n, 1.0, 0, n
        wanted = np.unique(seeds)
        low, high = np.searchsorted(seeds, wanted, side="left"), np.searchsorted(seeds, wanted, side="right")
        for row, text, places, index in _hits(batch, wanted):
            begins: dict[int, list[int]] = {}
            for p, k in zip(places.tolist(), index.tolist(), strict=True):
                for s in range(low[k], high[k]):
                    begins.setdefault(int(owner[s]), []).append(p - int(spot[s]))
            for k, starts in sorted(begins.items()):
                n, least = len(words[k]), max(min(LEAST, len(words[k])), RATIO * len(words[k]))
                starts.sort()
                best = (0, 0, 0)
                cuts = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > n), len(starts)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    a, b = max(0, starts[i] - n // 2), min(len(text), starts[j - 1] + n + n // 2 + 1)
                    score, end = align(words[k], text[a:b])
                    best = max(best, (score, -a, a + end))
                if best[0] >= least:
                    yield row, ids[k], best[0], best[0] / n, -best[1], best[2]

    return match


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, with distinct texts once per id."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    rows = common.materialize(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))) if n > 1 else rows.withColumn("block", F.lit(0))
    for k in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.col("block") == k).orderBy("item_id", "text").collect()]  # about BLOCK_CHARS


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, ratio, first_word, last_word): a row for each document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score int, ratio double, first_word int, last_word int"
    out = None
    for items in _blocks(benchmark):
        match = _matcher(docs, items)

        def run(batches: Iterator[pa.RecordBatch], match=match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(match(batch))
                ids = batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                cols = [pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.float64()), (4, pa.int32()), (5, pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "item_id", "score", "ratio", "first_word", "last_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts hold no item; decided row by row, without a join. Seeds come from all of ``docs`` in every block."""
    source, held = docs, None
    for k, items in enumerate(_blocks(benchmark)):
        if k:  # what the block before left
            before, held = held, common.materialize(docs)
            docs = held
            if before is not None:
                common.drop_shared(source.sparkSession, before)
        match = _matcher(source, items)

        def run(batches: Iterator[pa.RecordBatch], match=match) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in match(batch)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
