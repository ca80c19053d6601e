"""Toxicity by the nearest labelled examples: exact TF-IDF cosine with a block-max index.

Words fall on ``SLOTS`` hashed features, and all of them count. A word's weight is its
TF-IDF, with inverse document frequencies of all documents, times how far its presence
goes with the label: phi squared (chi-square by the number of labelled rows, so it
does not grow with them), less where chi-square is small enough for chance, and one by
the number of rows added, so that no word's weight is zero. Labelled examples lie in
blocks of ``BLOCK`` similar ones. A word's postings are a list, or a full row if the
word is in many examples, and full rows keep the largest weight of each block. A
document's lists are added up; the product with the block maxima bounds what a block
can still gain, and only blocks that can reach the k-th best cosine are completed, so
the neighbours are exact. Their votes are weighted by closeness, and
an isotonic map fitted on the examples themselves (each without itself) calibrates the
result.

The labelled sample is bounded: the ``EXAMPLES`` rows with the smallest hash of their
id among those that may be learnt from. All else covers all documents.

Edge cases: a text that is null, empty or has no word of any example gets the rate among
examples without words; without labelled rows every score is 0; ties go to the smaller example id;
repeated label rows count once (the larger label); rows are scored by text alone, so
copies score alike; an empty table gives no rows; extra columns are ignored by
``score`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .language_id import held_out

SLOTS = 1 << 22
#: The bound of the labelled sample.
EXAMPLES = 16_384
#: A word's phi squared counts by half where its chi-square is this.
CHANCE = 10.0
BLOCK, NEAREST = 64, 15
#: A word in more than this share of the examples has a full posting row.
FULL = 0.05
#: Queries that are searched together, blocks that each completes first, and what single precision may be off.
TOGETHER, LEAD, SLACK = 512, 8, 1e-5
#: Weights in posting lists are rounded to so many steps; places there have 16 bits, so that EXAMPLES may be at most 65,536.
STEPS = (1 << 16) - 1
THRESHOLD = 0.3
#: Examples that the calibration scores.
CALIBRATE = 3000
#: Rows in a batch of word counts, and bytes in a piece of the pickled index.
FREQUENCY_ROWS, PIECE = 1 << 16, 4 << 20


def _slots(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, slot of each word, and first word of each row (n + 1)."""
    data, offsets = common.buffers(column)
    for a, b in common.slices(offsets):
        hashes, first, _, _ = common.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common.NOT_WORD)
        yield a, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), first


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, number of rows, and row, slot and count of each distinct word, by row and slot."""
    for a, slots, first in _slots(column):
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        both, counts = np.unique(row * SLOTS + slots, return_counts=True)
        yield a, len(first) - 1, both // SLOTS, both % SLOTS, counts


def _weights(row: np.ndarray, counts: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
    """Weights of the words of ``n`` rows; each row has length 1."""
    w = (1 + np.log(counts)) * scale
    return (w / np.maximum(np.sqrt(np.bincount(row, w * w, minlength=n)), 1e-30)[row]).astype(np.float32)


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of ``n`` numbers."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


class Rows:
    """Sparse rows: the features of row r, in ascending order, and their weights lie in first[r]:first[r + 1]."""

    def __init__(self, first: np.ndarray, features: np.ndarray, weights: np.ndarray):
        self.first, self.features, self.weights = first, features, weights

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        row, features = np.nonzero(dense)
        return cls(np.searchsorted(row, np.arange(len(dense) + 1)), features.astype(np.int32), dense[row, features].astype(np.float32))

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        return self.features[self.first[r] : self.first[r + 1]], self.weights[self.first[r] : self.first[r + 1]]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row(), self.weights * x[self.features], minlength=len(self))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.first))

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.first)[rows]
        at = _ranges(self.first[rows], n)
        return Rows(np.concatenate(([0], np.cumsum(n))), self.features[at], self.weights[at])


class Index:
    """Labelled examples in blocks of ``BLOCK``, as an inverted index with block maxima; equal examples are one.

    A feature in more than ``FULL`` of the examples has a full posting row, any other a
    posting list. ``slots`` are the features' slots in ascending order.
    """

    def __init__(self, vectors: np.ndarray | Rows, labels: np.ndarray, ids: np.ndarray, slots: np.ndarray | None = None, features: int | None = None):
        vectors = vectors if isinstance(vectors, Rows) else Rows.of(vectors)
        full = np.diff(vectors.first) > 0
        self.slots, self.features = slots, features if features is not None else int(vectors.features.max(initial=-1)) + 1
        self.rate = (labels[~full].sum() + 0.5 * labels.mean()) / ((~full).sum() + 0.5) if len(labels) else 0.0
        labels, ids = labels[full], ids[full]
        known: dict[bytes, int] = {}
        full = np.flatnonzero(full)
        place = np.array([known.setdefault(hashlib.blake2b(b"".join(x.tobytes() for x in vectors[r]), digest_size=16).digest(), len(known)) for r in full.tolist()], np.int64)
        one, n = np.unique(place, return_index=True, return_counts=True)[1:]
        least = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(least, place, ids)
        self.vectors, self.n, self.ones, self.ids = vectors.take(full[one]), n.astype(np.float64), np.bincount(place, labels, len(n)), least
        self.points: tuple[np.ndarray, np.ndarray] | None = None
        self.post()
        order = self._alike()
        self.vectors, self.n, self.ones, self.ids = self.vectors.take(order), self.n[order], self.ones[order], self.ids[order]
        self.post()

    def _alike(self) -> np.ndarray:
        """An order with alike examples side by side, which makes tight maxima: a few rounds of spherical k-means over the full rows."""
        x = self.dense[:, : len(self.ids)].T
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        start = np.argsort(common.mix(self.ids.astype(np.uint64)), kind="stable")[: max(1, len(x) // (2 * BLOCK))]
        centres, at = x[start], np.zeros(len(x), np.int64)
        for _ in range(4):
            if not len(x):
                break
            at = (x @ centres.T).argmax(1)
            by = np.argsort(at, kind="stable")
            some, first = np.unique(at[by], return_index=True)
            centres = centres.copy()
            centres[some] = np.add.reduceat(x[by], first, axis=0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        return np.lexsort((self.ids, at))

    def post(self) -> None:
        """Make the posting rows, lists and block maxima from the examples' rows."""
        n = len(self.ids)
        self.count = -(-n // BLOCK)
        often = np.bincount(self.vectors.features, minlength=self.features) > FULL * n
        self.full = np.full(self.features, -1, np.int32)
        self.full[often] = np.arange(often.sum())
        rows, full = self.vectors.row(), self.full[self.vectors.features]
        self.dense = np.zeros((int(often.sum()), self.count * BLOCK), np.float32)
        on = np.flatnonzero(full >= 0)
        self.dense[full[on], rows[on]] = self.vectors.weights[on]
        self.most = self.dense.reshape(len(self.dense), self.count, BLOCK).max(2) if n else self.dense
        rest = np.flatnonzero(full < 0)
        rest = rest[np.argsort(self.vectors.features[rest], kind="stable")]
        # An entry of a list: the example's place, and its weight in steps of 1 / STEPS.
        self.lists = rows[rest].astype(np.uint32) << np.uint32(16) | np.rint(self.vectors.weights[rest] * STEPS).astype(np.uint32)
        self.first = np.searchsorted(self.vectors.features[rest], np.arange(self.features + 1))

    def __getstate__(self) -> dict:
        """Workers make the postings anew, so that a broadcast holds the rows alone."""
        return {k: v for k, v in self.__dict__.items() if k not in ("full", "dense", "most", "lists", "first")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.post()

    def search(self, queries: Rows, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and cosines of its nearest examples, exact; ``skip`` is a place to leave out of each.

        Posting lists are added up. The block maxima of the full rows, times the query,
        then bound what a block's examples can still gain; the blocks with the highest
        bounds are completed first, and after that all others that can reach the k-th
        best. What comes so near that rounding could matter is scored anew in double
        precision, from the examples' own rows.
        """
        x = np.zeros(self.features)
        for a in range(0, len(queries), TOGETHER):
            some = queries.take(np.arange(a, min(a + TOGETHER, len(queries))))
            size, width = len(some), self.count * BLOCK
            slack = np.full(size, SLACK)  # what the sums below may be off
            total, head = np.zeros((size, width), np.float32), np.zeros((size, len(self.dense)), np.float32)
            for r in range(size):
                features, weights = some[r]
                full = self.full[features]
                head[r, full[full >= 0]] = weights[full >= 0]
                features, weights = features[full < 0], weights[full < 0]
                n = self.first[features + 1] - self.first[features]
                post = self.lists[np.repeat((self.first[features] - np.cumsum(n) + n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)]
                gain = (post & np.uint32(STEPS)).astype(np.float32)
                gain *= np.repeat((weights / STEPS).astype(np.float32), n)
                total[r] = np.bincount(post >> np.uint32(16), gain, minlength=width)
                slack[r] += weights.sum() / (2 * STEPS)
            if skip is not None:
                total[np.arange(size), skip[a : a + size]] = -9
            blocks = total.reshape(size, self.count, BLOCK)
            bound = blocks.max(2) + head @ self.most
            k = min(LEAD, self.count)
            lead = np.argpartition(-bound, k - 1, axis=1)[:, :k]
            done = np.zeros((size, self.count), bool)
            done[np.arange(size)[:, None], lead] = True
            self._complete(blocks, head, done)
            best = np.take_along_axis(blocks, lead[:, :, None], 1).reshape(size, -1)
            low = np.partition(best, best.shape[1] - NEAREST, axis=1)[:, -NEAREST] if best.shape[1] >= NEAREST else np.zeros(size)
            low = np.maximum(low - 2 * slack, SLACK / 2)
            more = (bound >= low[:, None]) & ~done
            self._complete(blocks, head, more)
            blocks[~(done | more)] = -1
            row, place = np.nonzero(total >= low[:, None])
            near, ends = total[row, place], np.searchsorted(row, np.arange(size + 1))
            for r in range(size):
                at, value = place[ends[r] : ends[r + 1]], near[ends[r] : ends[r + 1]]
                if len(at) > NEAREST:
                    at = at[value >= np.partition(value, len(value) - NEAREST)[-NEAREST] - 2 * slack[r]]
                features, weights = some[r]
                x[features] = weights
                cosine = self._cosines(at, x)
                x[features] = 0
                at, cosine = at[cosine > 0], cosine[cosine > 0]
                keep = np.lexsort((self.ids[at], -cosine))[:NEAREST]
                yield at[keep], cosine[keep]

    def _cosines(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cosines of some examples with a dense vector, in double precision."""
        if not len(at):
            return np.zeros(0)
        starts, ends = self.vectors.first[at], self.vectors.first[at + 1]
        rows = [slice(i, j) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        each = x[np.concatenate([self.vectors.features[i] for i in rows])] * np.concatenate([self.vectors.weights[i] for i in rows])
        return np.round(np.add.reduceat(each, np.concatenate(([0], np.cumsum(ends - starts)[:-1]))), 9)

    def _complete(self, blocks: np.ndarray, head: np.ndarray, wanted: np.ndarray) -> None:
        """Add the full rows to the wanted blocks of each query."""
        for b in np.flatnonzero(wanted.any(0)).tolist():
            rows = np.flatnonzero(wanted[:, b])
            blocks[rows, b] += head[rows] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]

    def votes(self, queries: Rows, skip: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic neighbours by closeness, with the places and cosines of the neighbours; the rate of empty texts where there is none."""
        if not len(self.ids):
            yield from ((self.rate, np.zeros(0, np.int64), np.zeros(0)) for _ in range(len(queries)))
            return
        for at, cosine in self.search(queries, skip):
            weight = 1 / (1.02 - np.minimum(cosine, 1))
            yield float((weight * self.ones[at]).sum() / (weight * self.n[at]).sum()) if len(at) else self.rate, at, cosine

    def calibrate(self) -> None:
        """Pool adjacent violators over the votes of a spread of the examples, each without itself."""
        some = np.unique(np.linspace(0, len(self.ids) - 1, CALIBRATE).astype(np.int64)) if len(self.ids) else np.zeros(0, np.int64)
        found = self.votes(self.vectors.take(some), some)
        triples = sorted((v, float(self.ones[k] / self.n[k]), float(self.n[k])) for k, (v, _, _) in zip(some.tolist(), found, strict=True))
        pools: list[list[float]] = []
        for v, y, n in triples:
            pools.append([v, y, n])
            while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
                v1, y1, n1 = pools.pop()
                v0, y0, n0 = pools.pop()
                n = n0 + n1
                pools.append([(v0 * n0 + v1 * n1) / n, (y0 * n0 + y1 * n1) / n, n])
        if pools:
            self.points = np.array([p[0] for p in pools]), np.array([(p[1] * p[2] + 0.01) / (p[2] + 0.02) for p in pools])

    def scores(self, queries: Rows) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Calibrated score of each query, with places and cosines of its evidence."""
        for v, at, cosine in self.votes(queries):
            yield float(np.interp(v, *self.points)) if len(at) and self.points is not None else float(v), at, cosine


def train(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Broadcast] | None:
    """The scale of each slot, and the index of labelled examples (``Model``); None without labelled rows."""
    spark = docs.sparkSession
    common.settle(spark)
    common.settle_executors(spark)
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    mine = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(common.materialize(mine)), "doc_id")  # at most EXAMPLES rows are broadcast
    # Copies would pass for evidence; the smallest id names a text.
    sample = sample.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    sample = common.materialize(sample.select("doc_id", "toxic", "text"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        for batch in batches:
            y = batch.column("toxic").to_numpy()
            slots, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, words, first in _slots(batch.column("text")):
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                both = np.unique(row * SLOTS + words)
                slots.append(both % SLOTS)
                marks.append(y[a + both // SLOTS].astype(np.int64))
            slot, back = np.unique(np.concatenate(slots), return_inverse=True)
            ones = np.bincount(back, np.concatenate(marks), minlength=len(slot)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.bincount(back, minlength=len(slot))), pa.array(ones)], names=["slot", "n", "ones"])

    totals = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, ones = totals[0], totals[1] or 0
    if not n:
        return None
    marks = sample.select("toxic", "text").mapInArrow(presence, "slot long, n long, ones long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()  # at most SLOTS rows
    slots, rows_of, ones_of = (marks.column(c).to_numpy() for c in ("slot", "n", "ones"))
    # A word in all rows or a single label tells nothing.
    chi = (ones_of * float(n) - rows_of * float(ones)) ** 2 * n / np.maximum(rows_of * (n - rows_of) * float(ones) * (n - ones), 1)
    scale = np.full(SLOTS, 1 / n, np.float32)
    scale[slots] += chi / n * chi / (chi + CHANCE)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        total, rows = np.zeros(SLOTS, np.int32), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, slot, _ in _counts(batch.column("text")):
                np.add.at(total, slot, np.int32(1))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], names=["slot", "n"])
        for k in range(0, len(on), FREQUENCY_ROWS):
            part = on[k : k + FREQUENCY_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["slot", "n"])

    df = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(frequency, "slot int, n long").groupBy("slot").agg(F.sum("n").cast("float").alias("n")).toArrow()  # at most SLOTS + 1 rows of 8 bytes
    found = np.zeros(SLOTS + 1, np.float32)
    found[df.column("slot").to_numpy()] = df.column("n").to_numpy()  # -1, the number of documents, is the last place
    scale *= np.log((found[-1] + 1) / (found[:-1] + 1)) + 1

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, size, row, slot, counts in _counts(batch.column("text")):
                part, first = batch.slice(a, size), np.searchsorted(row, np.arange(size + 1))
                cols = ([x[i:j].astype(np.int32).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)] for x in (slot, counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "toxic", "slots", "counts"])

    del df, found
    shared = spark.sparkContext.broadcast(scale)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pickled index, in pieces. A task builds it, so that the driver only passes it on."""
        common.let_go()
        got = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())]))
        got = got.take(np.lexsort((got.column("toxic").to_numpy(), got.column("doc_id").to_numpy())))
        words, counts = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.int32) for c in ("slots", "counts"))
        first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got.column("slots").to_pylist()], dtype=np.int64)))
        slots = np.unique(words)
        row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        vectors = Rows(first, np.searchsorted(slots, words).astype(np.int32), _weights(row, counts, shared.value[words], len(first) - 1))
        index = Index(vectors, got.column("toxic").to_numpy().astype(np.float64), got.column("doc_id").to_numpy(), slots, len(slots))
        del got, words, counts, row, vectors
        index.calibrate()
        blob = pickle.dumps(index, protocol=5)
        del index
        common.trim()
        for k in range(0, len(blob), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([blob[k : k + PIECE]], pa.binary())], names=["at", "piece"])

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(examples, "doc_id long, toxic int, slots binary, counts binary")
    pieces = rows.repartition(1).mapInArrow(build, "at long, piece binary").toArrow()  # of at most EXAMPLES rows
    pieces = pieces.take(np.argsort(pieces.column("at").to_numpy()))
    model = spark.sparkContext.broadcast(Model(b"".join(pieces.column("piece").to_pylist())))
    del pieces, scale
    common.settle(spark)
    return shared, model


class Model:
    """The index, unpickled where it is first used."""

    def __init__(self, blob: bytes):
        self.blob = blob

    @cached_property
    def index(self) -> Index:
        common.let_go()
        blob, self.blob = self.blob, b""  # the worker's copy is not needed beside the index
        index = pickle.loads(blob)
        del blob
        common.trim()
        return index


def _scorer(docs: DataFrame, labels: DataFrame):
    """A function from a string column to (score, evidence) of each row."""
    model = train(docs, labels)

    def run(column: pa.Array) -> Iterator[tuple[float, list[dict]]]:
        if model is None:
            yield from ((0.0, []) for _ in range(len(column)))
            return
        scale, index = model[0].value, model[1].value.index
        known, parts = np.append(index.slots, -1), [(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for _, size, row, slot, counts in _counts(column):
            weights = _weights(row, counts, scale[slot], size)
            feature = np.searchsorted(index.slots, slot)
            held = np.flatnonzero(known[feature] == slot)
            parts.append((np.searchsorted(row[held], np.arange(1, size + 1)) + parts[-1][0][-1], feature[held], weights[held]))
        queries = Rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for value, at, cosine in index.scores(queries):
            yield value, [{"doc_id": int(index.ids[k]), "label": round(float(index.ones[k] / index.n[k]), 5), "cosine": round(float(c), 5)} for k, c in zip(at[:3], cosine[:3], strict=True)]

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row; evidence are the nearest labelled examples."""
    run = _scorer(docs, labels)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.float64()), ("cosine", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(run(batch.column("text")))
            values = np.array([x for x, _ in got], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array([x for _, x in got], near)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,label:double,cosine:double>>")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; decided row by row, without a join."""
    run = _scorer(docs, labels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x < threshold for x, _ in run(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
