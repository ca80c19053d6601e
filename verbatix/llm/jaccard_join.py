"""Exact n-gram Jaccard join by grouped prefixes, returned as connected components.

1. Every text becomes its set of distinct word n-grams (64-bit hashes). Texts with
   equal sets are one class from here on.
2. Sets are put in one global order: shingles that repeat (counted in each task,
   then summed) last, by count, the others by hash. Two sets with the wanted
   similarity share a shingle among the first ``n - ceil(t n) + 1`` of each.
3. Classes with identical prefix and size collapse into one group. Groups find the
   shared shingles of the inverted index, and the members of one group meet in a list
   of its own; then each posting row is expanded to the classes of its group.
4. Pairs of classes, not of groups, must pass the size filter and the place filter (an
   upper bound of the overlap from the places of the shared shingle). In long lists
   their parity sketches must not differ in more bits than the sets may in shingles.
   What is left is verified on whole texts.

A large family of near copies would give a quadratic number of pairs in step 4.
Pairs within one component add nothing to the result, so stars come first: in each
posting list every class is verified against a leader of that list, which is linear
in the list. Lists within one component are done and not read by later rounds. Then
exactly those pairs remain whose classes lie in different components; each has an end
outside the list's main component, and all of them are filtered and verified. No list
with an open pair and no candidate is dropped.

Edge cases: a null text or a text without words has the empty set and is linked
with nothing; a text with fewer than ``n`` words has its whole sequence as one
shingle; repeated rows are copies and share a component; rows of one ``doc_id`` with
different texts are one document, linked by any of them; a null ``doc_id`` gets its
class's component if the class has a numbered document, else null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: At most so many repeated shingles are kept for the global order (12 bytes each); others count as rare. Only the order depends on it.
ORDER_LIMIT = 1 << 19
#: Shingles a task gathers before it counts repeats.
COUNT_BATCH = 1 << 20
#: A set of ids of at most so many rows is broadcast (8 bytes each), else the join shuffles.
BROADCAST_ROWS = 1 << 20
STAR_ROUNDS = 4
#: Rows of posting lists that a document has, roughly; only the number of files follows from it.
LIST_ROWS = 16
SKETCH_WORDS = 8
#: From so many classes on, a posting list filters pairs by sketches and first common shingles.
LONG_LIST = 24
SKETCH = [f"w{k}" for k in range(SKETCH_WORDS)]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = common.buffers(batch.column("text"))
    for a, b in common.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        yield from zip(range(a, b), common.shingle_sets(part, offsets[a : b + 1] - offsets[a], n), strict=True)


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return tuple(int(x) for x in np.array([common.mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(common.mix(s ^ np.uint64(0x1234567887654321)))]).view(np.int64))


def _sketch(s: np.ndarray) -> list[int]:
    """Parities of the shingles that fall on each bit: two sets differ in at least as many shingles as their sketches in bits."""
    bits = np.bincount((common.mix(s) >> np.uint64(64 - (64 * SKETCH_WORDS - 1).bit_length())).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def repeated_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen in several distinct sets with their counts, sorted by shingle; for the global order only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["shingle", "n"])

        for batch in batches:
            for _, s in _sets(batch, n):
                if len(s) and (sig := _signature(s)) not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
                    if size >= COUNT_BATCH:
                        yield flush()
                        seen, held, size = set(), [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(ORDER_LIMIT).toArrow()  # bounded by ORDER_LIMIT
    shingles, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    at = np.argsort(shingles)
    return shingles[at], counts[at]


def prefix_rows(docs: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per document: size and signature of its set, and the prefix in global order."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = known.value
        for batch in batches:
            sizes, sigs, rows, sketches = [], [], [], []
            for _, s in _sets(batch, n):
                sizes.append(len(s))
                sigs.append(_signature(s))
                sketches.append(_sketch(s))
                length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(shingles) and length:
                    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
                    weight = np.where(shingles[at] == s, counts[at], 0)
                    s = s[np.argsort(weight, kind="stable")]
                rows.append(s[:length].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rows], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            a, b = zip(*sigs, strict=True) if sigs else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(ends, values), *(pa.array([x[k] for x in sketches], pa.int64()) for k in range(SKETCH_WORDS))], names=["doc_id", "h", "n", "sig1", "sig2", "prefix", *SKETCH])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(prefixes, "doc_id long, h long, n long, sig1 long, sig2 long, prefix array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets reach the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}  # of this batch; a leader stands in many rows
        for batch in batches:
            kept.clear()
            ids = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for name in ("a", "b"):
                texts = batch.column(f"text_{name}")
                first = {x: r for r, x in reversed(list(enumerate(ids[name == "b"]))) if x not in kept}
                some = pa.RecordBatch.from_arrays([texts.take(pa.array(list(first.values()), pa.int64()))], names=["text"])
                kept.update(zip(first, (s for _, s in _sets(some, n)), strict=True))
            good = []
            for a, b in zip(*ids, strict=True):
                x, y = kept[a], kept[b]
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) >= percent * len(y):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append((a, b))
            cols = list(zip(*good, strict=True)) if good else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def link_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: documents are linked where 100 |A & B| >= percent |A | B|."""
    common.settle(docs.sparkSession)
    common.settle_executors(docs.sparkSession)
    order = repeated_shingles(docs, n)
    prefixed = common.materialize(prefix_rows(docs, n, percent, order))
    total = prefixed.count()
    many = LIST_ROWS * total  # about so many rows have all posting lists
    differs = " or ".join(f"min({c}) != max({c})" for c in ("n", "sig1", "sig2"))
    numbered = prefixed.where("doc_id is not null")
    mixed = numbered.groupBy("doc_id").agg(F.expr(f"{differs} as mixed")).where("mixed").limit(1).count() > 0
    # The row with the smallest (id, text hash) names a class.
    classes = numbered.where("n > 0").groupBy("n", "sig1", "sig2").agg(F.min(F.struct("doc_id", "h")).alias("who"))
    classes = classes.select("n", "sig1", "sig2", F.col("who.doc_id").alias("name"), F.col("who.h").alias("h"))
    classes = common.materialize(_numbered(common.materialize(classes, rows=total)) if mixed else classes.withColumn("cid", F.col("name")), rows=total)
    named = prefixed.select(F.col("doc_id").alias("name"), "h", "n", "sig1", "sig2", "prefix", *SKETCH).join(classes, ["name", "h", "n", "sig1", "sig2"])
    grouped = common.materialize(named.select("cid", "name", "h", "n", "prefix", *SKETCH, F.xxhash64("n", "prefix").alias("gid")).dropDuplicates(["cid"]), rows=many)
    groups = grouped.groupBy("gid").agg(F.min("cid").alias("head"), F.count("*").alias("members"))
    heads = grouped.join(groups.select(F.col("head").alias("cid")), "cid", "left_semi")
    entries = heads.select("gid", "n", F.posexplode("prefix").alias("place", "shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    posting = entries.join(shared, "shingle", "left_semi").select("shingle", "gid", "n", "place")
    # A group of several classes is a list of its own, so that its members meet too.
    own = groups.where("members > 1").select(F.col("gid").alias("shingle"), "gid").join(heads.select("gid", "n"), "gid").select("shingle", "gid", "n", F.lit(0).alias("place"))
    rows = common.materialize(prefixed.select("doc_id", "n", "sig1", "sig2"))
    common.drop_shared(docs.sparkSession, prefixed)  # prefixes live on in ``grouped``
    common.settle(docs.sparkSession)
    lists = posting.unionByName(own).join(grouped.select("gid", "cid"), "gid")
    lists = common.materialize(lists.select("shingle", "cid", "n", "place"), rows=many)
    common.settle(docs.sparkSession)

    wanted = grouped.select("cid", "name", "h").join(lists.select("cid").distinct(), "cid")
    wanted = common.materialize(wanted, rows=total)
    texts = docs.select(F.col("doc_id").cast("long").alias("name"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    few = wanted.count() <= BROADCAST_ROWS  # the bound of what is broadcast
    texts = common.materialize(texts.join(F.broadcast(wanted) if few else wanted, ["name", "h"]).select("cid", "text"))
    texts = texts if texts.count() == wanted.count() else texts.dropDuplicates(["cid"])  # repeated rows
    common.drop_shared(docs.sparkSession, wanted)
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m) and least(place, spot) + 1 + least(n - place - 1, m - spot - 1) >= ceil({percent} * (n + m) / {100 + percent}D - 1e-9)"
    # The class whose lists are the fullest is the middle of its family; it leads first.
    lengths = lists.groupBy("shingle").agg(F.count("*").alias("k"))
    weights = common.materialize(lists.join(lengths, "shingle").groupBy("cid").agg(F.sum("k").alias("weight")), rows=total)
    labels, tried = components(common.materialize(_same_id(rows, classes)), None, total) if mixed else None, None
    for k in range(STAR_ROUNDS):
        common.settle(docs.sparkSession)
        if labels is None:
            now = lists.join(weights, "cid").withColumn("label", F.col("cid"))
        else:
            now = _open(lists, labels, many)
            lists = now.drop("label")
        rank = F.struct(-F.col("weight"), F.xxhash64("cid")) if labels is None else F.struct(F.lit(0), F.xxhash64("cid", F.lit(k)))
        lead = now.groupBy("shingle").agg(F.min(F.struct(rank, "cid", "label", F.col("n").alias("m"), F.col("place").alias("spot"))).alias("l"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        lead = lead.select("shingle", F.col("l.cid").alias("other"), F.col("l.label").alias("its"), F.col("l.m").alias("m"), F.col("l.spot").alias("spot"))
        stars = now.join(lead, "shingle").where(f"label != its and {fits}").select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
        stars = common.materialize(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), rows=many)
        if not stars.limit(1).count():
            break
        tried = stars if tried is None else tried.unionByName(stars)
        found = common.materialize(_verify(stars, texts, n, percent), rows=many)
        before, labels = labels, components(found, labels, total)
        common.drop_shared(docs.sparkSession, found, *([] if before is None else [before]))

    common.drop_shared(docs.sparkSession, weights)
    if labels is None:  # no list has a star; each class is its own
        labels = docs.sparkSession.createDataFrame([], "node long, label long")
    common.settle(docs.sparkSession)
    now = _open(lists, labels, many)
    common.settle(docs.sparkSession)
    sizes = now.groupBy("shingle", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"), F.sum("k").alias("length")).where("labels > 1")
    main = common.materialize(main.select("shingle", F.col("top.label").alias("main"), "length"), rows=many)
    # Only long lists carry prefixes and sketches; in a short one a null means that the filter passes.
    held = grouped.select("cid", "gid", "prefix", *SKETCH)
    opened = now.select("shingle", "cid", "n", "place", "label").join(main, "shingle")
    long_ones = opened.where(F.col("length") >= LONG_LIST).join(held, "cid").drop("length")
    short_ones = opened.where(F.col("length") < LONG_LIST).drop("length")
    open_lists = common.materialize(long_ones.unionByName(short_ones, allowMissingColumns=True), rows=many)
    common.drop_shared(docs.sparkSession, now, main, grouped)
    common.settle(docs.sparkSession)
    outside = open_lists.where("label != main").select("shingle", F.col("cid").alias("other"), F.col("label").alias("its"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("prefix").alias("vprefix"), *(F.col(c).alias(f"v{c}") for c in SKETCH))
    # |A ^ B| is at most what two sets of these sizes may differ in, and at least the difference of their sketches.
    close = f"{' + '.join(f'bit_count({c} ^ v{c})' for c in SKETCH)} <= n + m - 2 * ceil({percent} * (n + m) / {100 + percent}D - 1e-9)"
    # A pair counts in the list of its first common shingle only (or in that of its group).
    once = "(shingle = gid or shingle = element_at(array_intersect(prefix, vprefix), 1))"
    # Between two classes outside the main component the smaller id asks, else both would.
    rest = open_lists.join(outside, "shingle").where(f"label != its and (label = main or cid < other) and {fits} and coalesce({close} and {once}, true)")
    rest = rest.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
    rest = common.materialize(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), rows=many)
    common.drop_shared(docs.sparkSession, open_lists)
    common.settle(docs.sparkSession)
    found = common.materialize(_verify(rest, texts, n, percent), rows=many)
    common.drop_shared(docs.sparkSession, texts, rest)
    labels = components(found, labels, total)
    classes = classes.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("cid", F.coalesce("label", "cid")).select("n", "sig1", "sig2", "cid")
    out = rows.select("doc_id", "n", "sig1", "sig2").join(classes, ["n", "sig1", "sig2"], "left")
    if mixed:  # a class may bear another name than its smallest document, and an empty text belongs to its document's component
        least = out.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
        own = out.where("cid is not null and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("of_id"))
        out = out.join(own, "doc_id", "left").withColumn("cid", F.coalesce("cid", "of_id")).join(least, "cid", "left").withColumn("cid", F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("cid", "doc_id").alias("component_id"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with ``cid``: their name, or for several of one name (an id with different texts) numbers beyond all names. The table must be written, so that row numbers stay."""
    several = classes.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name")
    top = classes.agg(F.max("name")).first()[0]
    if top is None:
        return classes.withColumn("cid", F.col("name"))
    again = common.materialize(classes.join(several, "name", "left_semi"))
    if top < 1 << 62:
        number = F.lit(top) + 1 + F.monotonically_increasing_id()
    else:
        number = F.lit(classes.agg(F.min("name")).first()[0]) - 1 - F.monotonically_increasing_id()
    return classes.join(several, "name", "left_anti").withColumn("cid", F.col("name")).unionByName(again.withColumn("cid", number))


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of each id that has several."""
    of = rows.where("doc_id is not null and n > 0").select("doc_id", "n", "sig1", "sig2").distinct().join(classes, ["n", "sig1", "sig2"]).select("doc_id", "cid")
    return of.join(of.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").where("a != cid").select("a", F.col("cid").alias("b"))


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Posting lists with the component of each class; a class without links is its own."""
    return lists.join(labels, lists.cid == labels.node, "left").select("shingle", "cid", "n", "place", F.coalesce("label", "cid").alias("label"))


def _open(lists: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """The posting lists whose classes lie in several components, labelled; the files of ``lists`` go. Components only merge, so a list within one gives no pair any more."""
    now = common.materialize(_labelled(lists, labels), rows=rows)
    common.drop_shared(lists.sparkSession, lists)
    several = now.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("shingle")
    left = common.materialize(now.join(several, "shingle", "left_semi"), rows=rows)
    common.drop_shared(lists.sparkSession, now)
    return left


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component of links, that with the smallest ``doc_id``; documents without links all stay."""
    found = link_components(docs, n, percent).where("doc_id is not null and component_id != doc_id").select("doc_id").distinct()
    gone = common.materialize(found)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(common.table(spark, sf_dir, "documents"))
