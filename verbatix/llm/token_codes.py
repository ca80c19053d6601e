"""Token ids in directly addressable codes.

Every text is encoded, closed with the end id, and written in document order.
The ids of a segment are split into chunks of bits. Level 0 holds the lowest
chunk of every id, level k the next chunk of those ids that need it; a bitmap
beside each level says which ids go on, and a rank directory (ones before every
512th bit) finds an id's place on the next level. Any id is read by one probe per
level, without decoding its neighbours.

A file is a Parquet table of self-contained segments (``payload``); Spark's commit
protocol writes it, so lost executors and repeated tasks leave no partial file.
A segment never splits a document.

Edge cases: a null text counts as empty and yields the end id alone; repeated
``doc_id`` (and repeated rows) are kept, in text order; rows without a ``doc_id``
come first; an empty table gives no rows and no segments; extra columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of each level; the last one takes what remains. 50,257 ids need 16 bits.
LEVELS = (8, 8, 16)
RANK_EVERY = 512
MAGIC = b"VDAC1\0"
#: Ids in a segment before it is closed at the next document end.
SEGMENT_IDS = 1 << 18
#: Distinct text pieces of a generation whose ids a worker keeps; it holds two generations.
CACHE = 500_000
#: New pieces that are encoded in one call.
JOINED = 300
#: Bytes of text that are encoded at once (or one text of any length): equal pieces of a block are looked up once.
BLOCK_BYTES = 4 << 20
#: Texts with white space at an end or beside other white space, or with the mark of a cut.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
ODD = rf"{_WHITE}{_WHITE}|\A{_WHITE}|{_WHITE}\z|\x1f"
#: Where a text may be cut: before a mark that follows a letter, a space or a line feed.
CUT = r"([A-Za-z])([.,;:!?*#$%&])|([ \n])"

SCHEMA = "shard int, segment int, first long, n_tokens long, docs array<struct<doc_id:long,first:long,n_tokens:long>>, payload binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """The byte form of a segment: magic, count, number of levels, then for each level its width, length, chunks, bitmap and ranks."""
    rest, out = np.asarray(ids, dtype=np.uint32), [MAGIC, struct.pack("<QB", len(ids), len(LEVELS))]
    for k, bits in enumerate(LEVELS):
        last = k == len(LEVELS) - 1
        chunk = rest if last else rest & np.uint32((1 << bits) - 1)
        more = np.zeros(len(rest), bool) if last else rest >> np.uint32(bits) > 0
        packed = np.packbits(more, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % (RANK_EVERY // 8), np.uint8)))
        ones = np.bitwise_count(packed).reshape(-1, RANK_EVERY // 8).sum(1, dtype=np.uint64)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32) if len(ones) else np.zeros(0, np.uint32)
        body = chunk.astype("<u1" if bits == 8 else "<u2").tobytes()
        out += [struct.pack("<BQII", bits, len(rest), len(packed), len(ranks)), body, packed.tobytes(), ranks.astype("<u4").tobytes()]
        rest = (rest >> np.uint32(bits))[more] if not last else rest
    return b"".join(out)


class Codes:
    """A segment's codes, read in place."""

    def __init__(self, payload: bytes):
        if payload[:6] != MAGIC:
            raise ValueError("not a code segment")
        self.n, levels = struct.unpack_from("<QB", payload, 6)
        at, self.levels = 15, []
        for _ in range(levels):
            bits, n, packed, ranks = struct.unpack_from("<BQII", payload, at)
            at += 17
            chunk = np.frombuffer(payload, "<u1" if bits == 8 else "<u2", n, at)
            at += chunk.nbytes
            bitmap = np.frombuffer(payload, np.uint8, packed, at)
            at += packed
            self.levels.append((bits, chunk, bitmap, np.frombuffer(payload, "<u4", ranks, at)))
            at += 4 * ranks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One id by position: a probe per level, with ranks from the directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for bits, chunk, bitmap, ranks in self.levels:
            out |= int(chunk[i]) << shift
            shift += bits
            byte, bit = divmod(i, 8)
            if not len(bitmap) or not bitmap[byte] >> bit & 1:
                break
            block = i // RANK_EVERY
            head = bitmap[block * (RANK_EVERY // 8) : byte]
            i = int(ranks[block]) + int(np.bitwise_count(head).sum()) + int(bitmap[byte] & (1 << bit) - 1).bit_count()
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, at, shift = np.zeros(self.n, np.uint32), None, 0
        for bits, chunk, bitmap, _ in self.levels:
            if at is None:
                out |= chunk.astype(np.uint32)
                at = np.arange(self.n)
            else:
                out[at] |= chunk.astype(np.uint32) << np.uint32(shift)
            shift += bits
            at = at[np.unpackbits(bitmap, bitorder="little")[: len(at)].astype(bool)]
        return out


class Encoder:
    """Encodes texts with a tokenizer file, remembering the ids of text pieces.

    The byte-level tokenizer always begins a new pre-token at a single space
    between two characters that are not white space, and makes a single line feed
    there a pre-token of its own, and parts a letter from a punctuation mark after it.
    So the pieces between can be encoded alone, equal pieces need it once, and new pieces joined by line feeds need one call. Texts with
    other white space are cut only at such single spaces.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # By piece, with the space or line feed before it; ``older`` is the generation before, and what is asked for moves on.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.line = np.frombuffer(self._ids(["\n"])[0], "<u4")

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces; those without a line feed are encoded in joined texts, and cut at the line feeds' ids."""
        plain = [x for x in pieces if "\n" not in x and (y := x.removeprefix(" ")) and not y[0].isspace() and not y[-1].isspace()]
        rest = set(pieces).difference(plain)
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.frombuffer(self._ids(["\n".join(some)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
            if len(self.line) != 1 or len(ends) != len(some):
                raise ValueError("the tokenizer does not part lines")
            starts, data = np.concatenate(([0], ends[:-1] + 1)), ids.tobytes()
            self.known.update((x, data[4 * a : 4 * b]) for x, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True))
        for at in range(0, len(rest := list(rest)), JOINED):
            self.known.update(zip(rest[at : at + JOINED], self._ids(rest[at : at + JOINED]), strict=True))

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, pieces))
        if None in got:
            new = {x for x, y in zip(pieces, got, strict=True) if y is None}
            kept = {x: y for x in new if (y := self.older.get(x)) is not None}
            self.known.update(kept)
            self._learn([x for x in new if x not in kept])
            got = [self.known[x] if y is None else y for x, y in zip(pieces, got, strict=True)]
        return got

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for r in np.flatnonzero(odd).tolist():
            out[r] = b"".join(self._lookup(self.cut.split(texts[r].as_py())))
        plain = np.flatnonzero(~odd)
        # A piece begins at a space, a line feed, or a mark after a letter; \x1f marks these cuts, and texts that hold it count as odd.
        marked = pc.replace_substring_regex(texts.take(pa.array(plain)), CUT, "\\1\x1f\\2\\3")
        pieces = pc.split_pattern(marked, "\x1f")
        first, codes = pieces.offsets.to_numpy(), pieces.flatten().dictionary_encode()
        ids = self._lookup(codes.dictionary.to_pylist())
        at = codes.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        many = size[at]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        data = flat[np.repeat(begin[at] - (ends - many), many) + np.arange(total)].tobytes()
        rows = (4 * np.concatenate(([0], ends))[first - first[0]]).tolist() if len(first) else [0]
        for k, r in enumerate(plain.tolist()):
            out[r] = data[rows[k] : rows[k + 1]]
        return out


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, with what it remembers from earlier tasks.

    Tasks must come here for it: a function that is sent to the workers by value
    carries a copy of the module variables it names, empty in every task.
    """
    return common.kept(path, lambda: Encoder(path))


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Document ids and texts in blocks of at most ``BLOCK_BYTES`` of text, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        offsets = common.buffers(batch.column("text"))[1]
        for a, b in common.slices(offsets, BLOCK_BYTES):
            more = int(offsets[b] - offsets[a])
            if held and size + more > BLOCK_BYTES:
                yield _joined(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += more
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[list, pa.Array]:
    doc_ids = [x for batch in held for x in batch.column("doc_id").to_pylist()]
    return doc_ids, pa.concat_arrays([batch.column("text") for batch in held])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, order: tuple[str, ...] = ("doc_id",)) -> None:
    """Encode ``docs`` (doc_id, text) and write the code files below ``path`` in ascending order.

    With an empty ``order`` the rows stay where they are, without a shuffle; they should
    then come from a table, whose parts are the same in every attempt.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        segment, first, ids, entries, n = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            payload = encode_codes(np.frombuffer(b"".join(ids), "<u4"))
            row = {"shard": shard, "segment": segment, "first": first, "n_tokens": n, "docs": entries, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for doc_ids, texts in blocks(batches):
            for doc_id, got in zip(doc_ids, encoder.encode(texts), strict=True):
                entries.append({"doc_id": doc_id, "first": n, "n_tokens": len(got) // 4 + 1})
                ids += [got, end]
                n += len(got) // 4 + 1
                if n >= SEGMENT_IDS:
                    yield close()
                    segment, first, ids, entries, n = segment + 1, first + n, [], [], 0
        if entries:
            yield close()

    spark = docs.sparkSession
    entry = pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
    arrow = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(entry)), ("payload", pa.binary())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A number of its own keeps adaptive execution from merging parts, so the partition is the shard.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    keys = [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))] + [F.xxhash64("text")]
    if order:
        rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = rows.select("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read code files back: a row per document with its place in the global id stream and a checksum of its ids.

    The starts of shards come from one total per shard, as many as writing tasks.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each writing task
    start, starts = 0, {}
    for r in sorted(totals):
        starts[r.shard], start = start, start + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("shard", "segment", "first", "docs", "payload")}
                ids = Codes(row["payload"]).all().astype("<u4")
                base = starts[row["shard"]] + row["first"]
                out = [(e["doc_id"], base + e["first"], e["n_tokens"], zlib.crc32(ids[e["first"] : e["first"] + e["n_tokens"]])) for e in row["docs"]]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([row["shard"]] * len(out), pa.int32()), pa.array([row["segment"]] * len(out), pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "segment"])

    return segments.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, segment int")


def lookup(spark: SparkSession, path: str, positions: list[int]) -> dict[int, int]:
    """The ids at the given global positions, each by direct access in its segment."""
    heads = spark.read.schema(SCHEMA).parquet(path).select("shard", "segment", "first", "n_tokens")
    totals = dict(heads.groupBy("shard").agg(F.sum("n_tokens")).collect())
    start, wanted = 0, []
    for shard in sorted(totals):
        wanted += [(p, shard, p - start) for p in positions if start <= p < start + totals[shard]]
        start += totals[shard]
    if not wanted:
        return {}
    at = spark.createDataFrame(wanted, "position long, shard int, place long")
    hit = spark.read.schema(SCHEMA).parquet(path).join(F.broadcast(at), "shard").where("place >= first and place < first + n_tokens")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for r in range(batch.num_rows):
                place, first, payload = (batch.column(c)[r].as_py() for c in ("place", "first", "payload"))
                ids.append(Codes(payload)[place - first])
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(ids, pa.int64())], names=["position", "id"])

    return dict(hit.select("position", "place", "first", "payload").mapInArrow(probe, "position long, id long").collect())  # a row for each position asked for


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write ``docs`` as code files in the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    path = common.shared_dir(spark)
    write(docs, path, tokenizer or tokenizer_path(), end_id, order)
    return read(spark, path)


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.table(spark, sf_dir, "documents"))
