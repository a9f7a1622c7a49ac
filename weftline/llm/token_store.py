"""Token ids in binary shards with a minimal perfect hash index.

A shard holds the ids of consecutive documents, in ascending order of their ids:

    keys     the documents' ids, int64, in the order of the payload, and how often each came before (occurrence, uint32)
    payload  raw ids, little-endian, 2 bytes each while every id fits, else 4, documents without separators
    index    a header, a minimal perfect hash of the keys, and by its slots: a 32-bit fingerprint, offset and length in ids

The hash is a cascade of bit arrays: a key sits at the first level where its bit belongs to it alone, and its slot is the number
of bits set before. A lookup touches a few levels, one fingerprint and one offset, whatever the shard's size. A key that
is not in the shard is turned away by its fingerprint (but for one in 2^32).

Shards are rows of Parquet files that Spark writes and commits, so any store Spark reaches will do and a lost executor's half-written
shard never shows. The ids of a part's first and last documents lead from a key to its shards: `lookup` opens no others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import tokenizing

#: Ids after which a shard is closed (16 MB at most, or one document).
SHARD_IDS = 4_000_000
#: Ids that are looked up in a shard at a time, on average, however many lie between its first and its last.
LOOKUP_IDS = 100_000
MAGIC = b"WTOK1\0"
#: Stands for a null id.
NO_ID = -(1 << 63)
SHARDS = "part int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long, keys binary, payload binary, index binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift) of x under a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_of(ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One 64-bit key of a document's id and of how many rows of that id came before."""
    with np.errstate(over="ignore"):
        return _mix(np.asarray(ids, np.int64).view(np.uint64), 0) + np.asarray(occurrence, np.uint64) * _ODD


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays with ranks kept for every 64 bits."""

    GAMMA, LEVELS = 2, 40

    def __init__(self, words: list[np.ndarray], spare: np.ndarray):
        self.words, self.spare = words, spare
        self.ranks, before = [], 0
        for w in words:
            ones = np.cumsum(np.bitwise_count(w), dtype=np.int64)
            self.ranks.append(np.concatenate([[0], ones[:-1]]) + before)
            before += int(ones[-1]) if len(ones) else 0
        self.placed = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, left = [], np.asarray(keys, np.uint64)
        while len(left) and len(words) < cls.LEVELS:
            n = -(-cls.GAMMA * len(left) // 64) * 64
            at = (_mix(left, len(words) + 1) % np.uint64(n)).astype(np.int64)
            single = np.bincount(at, minlength=n) == 1
            words.append(np.packbits(single, bitorder="little").view("<u8"))
            left = left[~single[at]]
        return cls(words, np.sort(left))  # what no level took (none but for colliding keys) is kept as it is

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot, or -1, for keys that were not built in."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks, strict=True)):
            at = (_mix(keys[open_], level + 1) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.spare):
            at = np.minimum(np.searchsorted(self.spare, keys[open_]), len(self.spare) - 1)
            found = self.spare[at] == keys[open_]
            out[open_[found]] = self.placed + at[found]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", len(self.words), len(self.spare)) + b"".join(struct.pack("<I", len(w)) for w in self.words)
        return head + b"".join(w.astype("<u8").tobytes() for w in self.words) + self.spare.astype("<u8").tobytes()

    @classmethod
    def read(cls, buffer: bytes, at: int) -> tuple[PerfectHash, int]:
        levels, spare = struct.unpack_from("<II", buffer, at)
        sizes = struct.unpack_from(f"<{levels}I", buffer, at + 8)
        at += 8 + 4 * levels
        words = []
        for n in [*sizes, spare]:
            words.append(np.frombuffer(buffer, "<u8", n, at))
            at += 8 * n
        return cls(words[:-1], words[-1]), at


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def build_shard(ids: list[int], packed: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(keys, payload, index) of documents in ascending order of their ids; packed: their ids as little-endian uint32."""
    docs = np.array(ids, "<i8")
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    occurrence = (np.arange(len(docs)) - np.repeat(starts, np.diff([*starts, len(docs)]))).astype("<u4")
    tokens = np.frombuffer(b"".join(packed), "<u4")
    width = 2 if not len(tokens) or tokens.max() < 1 << 16 else 4
    lengths = np.array([len(p) // 4 for p in packed], np.int64)
    offsets = np.cumsum(lengths) - lengths
    keys = key_of(docs, occurrence)
    table = PerfectHash.build(keys)
    slots = table.slots(keys)
    by_slot = np.zeros(len(docs), [("print", "<u4"), ("offset", "<u4"), ("length", "<u4")])
    by_slot["print"][slots], by_slot["offset"][slots], by_slot["length"][slots] = _fingerprint(keys), offsets, lengths
    index = MAGIC + struct.pack("<HI", width, len(docs)) + table.to_bytes() + by_slot.tobytes()
    return docs.tobytes() + occurrence.tobytes(), tokens.astype(f"<u{width}").tobytes(), index


class Shard:
    """Keyed access to one shard."""

    def __init__(self, payload: bytes, index: bytes):
        if index[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.width, n = struct.unpack_from("<HI", index, len(MAGIC))
        self.table, at = PerfectHash.read(index, len(MAGIC) + 6)
        self.by_slot = np.frombuffer(index, [("print", "<u4"), ("offset", "<u4"), ("length", "<u4")], n, at)
        self.payload = payload

    def spans(self, ids: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) in ids of each key, -1 for keys that are not in the shard."""
        keys = key_of(ids, occurrence)
        slots = self.table.slots(keys)
        if not len(self.by_slot):
            return np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        rows = self.by_slot[slots]
        known = (slots >= 0) & (rows["print"] == _fingerprint(keys))
        return np.where(known, rows["offset"].astype(np.int64), -1), np.where(known, rows["length"].astype(np.int64), -1)

    def tokens(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self.payload, f"<u{self.width}", length, offset * self.width).astype("<u4")

    def get(self, doc_id: int, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        offset, length = self.spans(np.array([doc_id]), np.array([occurrence]))
        return None if offset[0] < 0 else self.tokens(int(offset[0]), int(length[0]))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append end_id, and write shards in ascending order of the ids; one is closed when it has shard_ids token ids.

    Null and empty texts are the end id alone. Rows with the same id are kept apart by their occurrence, ordered by a hash of the
    text; null ids count as the smallest integer, which is read back as null. Columns other than id and text are ignored. No rows give no shards.
    """
    tokenizer = tokenizer or tokenizing.default_tokenizer()
    end = int(end_id).to_bytes(4, "little")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    # Ranges by id; rows that share an id part by their texts' hash, so no id makes a range large unless its rows are all alike.
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq = tokenizing.store(tokenizer), TaskContext.get().partitionId(), 0
        ids, packed, size = [], [], 0

        def shard() -> pd.DataFrame:
            keys, payload, index = build_shard(ids, packed)
            return pd.DataFrame([(part, seq, ids[0], ids[-1], len(ids), size, keys, payload, index)], columns=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for key, value in zip(batch["id"].tolist(), batch["text"], strict=True):
                ids.append(key)
                packed.append(encoder.packed(value) + end)
                size += len(packed[-1]) // 4
                if size >= shard_ids:
                    yield shard()
                    ids, packed, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    rows.mapInPandas(encode, SHARDS).write.mode("overwrite").option("parquet.block.size", 32 << 20).parquet(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document, read back through the index: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                docs = np.frombuffer(row["keys"], "<i8", row["n_docs"])
                occurrence = np.frombuffer(row["keys"], "<u4", row["n_docs"], 8 * row["n_docs"])
                shard = Shard(row["payload"], row["index"])
                offset, length = shard.spans(docs, occurrence)
                crc = [zlib.crc32(shard.tokens(a, n)) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pd.DataFrame({"part": row["part"], "seq": row["seq"], "id": docs, "offset": offset, "n_tokens": length, "ids_crc32": crc})

    read = shards.select("part", "seq", "n_docs", "keys", "payload", "index").mapInPandas(decode, "part int, seq int, id long, offset long, n_tokens long, ids_crc32 long")
    # Ids before each shard: over the parts' totals first, then within a part. Narrow columns only.
    sums = shards.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(parts, "part").select("part", "seq", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("shard_start"))
    return read.join(starts, ["part", "seq"]).select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias(id_col), (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, occurrence, ids (array<long>): the token ids of each wanted document, its end id included, through the shards' indexes.

    Ids without a document have no row (but for one in 2^32 that a fingerprint lets pass); repeated ids count once, a null id asks for the
    documents without one. Rows that share an id come each, numbered from 0. Other columns of `wanted` are ignored. A key goes to parts by the
    parts' ranges (a row for each partition of the write), then to shards within a part; shards without a wanted id are not read.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    spans = shards.groupBy("part").agg(F.min("first_doc").alias("lo"), F.max("last_doc").alias("hi")).orderBy("part").collect()  # as many as the write had partitions
    part, lo, hi = (np.array([r[c] for r in spans], np.int64) for c in ("part", "lo", "hi"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # Parts are in ascending order of their ids; an id whose rows go on in the next part has several.
            first, last = np.searchsorted(hi, ids, "left"), np.searchsorted(lo, ids, "right")
            many = np.maximum(0, last - first)
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, many)), pa.array(part[at].astype(np.int32))], ["id", "part"])

    ids = wanted.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    narrow = shards.select("part", "seq", "first_doc", "last_doc")
    routed = ids.mapInArrow(route, "id long, part int").join(narrow, "part").where("id BETWEEN first_doc AND last_doc")
    chunks = routed.groupBy("part", "seq").agg(F.ceil(F.count(F.lit(1)) / LOOKUP_IDS).alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk")
    asked = routed.join(chunks, ["part", "seq"]).groupBy("part", "seq", chunk).agg(F.collect_list("id").alias("asked"))
    rows = shards.select("part", "seq", "payload", "index").join(asked, ["part", "seq"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard, left = Shard(row["payload"], row["index"]), np.sort(np.array(row["asked"], np.int64))
                turn = 0
                while len(left):
                    offset, length = shard.spans(left, np.full(len(left), turn))
                    left, offset, length = left[offset >= 0], offset[offset >= 0], length[offset >= 0]
                    for a in range(0, len(left), 1000):
                        tokens = [shard.tokens(x, n).astype(np.int64) for x, n in zip(offset[a : a + 1000].tolist(), length[a : a + 1000].tolist(), strict=True)]
                        n = len(tokens)
                        columns = [pa.array(left[a : a + n]), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array([turn] * n, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "part", "seq", "turn", "ids"])
                    turn += 1

    found = rows.mapInArrow(read, "id long, part int, seq int, turn long, ids array<long>")
    number = F.row_number().over(Window.partitionBy("id").orderBy("part", "seq", "turn")).cast("long") - 1
    return found.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias(id_col), number.alias("occurrence"), "ids")
