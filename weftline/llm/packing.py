"""Packing of token sequences into fixed-size bins: best fit, then swap-based local search.

Documents become pieces of at most `capacity` tokens. Full pieces fill a sequence each. The others are dealt
into buckets of about BUCKET_PIECES by a hash of their place in the scan, so that no document id, length or text can
make a bucket large, and each bucket is packed on its own: best fit in descending length, then exchanges
between underfull bins. Cutting the input into buckets costs at most one underfull bin a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokenizing
from weftline.runtime import materialize

#: Partial pieces packed together in one task.
BUCKET_PIECES = 20_000
PIECES = "piece int, start long, length long, ids_crc32 long, slot long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which takes what is over."""
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece: the document's id, then PIECES. slot tells the rows of one scan apart."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizing.store(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        slot = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                packed = memoryview(encoder.packed(text) + end)
                for k, (start, length) in enumerate(cut(len(packed) // 4, capacity)):
                    rows.append((key, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), slot))
                    slot += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "slot"]).astype({"id": batch["id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInPandas(encode, f"id string, {PIECES}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


class Bins:
    """Bins of one capacity, indexed by the room left in them."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity, self.lengths = capacity, lengths
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        lengths = self.lengths.tolist()
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r is set where a bin with room r exists
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            n = lengths[i]
            fits = open_rooms >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    open_rooms ^= 1 << r
                self.items[b].append(i)
            else:
                r, b = self.capacity, len(self.items)
                self.items.append([i])
                self.room.append(r)
            self.room[b] = left = r - n
            if left:
                by_room[left].append(b)
                open_rooms |= 1 << left

    def search(self, effort: int = 3000) -> None:
        """Empty bins by exchanges that raise the sum of squared fills, until the bins are as few as the tokens allow or no bin gives.

        The least filled bin gives. It moves a document into room elsewhere, or exchanges one or two of its own for one or two
        smaller ones of a fuller bin (one for one, two for one, one for two). Every exchange moves tokens from a less to a more
        filled bin, so the sum of squares grows by one at least and the search ends. It also ends when effort givers in a row were
        tried and no bin was emptied: as long as it empties bins it goes on.
        """
        least = -(-int(self.lengths.sum()) // self.capacity)
        n_bins = len(self.items)
        if n_bins <= least:
            return
        alive = np.array([b for b in range(n_bins) if self.room[b]], np.int64)
        place = {int(b): k for k, b in enumerate(alive)}
        room = np.array([self.room[b] for b in alive], np.int64)
        # What each bin can give back: nothing, one document, or two; -1 where there is no such choice.
        back = np.full((len(alive), len(_CHOICES)), -1, np.int64)
        for k, b in enumerate(alive):
            back[k] = self._backs(b)
        pairs = np.array([len(c) for c in _CHOICES])
        stuck: set[tuple] = set()  # contents of givers that found nothing
        closed = np.zeros(len(alive), bool)
        idle = 0
        while n_bins > least and idle < effort and not closed.all():
            idle += 1
            k = int(np.argmax(np.where(closed, -1, room)))
            giver = int(alive[k])
            mine = self.items[giver]
            looks = tuple(sorted(self.lengths[mine].tolist()))
            found = None if looks in stuck else self._exchange(k, mine, room, back, pairs)
            if found is None:
                stuck.add(looks)
                closed[k] = True
                continue
            gain, to, give, take = found
            other = int(alive[to])
            theirs = self.items[other]
            taken = [theirs[i] for i in _CHOICES[take]]
            self.items[giver] = [i for i in mine if i not in give] + taken
            self.items[other] = [j for j in theirs if j not in taken] + list(give)
            for b, change in ((giver, gain), (other, -gain)):
                self.room[b] += change
                room[place[b]] = self.room[b]
                back[place[b]] = self._backs(b)
            if not self.items[giver]:
                n_bins -= 1
                room[k] = idle = 0
            # Other bins may find something now.
            stuck.clear()
            closed = room == 0

    def _backs(self, b: int) -> list[int]:
        own = [int(self.lengths[i]) for i in self.items[b][:_SHOWN]]
        return [sum(own[i] for i in c) if not c or c[-1] < len(own) else -1 for c in _CHOICES]

    def _exchange(self, k: int, mine: list[int], room: np.ndarray, back: np.ndarray, pairs: np.ndarray) -> tuple | None:
        """(tokens moved, bin, documents given, choice taken back) of the largest improving transfer."""
        own = sorted(mine, key=lambda i: int(self.lengths[i]))
        one = [(int(self.lengths[i]), (i,)) for i in own]
        two = [(int(self.lengths[a] + self.lengths[c]), (a, c)) for n, a in enumerate(own[-_SHOWN:]) for c in own[-_SHOWN:][n + 1 :]]
        best = None
        for offers, most_back in ((one, 2), (two, 1)):
            if not offers:
                continue
            offers.sort()
            sizes = np.array([o[0] for o in offers])
            allowed = (back >= 0) & (pairs <= most_back)[None, :] & ((room > 0) & (room <= room[k]))[:, None]
            allowed[k] = False
            at = np.searchsorted(sizes, np.where(allowed, back + room[:, None], -1), "right") - 1
            moved = np.where(allowed & (at >= 0), sizes[at] - back, 0)
            flat = int(np.argmax(moved))
            to, take = divmod(flat, moved.shape[1])
            if moved[to, take] > (best[0] if best else 0):
                best = (int(moved[to, take]), to, offers[at[to, take]][1], take)
        return best


#: Documents of a bin that exchanges look at, and the choices of none, one or two of them.
_SHOWN = 8
_CHOICES = [(), *((i,) for i in range(_SHOWN)), *((i, j) for i in range(_SHOWN) for j in range(i + 1, _SHOWN))]


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length."""
    bins = Bins(lengths, capacity)
    bins.search()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, items in enumerate(x for x in bins.items if x):
        where[items] = k
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return where, offset


def best_fit_pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """A row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id. Null and empty texts are one token; documents with repeated ids, or repeated rows, are
    packed each on their own. Only documents longer than capacity are cut. Columns other than id and text are ignored.
    No documents give no rows.
    """
    tokenizer = tokenizer or tokenizing.default_tokenizer()
    cut_up = materialize(pieces(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    shown = [id_col, "piece", "start", "length", "ids_crc32"]
    full = cut_up.where(F.col("length") == capacity).select(*shown, (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut_up.where(F.col("length") < capacity)
    buckets = max(1, -(-rest.count() // BUCKET_PIECES))

    bucket = F.pmod(F.xxhash64("slot"), F.lit(buckets)).alias("bucket")
    rows = rest.select(*shown, "slot", bucket)
    kind = rows.schema[id_col].dataType.simpleString()

    def packed_rows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slot", ignore_index=True)
        where, offset = pack_lengths(group["length"].to_numpy(), capacity)
        return group[shown].assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    placed = (
        rows.withColumn(id_col, F.col(id_col).cast("string"))
        .groupBy("bucket")
        .applyInPandas(packed_rows, f"`{id_col}` string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        .withColumn(id_col, F.col(id_col).cast(kind))
    )
    return full.unionByName(placed)
