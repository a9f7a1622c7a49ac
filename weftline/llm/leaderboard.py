"""Change feed of leaderboards: who enters, leaves or moves on each nation's board of best items, arrival day by arrival day.

Lines come in batches to a stateful streaming query. Its state holds, for each nation and shard of items, an order-statistic treap of all
items by revenue (high first) and item id, and the shard's stored board. A day's changes delete and reinsert their items; where one
stood or comes to stand among the first ten, ten nodes are walked and compared with the stored board, and a changed board is written.
A nation's ten best are among its shards' ten best, so nation boards come from the shards' boards, whose number follows the days and
shards, not the lines. Items are dealt over shards by a hash, so that a nation with most of the lines is many groups; each task adds up
its own lines by item and day before they are shuffled, so that an item with most of the lines is a few rows a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.words import mix
from weftline.runtime import delete, discard, materialize, move, on_workers, scratch_dir

BOARD = 10
FIRST_DAY, DAYS, BATCHES = 19723, 180, 10
#: Days that a line may lag behind the newest of the batches before.
LAG = 3
#: Shards of a nation: a power of two with some SHARD_ITEMS of all items each, at least LEAST_SHARDS.
LEAST_SHARDS, SHARD_ITEMS = 64, 1 << 14
#: Shards whose boards are merged first.
MERGE = 16
#: Lines that a task adds up at a time.
ADDED_ROWS = 1 << 20


class Treap:
    """Items by revenue (high first), then id. Node 0 is no node; nodes are numbered as they are added, priorities are hashes of the ids."""

    def __init__(self, items: np.ndarray, revenue: np.ndarray):
        """Of items that are in order already."""
        n = len(items)
        self.item, self.revenue, self.priority = [0, *items.tolist()], [0.0, *revenue.tolist()], [-1.0, *priorities(items).tolist()]
        self.left, self.right, self.size = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        spine, priority = [], self.priority
        for i in range(1, n + 1):
            last = 0
            while spine and priority[spine[-1]] < priority[i]:
                last = spine.pop()
                self.size[last] = i - 1 - (spine[-1] if spine else 0)
            self.left[i] = last
            if spine:
                self.right[spine[-1]] = i
            spine.append(i)
        self.root = spine[0] if spine else 0
        while spine:
            last = spine.pop()
            self.size[last] = n - (spine[-1] if spine else 0)

    def append(self, items: np.ndarray) -> None:
        """Give new items nodes, outside the tree yet."""
        n = len(items)
        self.item += items.tolist()
        self.priority += priorities(items).tolist()
        self.revenue += [0.0] * n
        self.left += [0] * n
        self.right += [0] * n
        self.size += [0] * n

    def insert(self, node: int, revenue: float) -> int:
        """Put a node in at its place; returns how many stand before it."""
        item, rev, prio, left, right, size = self.item, self.revenue, self.priority, self.left, self.right, self.size
        own, p = item[node], prio[node]
        rev[node] = revenue
        at, above, before, to_left = self.root, 0, 0, False
        while prio[at] >= p:
            size[at] += 1
            above = at
            to_left = revenue > rev[at] or (revenue == rev[at] and own < item[at])
            if to_left:
                at = left[at]
            else:
                before += size[left[at]] + 1
                at = right[at]
        if not above:
            self.root = node
        elif to_left:
            left[above] = node
        else:
            right[above] = node
        # What stood here is split in two by the node.
        low = high = node
        path = []
        while at:
            path.append(at)
            if revenue > rev[at] or (revenue == rev[at] and own < item[at]):
                if high == node:
                    right[node] = at
                else:
                    left[high] = at
                high, at = at, left[at]
            else:
                if low == node:
                    left[node] = at
                else:
                    right[low] = at
                low, at = at, right[at]
        if low == node:
            left[node] = 0
        else:
            right[low] = 0
        if high == node:
            right[node] = 0
        else:
            left[high] = 0
        for at in reversed(path):
            size[at] = size[left[at]] + size[right[at]] + 1
        size[node] = size[left[node]] + size[right[node]] + 1
        return before + size[left[node]]

    def delete(self, node: int) -> int:
        """Take a node out; returns how many stood before it."""
        item, rev, prio, left, right, size = self.item, self.revenue, self.priority, self.left, self.right, self.size
        own, revenue = item[node], rev[node]
        at, above, before, to_left = self.root, 0, 0, False
        while at != node:
            size[at] -= 1
            above = at
            to_left = revenue > rev[at] or (revenue == rev[at] and own < item[at])
            if to_left:
                at = left[at]
            else:
                before += size[left[at]] + 1
                at = right[at]
        a, b = left[node], right[node]
        before += size[a]
        path = []
        while a and b:
            if prio[a] > prio[b]:
                top, a = a, right[a]
                join_right = True
            else:
                top, b = b, left[b]
                join_right = False
            if not above:
                self.root = top
            elif to_left:
                left[above] = top
            else:
                right[above] = top
            path.append(top)
            above, to_left = top, not join_right
        rest = a or b
        if not above:
            self.root = rest
        elif to_left:
            left[above] = rest
        else:
            right[above] = rest
        for at in reversed(path):
            size[at] = size[left[at]] + size[right[at]] + 1
        return before

    def walk(self, most: int) -> list[int]:
        """The first nodes in order."""
        out, stack, at, left, right = [], [], self.root, self.left, self.right
        while (stack or at) and len(out) < most:
            while at:
                stack.append(at)
                at = left[at]
            at = stack.pop()
            out.append(at)
            at = right[at]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All items and revenues in order."""
        order = self.walk(len(self.item))
        return np.array(self.item, np.int64)[order], np.array(self.revenue, np.float64)[order]


def priorities(items: np.ndarray) -> np.ndarray:
    return (mix(items.astype(np.int64).view(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64)


def _positive(treap: Treap) -> dict[int, float]:
    return {treap.item[k]: treap.revenue[k] for k in treap.walk(BOARD) if treap.revenue[k] > 0}


def play(treap: Treap, board: dict[int, float], days: np.ndarray, items: np.ndarray, cents: np.ndarray) -> Iterator[tuple[int, dict[int, float], dict[int, float]]]:
    """(day, board afterwards, items that left it with their revenue) of each day that changes the board. Lines are in any order."""
    order = np.lexsort((items, days))
    days, items, cents = days[order], items[order], cents[order]
    first = np.flatnonzero(np.concatenate([[True], (days[1:] != days[:-1]) | (items[1:] != items[:-1])]))
    cents, days, items = np.add.reduceat(cents, first), days[first], items[first]
    node_of = dict(zip(treap.item[1:], range(1, len(treap.item)), strict=True))
    old = set(node_of)
    new = np.array([k for k in np.unique(items).tolist() if k not in old], np.int64)
    node_of |= zip(new.tolist(), range(len(treap.item), len(treap.item) + len(new)), strict=True)
    treap.append(new)
    revenue = treap.revenue
    starts = [*np.flatnonzero(np.concatenate([[True], days[1:] != days[:-1]])).tolist(), len(days)]
    keys, amounts, on = items.tolist(), cents.tolist(), days.tolist()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        near = False
        for k in range(a, b):
            node = node_of[keys[k]]
            if keys[k] in old:
                if not amounts[k]:
                    continue
                near |= treap.delete(node) < BOARD
            else:
                old.add(keys[k])
            near |= treap.insert(node, revenue[node] + amounts[k]) < BOARD
        if near:
            now = _positive(treap)
            if list(now.items()) != list(board.items()):
                yield on[a], now, {x: revenue[node_of[x]] for x in board if x not in now}
                board = now


def line_day() -> tuple[Column, Column, Column]:
    """(day shipped, arrival day, batch) of a line."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text)
    shipped = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), FIRST_DAY + h % 150)
    arrival = shipped + h % 7 + F.when(h % 5 == 0, 20).otherwise(0)
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((arrival - FIRST_DAY) * BATCHES / DAYS)))
    return shipped, arrival, batch.cast("int")


def _shard_of(item: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(shards)).cast("int")


def shard_boards(spark: SparkSession, fed: str, batches: list[tuple[int, int | None]], shards: int, at: str) -> DataFrame:
    """nation_id, shard, day, items, revenue, left and left_revenue of every change of a shard's board, written under `at`.

    batches: (number, least day shipped that is not dropped) in order; its lines, in folder batch=number of `fed`, move into the folder
    that one streaming query watches, which is started anew for each batch on one checkpoint.
    """
    kinds = "nation_id int, item_id long, shipped int, day int, cents double, batch int"

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held, rows = ["nation_id", "item_id", "day"], [], 0
        for part in parts:
            held.append(part.groupby(keys, as_index=False, sort=False)["cents"].sum())
            rows += len(held[-1])
            if rows >= ADDED_ROWS:
                yield pd.concat(held).groupby(keys, as_index=False, sort=False)["cents"].sum()
                held, rows = [], 0
        if held:
            yield pd.concat(held).groupby(keys, as_index=False, sort=False)["cents"].sum()

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(parts))
        held = state.get if state.exists else (b"", b"", b"", b"")
        items, revenue, board, worth = (np.frombuffer(x, t) for x, t in zip(held, (np.int64, np.float64) * 2, strict=True))
        treap, stored = Treap(items, revenue), dict(zip(board.tolist(), worth.tolist(), strict=True))
        out = list(play(treap, stored, lines["day"].to_numpy(), lines["item_id"].to_numpy(), lines["cents"].to_numpy()))
        stored = out[-1][1] if out else stored
        items, revenue = treap.rows()
        state.update((items.tobytes(), revenue.tobytes(), np.array(list(stored), np.int64).tobytes(), np.array(list(stored.values()), np.float64).tobytes()))
        if out:
            yield pd.DataFrame({
                "nation_id": key[0], "shard": key[1], "day": [d for d, _, _ in out], "items": [list(b) for _, b, _ in out], "revenue": [list(map(int, b.values())) for _, b, _ in out],
                "left": [list(x) for _, _, x in out], "left_revenue": [list(map(int, x.values())) for _, _, x in out],
            })

    rows_out = "nation_id int, shard int, day int, items array<long>, revenue array<long>, left array<long>, left_revenue array<long>"
    state_kind = "items binary, revenue binary, board binary, worth binary"
    for number, floor in batches:
        move(spark, f"{fed}/batch={number}", f"{at}/feed/batch={number}")
        lines = spark.readStream.schema(kinds).parquet(f"{at}/feed")
        if floor is not None:
            lines = lines.where(F.col("shipped") >= floor)
        added = lines.select("nation_id", "item_id", "day", "cents").mapInPandas(add_up, "nation_id int, item_id long, day int, cents double")
        changes = added.withColumn("shard", _shard_of(F.col("item_id"), shards)).groupBy("nation_id", "shard").applyInPandasWithState(step, rows_out, state_kind, "append", "NoTimeout")
        query = changes.writeStream.format("parquet").option("path", f"{at}/boards").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(rows_out).parquet(f"{at}/boards") if batches else spark.createDataFrame([], rows_out)


def _best(entries: Column) -> Column:
    """The ten best of an array of (minus revenue, item) structs."""
    return F.slice(F.array_sort(entries), 1, BOARD)


def nation_changes(boards: DataFrame, last_day: int, shards: int) -> DataFrame:
    """nation_id, day, item_id, old_rank, new_rank and revenue of every item whose rank changed, from the changes of the shards' boards."""
    order = Window.partitionBy("nation_id", "shard").orderBy("day")
    held = boards.withColumn("until", F.coalesce(F.lead("day").over(order), F.lit(last_day + 1)))
    entry = F.transform(F.arrays_zip("items", "revenue"), lambda x: F.struct((-x["revenue"]).alias("minus"), x["items"].alias("item")))
    daily = held.select("nation_id", F.expr(f"shard div {MERGE}").alias("part"), F.explode(F.expr("sequence(day, until - 1)")).alias("day"), entry.alias("b"))
    some = daily.groupBy("nation_id", "part", "day").agg(_best(F.flatten(F.collect_list("b"))).alias("b"))
    board = some.groupBy("nation_id", "day").agg(_best(F.flatten(F.collect_list("b"))).alias("b"))
    # One row a nation and day from here on.
    turn = Window.partitionBy("nation_id").orderBy("day")
    pairs = board.withColumn("old", F.coalesce(F.lag("b").over(turn), F.array().cast(board.schema["b"].dataType))).where("b <> old")
    pairs = materialize(pairs, "boards")

    def ranked(of: str, rank: str) -> DataFrame:
        return pairs.select("nation_id", "day", F.posexplode(of).alias("p", "e")).select("nation_id", "day", F.col("e.item").alias("item_id"), (F.col("p") + 1).alias(rank), (-F.col("e.minus")).alias("revenue"))

    met = ranked("b", "new_rank").join(ranked("old", "old_rank").drop("revenue"), ["nation_id", "day", "item_id"], "full").where("NOT old_rank <=> new_rank")
    # Who left a nation's board is on its shard's board still, or left that on the same day.
    worth = held.select("nation_id", "shard", F.col("day").alias("since"), "until", F.map_from_arrays(F.concat("items", "left"), F.concat("revenue", "left_revenue")).alias("worth"))
    met = met.withColumn("shard", _shard_of(F.col("item_id"), shards)).join(worth, ["nation_id", "shard"]).where("since <= day AND day < until")
    out = materialize(met.select("nation_id", "day", "item_id", "old_rank", "new_rank", F.coalesce("revenue", F.col("worth")[F.col("item_id")]).alias("revenue")), "changes")
    discard(pairs)
    return out


def change_feed(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """nation_id, arrival_day, item_id, batch, change, old_rank, new_rank and revenue (cents, afterwards): every item whose rank on a nation's board changes.

    A board is the ten highest positive revenues of the nation's vendors' items after an arrival day, ties to the smaller item id.
    Lines: sale_id, line_no, item_id, vendor_id, quantity, amount, flag, shipped_at, any of them null; a line without amount counts
    quantity times price, without these nothing; flag `swapped` takes away. Lines whose vendor has no nation or whose item is unknown
    are ignored, but count for what is late: a line shipped more than LAG days before the newest of the batches before is dropped. Repeated
    lines count again; of repeated vendors and items the smallest nation and price holds. Arrival before the first day belongs to
    batch 1. No lines, no rows; other columns are ignored.
    """
    spark = lines.sparkSession
    on_workers(spark)
    shipped, arrival, batch = line_day()
    dated = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", shipped.cast("int").alias("shipped"), arrival.cast("int").alias("day"), batch.alias("batch"))
    newest = sorted((r["batch"], r["s"], r["d"]) for r in dated.groupBy("batch").agg(F.max("shipped").alias("s"), F.max("day").alias("d")).collect())  # a row a batch
    n_items = items.count()
    shards = max(LEAST_SHARDS, 1 << max(0, n_items // SHARD_ITEMS).bit_length())
    # Both sides of the joins below are plain tables, so that Spark can split a vendor or item with many lines over tasks.
    nations = materialize(vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id")).where("nation_id IS NOT NULL"), "nations")
    prices = materialize(items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("price").alias("price")), "prices")
    cents = F.coalesce(F.floor(100 * F.col("amount") + 0.5).cast("double"), F.col("quantity") * F.floor(100 * F.col("price") + 0.5).cast("double"), F.lit(0.0))
    joined = dated.join(nations, "vendor_id").drop("vendor_id").join(prices, "item_id")
    fed = materialize(joined.select("batch", "nation_id", "item_id", "shipped", "day", F.when(F.col("flag") == "swapped", -cents).otherwise(cents).alias("cents")), "feed", partition_by=["batch"])
    there = {r["batch"] for r in fed.select("batch").distinct().collect()}
    at = f"{scratch_dir(spark)}/weftline-leaderboard-{uuid.uuid4().hex}"
    before = [max((s for b, s, _ in newest if b < k), default=None) for k, _, _ in newest]
    batches = [(k, None if m is None else m - LAG) for (k, _, _), m in zip(newest, before, strict=True) if k in there]
    boards = shard_boards(spark, fed.scratch, batches, shards, at)
    out = nation_changes(boards, max((d for _, _, d in newest), default=0), shards)
    discard(nations, prices, fed)
    delete(spark, at)
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    return out.select("nation_id", F.col("day").cast("long").alias("arrival_day"), "item_id", batch.alias("batch"), change.alias("change"), "old_rank", "new_rank", "revenue")
