"""Leaderboards against plain Python."""

import collections
import datetime
import math
import random
import zlib

import numpy as np
import pytest

from weftline.llm.leaderboard import Treap, change_feed, play


def check_tree(t):
    """Order, heap order and sizes of all nodes."""

    def walk(at):
        if not at:
            return []
        for child in (t.left[at], t.right[at]):
            assert not child or t.priority[child] < t.priority[at]
        out = [*walk(t.left[at]), at, *walk(t.right[at])]
        assert t.size[at] == len(out)
        return out

    order = walk(t.root)
    assert order == t.walk(10**9) and order == sorted(order, key=lambda k: (-t.revenue[k], t.item[k]))
    return order


@pytest.mark.parametrize("seed", range(4))
def test_treap(seed):
    rng = random.Random(seed)
    have = sorted(((i, float(rng.randrange(4))) for i in rng.sample(range(1000), 40 * seed)), key=lambda x: (-x[1], x[0]))
    t = Treap(np.array([i for i, _ in have], np.int64), np.array([r for _, r in have], np.float64))
    assert len(check_tree(t)) == len(have)
    first = len(t.item)
    t.append(np.arange(2000, 2030))
    inside = {k: r for k, (_, r) in enumerate(have, 1)}
    for _ in range(300):
        node = rng.randrange(1, first + 30)
        if node in inside:
            before = sorted(inside, key=lambda k: (-inside[k], t.item[k])).index(node)
            assert t.delete(node) == before
            del inside[node]
        else:
            inside[node] = float(rng.randrange(4))
            assert t.insert(node, inside[node]) == sorted(inside, key=lambda k: (-inside[k], t.item[k])).index(node)
        assert sorted(check_tree(t)) == sorted(inside)
    items, revenue = t.rows()
    again = Treap(items, revenue)
    assert [(again.item[k], again.revenue[k]) for k in check_tree(again)] == list(zip(items, revenue))


@pytest.mark.parametrize("seed", range(3))
def test_boards_of_days(seed):
    rng = np.random.default_rng(seed)
    worth, board, treap = collections.Counter(), {}, Treap(np.zeros(0, np.int64), np.zeros(0))
    for start in (0, 5, 10):
        n = 200
        days, items, cents = rng.integers(start, start + 5, n), rng.integers(0, 30, n), rng.integers(-9, 12, n).astype(float)
        got, want, stored = list(play(treap, board, days, items, cents)), [], board
        for day in range(start, start + 5):
            for k in np.flatnonzero(days == day):
                worth[int(items[k])] += cents[k]
            now = dict([(i, r) for i, r in sorted(worth.items(), key=lambda x: (-x[1], x[0])) if r > 0][:10])
            if list(now.items()) != list(board.items()):
                want.append((day, now, {i: worth[i] for i in board if i not in now}))
                board = now
        assert [(d, list(b.items()), left) for d, b, left in got] == [(d, list(b.items()), left) for d, b, left in want]
        treap = Treap(*treap.rows())
        assert stored is not board


def plain(lines, items, vendors):
    price, nation = {}, {}
    for i, p in items:
        if i is not None:
            price[i] = p if price.get(i) is None else price[i] if p is None else min(p, price[i])
    for v, n in vendors:
        if v is not None and n is not None:
            nation[v] = min(n, nation.get(v, n))
    by = collections.defaultdict(list)
    for sale, line, item, vendor, quantity, amount, flag, shipped in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = 19723 + h % 150 if shipped is None else (shipped.date() - datetime.date(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        by[max(1, min(10, 1 + math.floor((a - 19723) * 10 / 180)))].append((s, a, item, vendor, quantity, amount, flag))
    days, newest = collections.defaultdict(list), None
    for b in sorted(by):
        for s, a, item, vendor, quantity, amount, flag in by[b]:
            if (newest is None or s + 3 >= newest) and nation.get(vendor) is not None and item in price:
                cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * price[item] + 0.5) if quantity is not None and price[item] is not None else 0
                days[a].append((nation[vendor], item, -cents if flag == "swapped" else cents))
        newest = max([x[0] for x in by[b]] + ([] if newest is None else [newest]))
    worth, boards, out = collections.defaultdict(collections.Counter), collections.defaultdict(dict), []
    for a in sorted(days):
        for n, i, c in days[a]:
            worth[n][i] += c
        for n in {x[0] for x in days[a]}:
            now = {i: k + 1 for k, (i, _) in enumerate(sorted(((i, r) for i, r in worth[n].items() if r > 0), key=lambda x: (-x[1], x[0]))[:10])}
            for i in now.keys() | boards[n].keys():
                if (o := boards[n].get(i)) != (w := now.get(i)):
                    out.append((n, a, i, max(1, min(10, 1 + math.floor((a - 19723) * 10 / 180))), "enter" if o is None else "exit" if w is None else "move", o, w, int(worth[n][i])))
            boards[n] = now
    return sorted(out, key=repr)


LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz"


def test_equal_to_plain_version(spark):
    rng = random.Random(5)
    maybe = lambda x: None if rng.random() < 0.05 else x
    lines = []
    for k in range(900):
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=int(abs(rng.gauss(0, 25))))
        lines.append((maybe(k), maybe(1), maybe(rng.choice([7, rng.randrange(40)])), maybe(rng.choice([2, rng.randrange(9)])), maybe(rng.randrange(5)), maybe(rng.choice([1.005, 10.0, rng.random() * 50])), maybe(rng.choice(["kept", "kept", "swapped"])), maybe(day)))
    lines += lines[:20] + [(1, 1, 7, 2, 1, 5.0, "kept", datetime.datetime(2023, 12, 1)), (2, 1, 7, 2, 1, -5.0, None, datetime.datetime(2024, 9, 1))]
    items = [(i, maybe(1.5 * i)) for i in range(35)] + [(7, 3.0), (None, 1.0)]
    vendors = [(v, maybe(v % 3)) for v in range(8)] + [(2, 0), (None, 1)]
    got = change_feed(
        spark.createDataFrame(lines, LINES).selectExpr("*", "1 AS price", "2 AS nation_id", "3 AS batch", "4 AS day"),
        spark.createDataFrame(items, "item_id long, price double").selectExpr("*", "'x' AS quantity", "1 AS batch"),
        spark.createDataFrame(vendors, "vendor_id long, nation_id int").selectExpr("*", "'y' AS item_id", "2 AS shipped"),
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(lines, items, vendors)


def test_empty_tables(spark):
    nothing = change_feed(spark.createDataFrame([], LINES), spark.createDataFrame([], "item_id long, price double"), spark.createDataFrame([], "vendor_id long, nation_id int"))
    assert nothing.collect() == []
    late = [(1, 1, 7, 2, 1, 5.0, "kept", datetime.datetime(2024, 1, 5))]
    strangers = change_feed(spark.createDataFrame(late, LINES), spark.createDataFrame([], "item_id long, price double"), spark.createDataFrame([(2, 1)], "vendor_id long, nation_id int"))
    assert strangers.collect() == []
