"""Filling containers of fixed capacity (problem 8).

The number of items of each size is all that the packing depends on, and there are no more sizes than the capacity, so
the driver packs a histogram, whatever the number of items. Martello and Toth's reduction comes first: for each size,
from large to small, a set of up to three items that dominates every other use of such an item is fixed as often as the
sizes allow and leaves the instance, until no further set is proven; best fit takes the rest. The result is a table of container patterns with their multiplicities; items are
numbered within their size, by salted groups, and find their place in the pattern table by binary search.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.tables import cut

MAX_CAPACITY = 1 << 20


class Histogram:
    """Counts by size, with the sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest_within(self, room: int) -> int:
        """The largest size of at most ``room``, 0 if there is none."""
        k = bisect_left(self.sizes, room + 1)
        return self.sizes[k - 1] if k else 0


def _smallest(h: Histogram, n: int) -> list[int]:
    """The ``n`` smallest items, fewer where there are not as many."""
    out: list[int] = []
    for s in h.sizes:
        out += [s] * min(h.count[s], n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(h: Histogram, room: int) -> tuple[int, int] | None:
    """Two items, the larger first, with the largest sum within ``room``; of equal sums the one with the largest item."""
    best, usable = None, [s for s in h.sizes[: bisect_left(h.sizes, room)] if h.count[s] > 0]
    i, j = 0, len(usable) - 1
    while i <= j:
        small, large = usable[i], usable[j]
        if small + large > room or (i == j and h.count[small] < 2):
            j -= 1
            continue
        if best is None or small + large > sum(best):
            best = (large, small)
        i += 1
    return best


def dominating_set(h: Histogram, x: int, capacity: int) -> tuple[int, ...] | None:
    """A set of at most three items that some best packing puts together with one of size ``x``, None where none is proven.

    A set is proven if it dominates every other one that holds ``x`` and fits: the others' items can be dealt out to its
    own so that none gets more than it weighs. With ``k`` the number of smallest items that fit beside ``x``: alone if
    k = 0; with the largest that fits if that fills the container, if k = 1, or if k = 2 and it weighs no less than any two
    that fit; for k = 2 with the heaviest two that fit, if the larger of them is the largest that fits and no two items
    between them fit instead.
    """
    room = capacity - x
    h.count[x] -= 1  # the item itself is not its own partner
    try:
        y = h.largest_within(room)
        while y and not h.count[y]:
            y = h.largest_within(y - 1)
        if not y:
            return (x,)
        few = _smallest(h, 3)
        k = 1 if len(few) < 2 or few[0] + few[1] > room else 2 if len(few) < 3 or sum(few) > room else 3
        if y == room or k == 1:
            return (x, y)
        if k > 2:
            return None
        large, small = _best_pair(h, room)
        if y >= large + small:
            return (x, y)
        if large < y:
            return None
        # the two smallest items between the two: what else could take the place of both
        between = [s for s in h.sizes if small < s < large and h.count[s] > 0]
        rivals = [s for s in between[:2] for _ in range(min(2, h.count[s]))][:2]
        rivals += [large] * (2 - len(rivals)) if len(rivals) < 2 and h.count[large] > 1 else []
        return (x, large, small) if len(rivals) < 2 or sum(rivals) > room else None
    finally:
        h.count[x] += 1


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int, str]]:
    """(sizes in one container, number of such containers, how): a packing of all items; no size may exceed the capacity."""
    h = Histogram(counts)
    out: list[tuple[tuple[int, ...], int, str]] = []
    shrunk = True
    while shrunk:  # what is taken away may prove items that were passed over before
        shrunk = False
        for x in list(reversed(h.sizes)):
            while h.count.get(x) and (found := dominating_set(h, x, capacity)):
                need = defaultdict(int)
                for s in found:
                    need[s] += 1
                # what is taken away only leaves fewer alternatives: the set stays proven while its items last
                times = min(h.count[s] // n for s, n in need.items())
                for s, n in need.items():
                    h.take(s, n * times)
                out.append((found, times, "reduced"))
                shrunk = True
    # best fit, sizes from large to small; containers alike are kept together
    open_: dict[int, list[list]] = {}  # room -> [[sizes, multiplicity]]
    rooms: list[int] = []

    def put(room, sizes, n):
        if n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([sizes, n])

    for size in reversed(h.sizes):
        left = h.count[size]
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                sizes, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, sizes, n = capacity, (), -(-left // (capacity // size))
            each = room // size
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            put(room - each * size, sizes + (size,) * each, full)
            if rest:
                put(room - rest * size, sizes + (size,) * rest, 1)
            if sizes:
                put(room, sizes, n - full - (rest > 0))
            left -= full * each + rest
    out += [(sizes, n, "best fit") for room in rooms for sizes, n in open_[room]]
    return out


def place_table(patterns: list[tuple[tuple[int, ...], int, str]], first: int = 0) -> dict[str, np.ndarray]:
    """Runs of items: the items of ``size`` from number ``rank`` on lie in containers from ``container`` on, ``each`` to a container, the first at ``at``."""
    used: dict[int, int] = defaultdict(int)
    rows = []
    container = first
    for sizes, n, _ in patterns:
        at, k = 0, 0
        while k < len(sizes):
            size, each = sizes[k], 1
            while k + each < len(sizes) and sizes[k + each] == size:
                each += 1
            rows.append((size, used[size], container, each, at))
            used[size] += n * each
            at += size * each
            k += each
        container += n
    rows.sort()
    size, rank, to, each, at = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 5
    return {"size": size, "rank": rank, "container": to, "each": each, "at": at}


RANK_BITS = 40


def _place(table: dict[str, np.ndarray]):
    keys = (table["size"] << RANK_BITS) + table["rank"]

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            run_ = np.searchsorted(keys, (size << RANK_BITS) + rank, "right") - 1
            past = rank - table["rank"][run_]
            to = table["container"][run_] + past // table["each"][run_]
            at = table["at"][run_] + (past % table["each"][run_]) * size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(to), pa.array(at)], ["key", "start", "size", "container_id", "offset"])

    return run


def fill(items: DataFrame, key: str, size: str, capacity: int, rows_a_group: int = 200_000) -> DataFrame:
    """(key, start, size, container_id, offset): every item of positive size placed exactly once.

    An item within the capacity stays whole (``start`` 0). A larger one is cut into full containers of its own and a
    remainder, which is packed like an item. Null, zero and negative sizes have no row. Repeated rows are packed as
    often as they come, whatever their keys; other columns are not read.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie between 1 and {MAX_CAPACITY}")
    kind = items.schema[key].dataType.simpleString()
    items = cut(items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")).where("n > 0"))  # measured once
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))
    parts = items.select("key", "n", F.explode(starts).alias("k")).select("key", (F.col("k") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("k") * capacity).cast("long").alias("size"))
    total = items.count()
    salts = max(1, -(-total // rows_a_group))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(salts)))
    counts = parts.groupBy("size", "salt").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    # at most `capacity` rows reach the driver
    histogram = {r["size"]: r["c"] for r in counts.groupBy("size").agg(F.sum("c").alias("c")).collect()}
    table = place_table(pack_histogram(histogram, capacity))
    inside = Window.partitionBy("size", "salt").orderBy("key", "start")
    ranked = parts.withColumn("in_group", F.row_number().over(inside) - 1).join(before, ["size", "salt"])
    ranked = ranked.select("key", "start", "size", (F.col("before") + F.col("in_group")).alias("rank"))
    placed = ranked.mapInArrow(_place(table), f"key {kind}, start long, size long, container_id long, offset long")
    return placed.withColumnRenamed("key", key)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_pieces, tokens, capacity, fill): how full the containers are; no row for an empty table."""
    whole = placed.agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("size").alias("tokens"))
    return whole.where("n_containers > 0").select("n_containers", "n_pieces", "tokens", F.lit(capacity).alias("capacity"), F.round(F.col("tokens") / (F.col("n_containers") * capacity), 6).alias("fill"))
