"""Problem 7: filling containers of a fixed capacity."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import stored

#: Slices over which the ranks within one length are summed.
SLICES = 256


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Shortest-pack-first over a length histogram: [(containers, ((length, items a container), ...)), ...].

    Lengths are placed longest first. Each goes to the pattern with the most space left, as often as it fits into all
    containers of that pattern; a pattern is divided where the items run out. Nothing here grows with the number of
    items, only with the number of lengths.
    """
    space: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    heap: list[int] = []

    def put(left: int, count: int, pattern: tuple) -> None:
        if left not in space or not space[left]:
            heapq.heappush(heap, -left)
        space[left].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            while heap and not space[-heap[0]]:
                heapq.heappop(heap)
            left = -heap[0] if heap else 0
            if left < length:
                each = max(1, capacity // length)
                full, rest = divmod(todo, each)
                # An item that fits into no open container opens one; later, shorter items fill it up.
                for count, items in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        put(capacity - length * items, count, ((length, items),))
                todo = 0
                break
            count, pattern = space[left].pop()
            if todo >= count:
                put(left - length, count, _with(pattern, length))
                todo -= count
            else:
                put(left - length, todo, _with(pattern, length))
                put(left, count - todo, pattern)
                todo = 0
    return sorted((c, p) for rows in space.values() for c, p in rows)


def _with(pattern: tuple, length: int) -> tuple:
    return (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items(doc_id, n_tokens) to (doc_id, piece, n_tokens, container): whole items, cut only beyond the capacity.

    An item longer than the capacity gives full pieces of its own and one remainder that is packed like an item. Items
    without tokens (null, zero) need no container and give no row; repeated ids are packed once for each row; no items
    give no rows. The driver holds the histogram of lengths and the patterns (bounded by the capacity), never items.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = items.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    last = F.expr(f"(n_tokens - 1) div {capacity}").cast("int")
    items = items.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    left = F.col("n_tokens") - F.col("piece").cast("long") * capacity
    rest = stored(items.select("doc_id", "piece", F.least(left, F.lit(capacity)).cast("int").alias("_len")))
    histogram = {r[0]: r[1] for r in rest.groupBy("_len").count().collect()}  # at most `capacity` rows
    places = rest.sparkSession.createDataFrame(places_by_rank(pack_histogram(histogram, capacity)), PLACES)
    rows = ranked(rest, ["_len"], ["doc_id", "piece"], places.select("_len", "_width").distinct())
    # Both tables are bounded by the capacity: one row a length, and about two a length and pattern.
    rows = rows.withColumn("_bin", F.expr("_rank div _width")).join(F.broadcast(places.drop("_width")), ["_len", "_bin"]).where("_rank >= _start AND _rank < _end")
    container = F.expr("_first + (_rank - _start) div _times")
    return rows.select("doc_id", "piece", F.col("_len").cast("long").alias("n_tokens"), container.alias("container"))


PLACES = "_len int, _width long, _bin long, _start long, _end long, _first long, _times int"


def places_by_rank(packed: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple]:
    """Patterns to rows of PLACES: the items of one length with ranks _start to _end - 1 go into containers from _first on,
    _times into each. Ranks are binned by the mean width of a length's ranges, so that a range joins by equality of bins."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    containers = 0
    for count, pattern in packed:
        for length, times in pattern:
            ranges[length].append((used[length], used[length] + count * times, containers, times))
            used[length] += count * times
        containers += count
    rows = []
    for length, of in ranges.items():
        width = -(-used[length] // len(of))
        rows += [(length, width, k, *one) for one in of for k in range(one[0] // width, (one[1] - 1) // width + 1)]
    return rows


def ranked(rows: DataFrame, by: list[str], order: list[str], more: DataFrame | None = None) -> DataFrame:
    """_rank of each row within `by`, from 0; summed over slices of a hash, so that one group may hold most rows.

    more: further columns of each group, one row each, which ride along with the slices' sums.
    """
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)).cast("int"))
    each = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_slice")
    before = each.select(*by, "_slice", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    if more is not None:
        before = before.join(more, by)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return rows.join(before, [*by, "_slice"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
