"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group.  Groups are ordered by the digest
of their text, and the ordered line of group sizes is cut into contiguous
shards.  The capacity is the smallest for which a greedy fill needs no more
than the wanted number of shards, found by binary search.  Of all cuts of that
capacity the one with the least sum of squared shard sizes is taken, so that the
shards below the capacity are as even as can be, and none is empty while there
are groups enough.

The driver never sees a row a group.  It gets one row for each of ``16 **
PREFIX`` digest prefixes.  A search over whole prefixes bounds the capacity; from
the bounds follows in which few prefixes any cut of a greedy fill can lie, and
only those are opened, by ``DEEPER`` more digits at a time, until they are single
groups.  What reaches the driver so depends on the number of shards, not on that
of groups.  The capacity is exact; the evenness below it is that of the opened
line, whose unopened prefixes are about 1 / 16 ** PREFIX of all bytes each.

Defined results
---------------
* null text: no bytes, size 1, no checksum; null texts are one group, which is
  not the group of empty texts;
* repeated rows and equal texts stay in one shard, so a group larger than a
  shard's even part sets the capacity and has a shard alone, and the others
  share the rest evenly;
* slots number the rows of a shard from 0; rows that agree in text and id are
  interchangeable; an empty table gives an empty result;
* extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import stage

#: Hexadecimal digits of the digest that name a prefix.
PREFIX = 4
#: Digits by which prefixes are opened.
DEEPER = 2
#: A group's rows are numbered in so many parts, so that no group is one task's work.
SALT = 32


def greedy_cuts(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of contiguous shards filled up to ``capacity``; None if more are needed."""
    upto, ends, start = [0, *accumulate(sizes)], [], 0
    while start < len(sizes):
        end = bisect_right(upto, upto[start] + capacity) - 1
        if end == start or len(ends) == shards:
            return None
        ends.append(end)
        start = end
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which ``greedy_cuts`` succeeds."""
    if not sizes:
        return 0
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Ends (exclusive) of contiguous shards of at most ``capacity`` with the least sum of squares.

    Needs a capacity for which ``greedy_cuts`` succeeds.  The best start of a
    shard never moves left as its end moves right, which halves the choices left
    at every step.
    """
    n, upto = len(sizes), np.array([0, *accumulate(sizes)], dtype=np.int64)
    shards = min(shards, n)
    left = np.searchsorted(upto, upto - capacity)  # the first start that a shard with this end can have
    # Ends that shard i can have: within reach from the left, and so that the rest can be cut.
    last, first = [0], [n]
    for i in range(1, shards + 1):
        last.append(min(int(np.searchsorted(upto, upto[last[-1]] + capacity, "right")) - 1, n - shards + i))
        first.append(max(int(left[first[-1]]), shards - i))
    first.reverse()
    cost, starts = np.zeros(n + 1), []
    for i in range(1, shards + 1):
        new, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        open_ = [(first[i], last[i], first[i - 1], last[i - 1])]
        while open_:
            a, b, low, high = open_.pop()
            if a > b:
                continue
            end = (a + b) // 2
            x, y = max(low, int(left[end])), min(high, end - 1)
            sums = cost[x : y + 1] + (upto[end] - upto[x : y + 1]).astype(float) ** 2
            best = x + int(sums.argmin())
            new[end], start[end] = sums[best - x], best
            open_ += [(a, end - 1, low, best), (end + 1, b, best, high)]
        cost = new
        starts.append(start)
    ends = [n] if n else []
    for start in reversed(starts[1:]):
        ends.append(int(start[ends[-1]]))
    return ends[::-1]


def _open_prefixes(sizes: list[int], largest: int, shards: int) -> set[int]:
    """Indexes of prefixes in which a cut can lie for any capacity that is still possible."""
    upto = [0, *accumulate(sizes)]
    low, high = max(largest, -(-upto[-1] // shards)), smallest_capacity(sizes, shards)
    found, first, last = set(), 0, 0  # bounds of the current cut, as prefix sums
    for _ in range(shards - 1):
        a = min(bisect_right(upto, first + low) - 1, len(sizes))
        b = min(bisect_right(upto, last + high) - 1, len(sizes) - 1)
        found.update(range(min(a, len(sizes) - 1), b + 1))
        first, last = upto[a], upto[b + 1]
    return found


def _totals(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    """Size, largest group and number of groups of every prefix of so many digits."""
    prefix = F.substring("key", 1, digits).alias("prefix")
    rows = groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["prefix"], int(r["size"]), int(r["largest"]), int(r["n"])) for r in rows]


def plan_shards(groups: DataFrame, shards: int) -> list[str]:
    """First group (or prefix) of every shard but the first, from a table of ``key`` (digest) and ``size``."""
    line = sorted(_totals(groups, PREFIX))
    while line:
        open_ = _open_prefixes([size for _, size, _, _ in line], max(largest for _, _, largest, _ in line), shards)
        open_ = {i for i in open_ if line[i][3] > 1}
        if not open_:
            break
        opened = []
        for digits in {len(line[i][0]) for i in open_}:
            names = [line[i][0] for i in sorted(open_) if len(line[i][0]) == digits]
            opened += _totals(groups.where(F.substring("key", 1, digits).isin(names)), digits + DEEPER)
        line = sorted([node for i, node in enumerate(line) if i not in open_] + opened)
    sizes = [size for _, size, _, _ in line]
    ends = even_cuts(sizes, smallest_capacity(sizes, shards), shards) if sizes else []
    return [line[e][0] for e in ends if e < len(line)]


def shard_rows(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and slot: ``doc_id, size, text_crc32, shard, slot``."""
    text = F.col(text_col)
    slim = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("null")).alias("key"),
        ),
        "shard-rows",
    )
    groups = stage(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    starts = plan_shards(groups, shards)
    shard = sum((F.when(F.col("key") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")
    part = F.substring("key", 1, 3)
    salt = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(SALT)).cast("int")
    placed = slim.withColumn("shard", shard).withColumn("part", part).withColumn("salt", salt)
    # At most 16**3 * SALT parts and one more for each cut, whatever the number of rows.
    counts = placed.groupBy("shard", "part", "salt").agg(F.count(F.lit(1)).alias("rows"))
    run = Window.partitionBy("shard").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", "salt", F.coalesce(F.sum("rows").over(run), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part", "salt").orderBy("key", "doc_id")
    numbered = placed.withColumn("n", F.row_number().over(within))
    slot = (F.col("offset") + F.col("n") - 1).cast("long")
    return numbered.join(offsets, ["shard", "part", "salt"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
