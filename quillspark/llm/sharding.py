"""Sharding by minimax contiguous partition: atomic groups in a fixed order, cut so that the largest shard is smallest.

Groups are equal texts, in the order of a digest. The smallest feasible capacity is found by binary search with a greedy
check; among the cuts of that capacity those nearest to even shares are taken. The driver does not see all groups: it holds sums over ranges of digests, and only ranges in which a cut can fall
are asked for in finer parts, until every such part is one group. Each level shrinks what is open, so what the driver holds
stays near the number of ranges of the first level, whatever the table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import materialize

#: Hex digits of the digest by level; 16^3 ranges at first, then 16 or 256 parts of each open one.
LEVELS = (3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 28, 32)


def greedy_cuts(ends: list[int], capacity: int, most: int) -> list[int] | None:
    """Item counts at which shards end if each takes as many as fit, `most` shards at most; None if that is not enough.

    ends: running sums of the item sizes in order.
    """
    cuts, at, base = [], 0, 0
    while at < len(ends):
        if len(cuts) == most:
            return None
        nxt = bisect_right(ends, base + capacity)
        if nxt == at:
            return None
        cuts.append(nxt)
        at, base = nxt, ends[nxt - 1]
    return cuts


def even_cuts(ends: list[int], capacity: int, shards: int) -> list[int]:
    """Item counts at which shards end, none above `capacity`, each cut as near to its even share as the others allow.

    Greedy cuts from the left bound each cut from above, greedy ones from the right from below; between the two the item end
    nearest to j / shards of the whole is taken. So the least capacity holds, and shards do not get smaller to the right.
    """
    n, total = len(ends), ends[-1] if ends else 0
    first = [n] * (shards + 1)  # the earliest place from which the items fit the shards that are left
    for j in range(shards - 1, -1, -1):
        stop = ends[first[j + 1] - 1] if first[j + 1] else 0
        first[j] = bisect_left(ends, stop - capacity) + (1 if stop > capacity else 0) if first[j + 1] else 0
    cuts, at = [], 0
    for j in range(1, shards + 1):
        base = ends[at - 1] if at else 0
        most = bisect_right(ends, base + capacity)
        ideal = bisect_left(ends, j * total / shards)  # items ending before the share; the next one may be nearer
        if ideal < n and (not ideal or ends[ideal] - j * total / shards <= j * total / shards - ends[ideal - 1]):
            ideal += 1
        at = n if j == shards else min(max(ideal, first[j], at), most)
        cuts.append(at)
    return cuts


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which the items in order need at most `shards` shards."""
    ends = list(accumulate(sizes))
    low, high = max([*sizes, -(-sum(sizes) // shards), 0]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cuts(ends, mid, shards) is not None else (mid + 1, high)
    return low


def _open_items(items: list[tuple[str, int, int, int]], shards: int) -> list[str]:
    """Keys of the ranges of several groups in which a greedy cut with the final capacity may fall.

    With whole ranges a greedy shard ends no later than with their groups, so cutting at range ends with the least possible
    capacity bounds each cut from below; the j-th cut is at most j capacities of the coarse solution from the start.
    """
    sizes = [x[1] for x in items]
    ends = list(accumulate(sizes))
    total = ends[-1]
    highest = least_capacity(sizes, shards)
    lowest = max([-(-total // shards), *(x[3] for x in items)])
    found, at = set(), 0
    for j in range(1, shards + 1):
        base = ends[at - 1] if at else 0
        at = max(at, bisect_right(ends, base + lowest))
        last = bisect_right(ends, j * highest)
        for k in range(at, min(last + 1, len(items))):
            if items[k][2] > 1:
                found.add(items[k][0])
        if at >= len(items):
            break
    return sorted(found)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", per_slot_group: int = 4096) -> DataFrame:
    """One row per row of `docs`: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size is UTF-8 bytes of the text (null: none) plus 16; law is 'bytes': the largest shard is as small as contiguous cuts
    between groups of equal texts allow. A group is never cut, so one that is larger than the mean sets the capacity. Null
    texts are one group, apart from empty ones; their CRC is 0 as that of no bytes. slot runs from 0 without gaps in each shard,
    by a hash of the row. grown_shard is null under this law. An empty table gives no rows.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit("f" * 32)).alias("digest"))
    rows = materialize(rows)
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("size")))

    def level(of: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        return sorted((r[0], r[1], r[2], r[3]) for r in of.groupBy(F.substring("digest", 1, digits).alias("k")).agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect())

    items = level(groups, LEVELS[0])
    for before, digits in zip(LEVELS, LEVELS[1:]):
        if not items or not (wanted := _open_items(items, shards)):
            break
        part = groups.where(F.substring("digest", 1, before).isin(wanted)) if len(wanted) <= 200 else groups.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in wanted], "w string")), F.substring("digest", 1, before) == F.col("w"), "left_semi")
        # Items of one group, and ranges opened at another level, stay as they are.
        items = sorted([x for x in items if x[0] not in set(wanted)] + level(part, digits))
    bounds: list[str] = []
    if items:
        sizes = [x[1] for x in items]
        capacity = least_capacity(sizes, shards)
        bounds = [items[c][0] for c in even_cuts(list(accumulate(sizes)), capacity, shards) if c < len(items)]
    number = F.lit(0)
    for b in bounds:  # a bound that stands twice leaves a shard empty
        number = number + F.when(F.col("digest") >= b, 1).otherwise(0)
    n = rows.count()
    parts = max(1, n // (shards * per_slot_group) * 4 + 1)
    rows = rows.withColumn("shard", number.cast("int")).withColumn("place", F.xxhash64(id_col, "digest")).withColumn("part", F.pmod("place", F.lit(parts)))
    counts = rows.groupBy("shard", "part").count()
    first = counts.withColumn("first", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place", F.col(id_col).asc_nulls_last(), "digest")) - 1 + F.col("first")
    return rows.join(first, ["shard", "part"]).select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
