"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame operations only.

1. Targets: sources share the total by weight; none gets above `most` times its size, the excess goes to the rest.
2. Quotas: blocks of `block` words go to sources by the highest quotients target / (2 k + 1), then a source's
   blocks to its shards in the same way by shard size. A shard holds about the square root of its source's documents,
   so neither the shards of a source nor the documents of a shard grow as fast as the table.
3. Selection: a shard's documents stand in a seeded order and form a circle of words. The shard takes its quota of
   blocks from a seeded start on, going round as often as needed: each word is taken floor or ceil(quota / size) times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """sources (source, source_size, documents) with target added: least(most * size, weight * level), one level for all.

    The level is found in one pass, in order of the level at which a source meets its cap: with the first k sources capped
    the rest would get what those leave, by weight. This rises with k as long as the next source is above its cap, then
    falls, so the highest is the one that holds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")).withColumn("meets", cap / F.col("weight"))
    before = Window.orderBy("meets", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / rest).withColumn("level", F.max("level").over(everything))
    return level.withColumn("target", F.least(cap, F.col("weight") * F.col("level"))).drop("meets", "level")


def sainte_lague(rows: DataFrame, group: list[str], weight: str, seats: str, cap: str, order: list[Column]) -> DataFrame:
    """rows with quota added: the group's `seats` go one by one to the row with the highest weight / (2 k + 1), k its seats so far.

    With one divisor d, rows get floor(weight / d + 1/2); d = W / (seats - n / 2) gives at most `seats` to n rows of weight
    W, and d = W / (seats + n / 2) at least as many. So only the at most 2 n quotients between the two are ranked. No row
    gets more than its cap; seats that only capped rows could take stay free.
    """
    w = Window.partitionBy(*group)
    x = rows.withColumn("_n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(w)).withColumn("_w", F.sum(F.col(weight).cast("double")).over(w))
    share = F.col(weight) / F.col("_w")
    at = lambda d: F.least(F.col(cap), F.when(F.col("_w") > 0, F.greatest(F.lit(0), F.floor(share * d + 0.5))).otherwise(0)).cast("long")
    x = x.withColumn("_low", at(F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2))).withColumn("_high", at(F.col(seats) + F.col("_n") / 2 + 1)).withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    ranked = x.withColumn("_k", F.explode(F.expr("if(_high > _low, sequence(_low, _high), array(_low))")))  # the last of each row stands for the row itself
    real = F.col("_k") < F.col("_high")
    ranked = ranked.withColumn("_rank", F.sum(F.when(real, 1).otherwise(0)).over(w.orderBy(F.desc(F.when(real, F.col(weight) / (2 * F.col("_k") + 1)).otherwise(-1.0)), *order, "_k").rowsBetween(Window.unboundedPreceding, 0)))
    won = F.sum(F.when(real & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).cast("long")
    names = rows.columns
    return ranked.groupBy(*names).agg((F.first("_low") + won).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, text_digest, source, size, source_size, target, taken (names fixed, ids as given).

    Sources stand by code point, null last, and their weights repeat. A null or blank text has size 0 and taken 0.
    taken is between 0 and most * size; a source's taken is within a block for each of its shards of its target. Equal rows are
    told apart by nothing, so they share what their places get in any order; the rows as a whole are the same in every run.
    An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), F.lit(seed)).alias("text_digest"))
    rows = materialize(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = capped_targets(sources, list(weights), most)
    total = Window.partitionBy()
    sources = sources.withColumn("blocks", F.floor(F.sum("target").over(total) / block + 0.5)).withColumn("cap", F.floor(F.col("source_size") * most / block)).withColumn("g", F.lit(0))
    sources = materialize(sainte_lague(sources, ["g"], "target", "blocks", "cap", [F.col("source").asc_nulls_last()]).select("source", "source_size", "target", F.ceil(F.sqrt("documents")).cast("long").alias("shards"), F.col("quota").alias("source_quota")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    s = sources.select(F.col("source").alias("_s"), "source_size", "target", "shards")
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("place", F.xxhash64("doc_id", "text_digest", F.lit(seed))).withColumn("shard", F.pmod(F.col("place"), F.col("shards")))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    quota = sources.select(F.col("source").alias("_s"), "source_quota")
    shards = shards.join(quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("cap", F.floor(F.col("words") * most / block))
    shards = sainte_lague(shards, ["source"], "words", "source_quota", "cap", [F.col("shard")])
    shards = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "words", (F.col("quota") * block).alias("takes"))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    place = Window.partitionBy("source", "shard").orderBy(F.xxhash64("place", F.lit(seed + 1)), "doc_id", "text_digest").rowsBetween(Window.unboundedPreceding, 0)
    # On the circle of the shard's words, from the seeded start: whole rounds for all, and the arc of the last round.
    rows = rows.withColumn("end", F.sum("size").over(place)).withColumn("begin", F.col("end") - F.col("size"))
    turn = lambda x: F.pmod(F.col(x) - F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("words")), F.col("words"))
    arc = F.pmod(F.col("takes"), F.col("words"))
    b = turn("begin")
    first = F.greatest(F.lit(0), F.least(arc, b + F.col("size")) - b)
    wrapped = F.greatest(F.lit(0), F.least(arc, b + F.col("size") - F.col("words")))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("takes") / F.col("words")) * F.col("size") + first + wrapped)
    return rows.select("doc_id", "text_digest", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
