"""Exact n-gram Jaccard join by vertical partitioning of the global n-gram order.

1. Shingles (64-bit hashes of n words) have one global order: those found often last, by how often, each kind by hash.
2. Prefix filtering on that order finds candidates: two sets that link share a shingle among the first few
   of both, at positions that leave room for the overlap they need.
3. A bucket (one shingle) does not emit all its pairs. Its members are checked against two central ones;
   linked members form components, and only pairs of different components and near sizes are checked after that. A bucket
   of more than HOT members is cut before: as sets that link share two shingles of prefixes one longer, its members meet
   anew in buckets of the shingle and a second one. So all links between components are found, which is all that
   grouping needs.
4. Before their sets are fetched, pairs must pass a parity check: two bits or more a shingle, each the parity of the set's
   shingles that fall on it. A shingle that only one of two sets has flips one bit, so sets differ in no fewer shingles than bits.
5. Checking is vertical: the order is cut into FRAGMENTS ranges, each pair's overlap is counted in each
   fragment on its own, and the partial counts are summed per pair.

Texts with equal shingle sets are one class, checked once, whatever the number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import connected_components
from quillspark.llm.words import hashed_texts, list_array, shingle_set, signed
from quillspark.runtime import materialize, ship, small_side

#: Vertical cuts of the global order: seven hash ranges of the shingles that are not frequent, then the frequent ones.
FRAGMENTS = 8
#: Words of a run in which frequent shingles are counted before they are summed over all runs.
RUN = 4_000_000
#: A bucket with more members is cut by second shingles before pairs of its components are made.
HOT = 4096
#: At most so many frequent shingles are moved to the end of the order (they are broadcast: 16 bytes each).
#: The bound only changes how well candidates are filtered, never which links are found.
MOST_FREQUENT = 1 << 18


def _class(s: np.ndarray) -> int:
    """64 bits that stand for a shingle set (an accidental match among 10^9 sets has a chance of 3 %)."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def _parity(s: np.ndarray, fixed: bool) -> np.ndarray:
    """At least two bits a shingle and 512 in all, a power of two, so that a longer one folds to a shorter by XOR of its halves.

    fixed: 512 bits, for thresholds so low that linked sets can be more than twice as long as each other.
    """
    m = 512 if fixed else max(512, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).view(np.int64)


def _weights(s: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each shingle of a set was found, 0 for those that are not frequent."""
    if not len(often):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    return np.where(often[at] == s, counts[at], 0)


def _need(a: str, b: str, num: int, den: int) -> F.Column:
    """The least overlap with which sets of sizes a and b link, as a SQL expression."""
    return F.expr(f"({num} * ({a} + {b}) + {num + den - 1}) div {num + den}")


def frequent_shingles(docs: DataFrame, n: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles counted at least 16 times, by counts within runs of RUN words (2 at least) summed over all."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, found = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
        twice = found >= 2
        return pa.RecordBatch.from_arrays([pa.array(signed(keys[twice])), pa.array(found[twice].astype(np.int64))], names=["key", "found"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in hashed_texts(batches, text_col):
            held += [shingle_set(h, n) for h in texts]
            size += sum(map(len, texts))
            if size >= RUN:
                yield often(held)
                held, size = [], 0
        yield often(held)

    total = materialize(docs.select(text_col).mapInArrow(counts, "key long, found long").groupBy("key").agg(F.sum("found").alias("found")).where("found >= 16"))
    by_size = sorted(((r[0], r[1]) for r in total.groupBy(F.expr("cast(floor(log2(found)) as int)")).count().collect()), reverse=True)
    kept, least = 0, 62
    for power, number in by_size:
        if kept + number > MOST_FREQUENT:
            break
        kept, least = kept + number, power
    rows = total.where(F.col("found") >= F.lit(1 << least)).toPandas().sort_values("key")
    keys, found = rows["key"].to_numpy(np.int64).view(np.uint64), rows["found"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], found[order]


def _prefixes(docs: DataFrame, held, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """id, cls, n_shingles, keys, bits: the set's prefix in the global order and one shingle more; empty if this task gave the class before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        often, counts = held.value
        for part, texts in hashed_texts(batches, text_col):
            classes, sizes, prefixes, bits = [], [], [], []
            for s in (shingle_set(h, n) for h in texts):
                c, size = _class(s), len(s)
                classes.append(c)
                sizes.append(size)
                if not size or c in seen:
                    prefixes.append(s[:0])
                    bits.append(s[:0].view(np.int64))
                    continue
                bits.append(_parity(s, 2 * num < den))
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(c)
                least = -(-num * size // den)
                length = size - -(-num * (size + least) // (num + den)) + 2
                s = s[np.argsort(_weights(s, often, counts), kind="stable")[:length]]
                prefixes.append(s)
            arrays = [part.column(part.schema.get_field_index(id_col)), pa.array(signed(np.array(classes, np.uint64))), pa.array(sizes, pa.int64()), list_array([signed(p) for p in prefixes], pa.int64()), list_array(bits, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "cls", "n_shingles", "keys", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, cls long, n_shingles long, keys array<long>, bits array<long>"))


def _fragment_sets(docs: DataFrame, held, table: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, size, fragment, part) of the wanted classes, from the text of one document of each."""
    ids = table.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("wanted_id")).select("wanted_id").distinct()
    ids = small_side(materialize(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.arange(1, FRAGMENTS - 1, dtype=np.uint64) * np.uint64((1 << 64) // (FRAGMENTS - 1))
        for _, texts in hashed_texts(batches, text_col):
            classes, sizes, fragments, parts = [], [], [], []
            for s in (shingle_set(h, n) for h in texts):
                rare = _weights(s, *held.value) == 0
                own = s[rare]
                for f, part in enumerate([*np.split(own, np.searchsorted(own, cuts)), s[~rare]]):
                    if len(part):
                        classes.append(_class(s))
                        sizes.append(len(s))
                        fragments.append(f)
                        parts.append(signed(part))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(classes, np.uint64))), pa.array(sizes, pa.int64()), pa.array(fragments, pa.int32()), list_array(parts, pa.int64())], names=["cls", "size", "fragment", "part"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col)).join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    parts = texts.select(text_col).mapInArrow(run, "cls long, size long, fragment int, part array<long>")
    parts = materialize(parts.join(small_side(wanted), "cls", "left_semi"))
    if parts.count() == parts.select("cls", "fragment").distinct().count():
        return parts
    # Rows of one id and text: each part once.
    return materialize(parts.groupBy("cls", "fragment").agg(F.first("size").alias("size"), F.first("part").alias("part")))


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of `pairs` whose overlap, summed over the fragments, is enough."""
    a = sets.select(F.col("cls").alias("a"), "fragment", F.col("size").alias("a_size"), F.col("part").alias("a_part"))
    b = sets.select(F.col("cls").alias("b"), "fragment", F.col("size").alias("b_size"), F.col("part").alias("b_part"))
    # Both joins are keyed alike, so the sets are dealt out once.
    cut = pairs.select("a", "b", F.explode(F.expr(f"sequence(0, {FRAGMENTS - 1})")).alias("fragment"))
    shared = cut.join(a, ["a", "fragment"]).join(b, ["b", "fragment"]).select("a", "b", "a_size", "b_size", F.size(F.array_intersect("a_part", "b_part")).cast("long").alias("shared"))
    return shared.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size")).where(F.col("shared") >= _need("a_size", "b_size", num, den)).select("a", "b")


def _near(den: int, num: int) -> F.Column:
    return (F.col("cls") != F.col("p_cls")) & (den * F.least("size", "p_size") >= num * F.greatest("size", "p_size"))


def _room(num: int, den: int) -> F.Column:
    return 1 + F.least(F.expr("size - pos"), F.expr("p_size - p_pos")) >= _need("size", "p_size", num, den)


def _pairs(x: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b) from rows with two members of near sizes that pass the parity check."""
    pairs = x.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b"), (F.col("size") + F.col("p_size") - 2 * _need("size", "p_size", num, den)).alias("most")).distinct()
    a, b = (bits.select(F.col("cls").alias(c), F.col("bits").alias(f"{c}_bits")) for c in "ab")
    # As sizes are near, one is at most a power of two longer; it is folded to the shorter.
    fold = lambda long, short: F.when(F.size(long) > F.size(short), F.zip_with(F.slice(long, F.lit(1), F.size(short)), F.slice(long, F.size(short) + 1, F.size(short)), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(long))
    bit = F.zip_with(fold("a_bits", "b_bits"), fold("b_bits", "a_bits"), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    apart = F.aggregate(bit, F.lit(0), lambda s, v: s + v)
    return pairs.join(a, "a").join(b, "b").where(apart <= F.col("most")).select("a", "b")


def _across(tagged: DataFrame, bucket: list[str], num: int, den: int) -> DataFrame:
    """Rows with two members of near sizes of a bucket that lie in different components. Sizes within den / num of each other
    are in the same band or in neighbouring ones, so members meet by bucket and band only."""
    band = F.floor(F.log("size") / math.log(den / num + 1e-9)).cast("int") if num < den else F.col("size").cast("int")
    x = tagged.withColumn("band", band)
    other = x.select(*bucket, "band", *(F.col(c).alias(f"p_{c}") for c in ("cls", "size", "pos", "comp")))
    mine = x.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    # Of a pair in one band both orders come; of one in neighbouring bands, the lower member reaches up.
    return mine.join(other, [*bucket, "band"]).where((F.col("comp") != F.col("p_comp")) & _near(den, num))


def ngram_jaccard(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: id_col, class_id, n_shingles, component_id.

    Sets of lower-cased n-word shingles link when den * intersection >= num * union. component_id is the
    smallest id reachable by links (its own included). Rows whose set is empty (null, empty or blank text)
    are alone: class_id 0, component_id their own id. A text of fewer than n words is one shingle. Repeated
    rows and equal ids are rows like others; a null id never becomes a component_id unless all are null.
    A text is read whole, however long: its task holds its words and 8 bytes a shingle. An empty table gives no rows.
    Other columns of `docs` are not read.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must be in (0, 1]")
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n, text_col))
    table = _prefixes(docs, held, n, num, den, id_col, text_col)
    rows = table.where(F.size("keys") > 0).select(F.col("cls"), F.col("n_shingles").alias("size"), F.posexplode("keys").alias("pos", "key"), F.size("keys").alias("last")).select("key", "cls", "size", (F.col("pos") + 1).cast("int").alias("pos"), (F.col("pos") + 1 == F.col("last")).alias("extra"))
    # The shingle beyond a prefix serves only to cut hot buckets; a set shorter than that has it in its prefix.
    prefix = rows.where(~F.col("extra") | (F.col("pos") == F.col("size"))).drop("extra")
    w = Window.partitionBy("key")
    met = prefix.withColumn("low", F.min("cls").over(w)).withColumn("high", F.max("cls").over(w)).where("low < high")
    members = materialize(met.groupBy("key", "cls").agg(F.first("size").alias("size"), F.first("pos").alias("pos")))
    bits = materialize(table.where(F.size("bits") > 0).groupBy("cls").agg(F.first("bits").alias("bits")))

    row = F.struct(F.col("cls").alias("p_cls"), F.col("size").alias("p_size"), F.col("pos").alias("p_pos"))
    chance = F.xxhash64("key", "cls")
    central = members.groupBy("key").agg(F.min_by(row, F.struct(F.col("pos"), chance)).alias("p1"), F.min_by(row, chance).alias("p2")).select("key", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("p")).select("key", "p.*")
    first = materialize(_pairs(members.join(central, "key").where(_near(den, num) & _room(num, den)), bits, num, den))

    def check(pairs: DataFrame) -> DataFrame:
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        return materialize(_links(pairs, _fragment_sets(docs, held, table, wanted, n, id_col, text_col), num, den))

    links = check(first)
    comps = connected_components(links)

    tagged = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    apart = tagged.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).withColumn("members", F.count(F.lit(1)).over(w)).where("low < high").drop("low", "high")
    apart = materialize(apart)
    few = _across(apart.where(F.col("members") <= hot).drop("members"), ["key"], num, den).where(_room(num, den))
    second = _pairs(few, bits, num, den)
    crowded = apart.where(F.col("members") > hot).drop("members")
    if not crowded.isEmpty():
        seconds = table.where(F.size("keys") > 0).groupBy("cls").agg(F.first("keys").alias("keys")).join(crowded.select("cls").distinct(), "cls", "left_semi")
        cut = crowded.join(seconds, "cls").select("key", "cls", "size", "pos", "comp", F.explode("keys").alias("other")).where("other <> key")
        cut = cut.select(F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"), "cls", "size", "pos", "comp")
        both = Window.partitionBy("key", "other")
        cut = cut.withColumn("low", F.min("comp").over(both)).withColumn("high", F.max("comp").over(both)).where("low < high").drop("low", "high").distinct()
        second = second.unionByName(_pairs(_across(cut, ["key", "other"], num, den), bits, num, den)).distinct()
    second = materialize(second.join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = check(second)
        if not more.isEmpty():
            comps = connected_components(links.unionByName(more))

    named = table.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.where("n_shingles > 0").groupBy("comp").agg(F.min("id").alias("least"))
    return named.join(least, "comp", "left").select(F.col("id").alias(id_col), F.col("cls").alias("class_id"), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))
