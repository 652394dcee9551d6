"""Packing token sequences: best-fit decreasing in partitions, certified by lower bounds, with exchange and repacking.

1. Texts longer than `size` tokens are cut from their end, so that only the first piece can be short; full pieces fill a
   sequence each. The others are dealt to partitions of about `per_part` pieces by a hash.
2. Each partition packs best-fit decreasing. A lower bound from dual feasible functions certifies its number of sequences.
3. Partitions with a gap give up the pieces of all sequences that are not full, certified ones those of their emptiest. In
   the next round the given pieces of up to `merge` partitions meet and are packed again; the old packing stays if it needs
   no more sequences. After `rounds` rounds a task holds at most per_part * merge^(rounds - 1) short pieces: ids and lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.prefix_bpe import held
from quillspark.llm.words import byte_rows, list_array
from quillspark.runtime import materialize, ship


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, piece, start, length, ids_crc32[, token_ids]) of every text, null as empty, with end_id at its end."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(tokenizer)
        for part, texts in byte_rows(batches, text_col):
            at, pieces, starts, lengths, sums, keys, tokens = [], [], [], [], [], [], []
            for i, t in enumerate(texts):
                found = np.append(bpe.ids_of(t.decode()) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                first = len(found) % size or size
                key = zlib.crc32(t or b"")
                for k, start in enumerate([0, *range(first, len(found), size)]):
                    own = found[start : start + size] if k else found[:first]
                    at.append(i)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(len(own))
                    sums.append(zlib.crc32(own.tobytes()))
                    keys.append(key)
                    if ids:
                        tokens.append(own.astype(np.int64))
            arrays = [part.column(part.schema.get_field_index(id_col)).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, list_array(tokens, pa.int64())] if ids else arrays, names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "token_ids"][: 6 + ids])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long" + ", token_ids array<long>" * ids)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most that dual feasible functions prove: no packing of these lengths has fewer bins.

    f_t (t up to size / 2) counts pieces above size - t as whole bins and drops those below t; u_k rounds (k + 1) x / size
    down unless it is whole. Both keep any bin's sum within one bin, so the sum over all pieces bounds the number of bins.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    x = np.arange(size + 1)
    mass = count * x
    best = -(-int(mass.sum()) // size)
    up_to, mass_to = np.cumsum(count), np.cumsum(mass)
    t = np.arange(1, size // 2 + 1)
    whole = up_to[size] - up_to[size - t]
    middle = mass_to[size - t] - mass_to[t - 1]
    best = max(best, int((whole + -(-middle // size)).max()))
    for k in range(1, 20):
        scaled = (k + 1) * x
        u = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # u_k(x) * k * size, so a bin is k * size
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, space left in each bin)."""
    bins, left, free, mask = np.zeros(len(lengths), np.int64), [], [[] for _ in range(size + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if above := mask >> n:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(left), size
            left.append(size)
        bins[i] = b
        left[b] = room - n
        free[room - n].append(b)
        mask |= 1 << (room - n)
    return bins, np.array(left, np.int64)


def _pack_group(size: int, round_: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "row_key", "piece", "part_id"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins, left = best_fit_decreasing(lengths, size)
        if round_:
            old = rows["bin"].to_numpy()
            names, was = np.unique(old, return_inverse=True)
            if len(names) <= len(left):  # nothing gained
                bins, left = was, size - np.bincount(was, weights=lengths, minlength=len(names)).astype(np.int64)
        gap = len(left) - lower_bound(lengths, size)
        give = left > 0 if gap > 0 else (np.arange(len(left)) == int(left.argmax())) & (left > 0)
        rows["bin"] = (int(key[0]) << 24) + bins + (round_ << 58)
        rows["given"] = give[bins]
        rows["gap"] = gap
        return rows

    return run


def pack(pieces: DataFrame, size: int = 1024, per_part: int = 2048, merge: int = 4, rounds: int = 4) -> DataFrame:
    """`pieces` (doc_id, row_key, piece, length and any other columns) with sequence_id and offset added, one row per row.

    Lengths are from 1 to size. Equal rows are packed like others; no rows give no rows. Offsets run from 0 without gaps.
    """
    pieces = materialize(pieces.withColumn("part_id", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == size)
    short = pieces.where(F.col("length") < size).select("doc_id", "row_key", "piece", "length", "part_id")
    parts = max(1, -(-short.count() // per_part))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, piece int, length long, part_id long, grp long, bin long, given boolean, gap long"
    turn = short.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row_key", "piece", "part_id"), F.lit(parts))).withColumn("bin", F.lit(0).cast("long")).withColumn("given", F.lit(True)).withColumn("gap", F.lit(0).cast("long"))
    done = []
    for r in range(rounds):
        packed = materialize(turn.groupBy("grp").applyInPandas(_pack_group(size, r), schema))
        if r == rounds - 1 or parts == 1:
            done.append(packed)
            break
        done.append(packed.where(~F.col("given")))
        parts = -(-parts // merge)
        turn = packed.where("given").withColumn("grp", F.floor(F.col("grp") / merge))
    short_bins = done[0]
    for x in done[1:]:
        short_bins = short_bins.unionByName(x)
    short_bins = short_bins.select("part_id", F.col("bin").alias("sequence_id"))
    placed = pieces.where(F.col("length") < size).join(short_bins, "part_id")
    from pyspark.sql import Window

    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
    whole = full.withColumn("sequence_id", -1 - F.col("part_id")).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(whole).drop("part_id", "row_key")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, ids: bool = False) -> DataFrame:
    """token_pieces() of `docs`, packed: doc_id, piece, start, length, ids_crc32[, token_ids], sequence_id, offset.

    A null or empty text is the end token alone. Repeated rows and equal or null ids are documents like others.
    """
    return pack(token_pieces(docs, tokenizer, end_id, size, ids), size)
