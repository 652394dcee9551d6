"""Exact top-k by inner product over a pivot-distance index.

Integer vectors are lifted by one coordinate, sqrt(M - |x|^2) with M the largest squared norm, and queries by 0: then
squared distance is |q|^2 + M - 2 score, so the highest scores are the nearest vectors and the triangle inequality holds.
Vectors are keyed by their nearest pivot and the distance to it. A query expands the sorted annuli of a cell from its own
distance on, and stops where |d(q, pivot) - d(x, pivot)| alone puts all the rest beyond its k-th best. Its own cell gives
the first bound; the other cells whose radii pass it are searched with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import materialize, ship


#: Squared lengths from which no inner product is certain to fit a long; below EXACT doubles hold every one.
MOST = float(1 << 62)
EXACT = float(1 << 52)


def whole_vectors(table: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) with floor(scale * x), x as double; without vectors that are null or hold null or non-finite components.

    Vectors whose scaled squared length is 2^62 or more are left out too, as their scores fit no long.
    """
    x = F.col(vec_col)
    ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))))
    return table.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), scaled.cast("array<long>").alias("vec")).where(_squared("vec") < MOST)


def _squared(vec: str) -> F.Column:
    return F.aggregate(vec, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def _matrix(vectors, dims: int, whole: bool = False) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64 if whole else float)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(1)))[:, None]])


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from the first row on: spread out, and the same for the same sample."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def expand(q: np.ndarray, q_dist: np.ndarray, bound: np.ndarray, x: np.ndarray, x_dist: np.ndarray, copies: np.ndarray, k: int, lift: np.ndarray, annulus: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the rows of x (sorted by x_dist) that can be among its k best: (query, row, score) and all with score >= bound.

    lift: what |q|^2 + M is for each query; a score s is at squared distance lift - 2 s. Annuli are taken by their distance from
    the query's own, nearest first; a query drops out when the triangle inequality leaves the rest below its k-th best score.
    """
    edges = list(range(0, len(x), annulus))
    low, high = x_dist[edges], x_dist[[min(e + annulus, len(x)) - 1 for e in edges]]
    gap = np.maximum(0.0, np.maximum(low[None, :] - q_dist[:, None], q_dist[:, None] - high[None, :]))
    gap = np.maximum(0.0, gap - 1e-6 * (1.0 + q_dist[:, None] + np.sqrt(lift[:, None])))
    most = np.floor((lift[:, None] - gap * gap) / 2 * (1 + 1e-9) + 1e-3)  # no score in the annulus is higher
    out_q, out_x, out_s = [], [], []
    order = np.argsort(-most, axis=1, kind="stable")
    bound = bound.copy()
    kept = [(np.zeros(0, q.dtype), np.zeros(0, np.int64)) for _ in range(len(q))]
    for turn in range(len(edges)):
        at = order[:, turn]
        live = np.flatnonzero(most[np.arange(len(q)), at] >= bound)
        if not len(live):
            break
        for a in np.unique(at[live]):
            rows = live[at[live] == a]
            e = edges[a]
            scores = q[rows] @ x[e : e + annulus].T
            for r, s in zip(rows, scores, strict=True):
                hit = np.flatnonzero(s >= bound[r])
                if not len(hit):
                    continue
                s_all, x_all = np.concatenate([kept[r][0], s[hit]]), np.concatenate([kept[r][1], hit + e])
                if copies[x_all].sum() > k:
                    best = np.argsort(-s_all, kind="stable")
                    reach = int(np.searchsorted(np.cumsum(copies[x_all[best]]), k)) if copies[x_all].sum() >= k else len(best) - 1
                    bound[r] = max(bound[r], s_all[best[reach]])
                    keep = s_all >= bound[r]
                    s_all, x_all = s_all[keep], x_all[keep]
                kept[r] = (s_all, x_all)
    for r, (s, i) in enumerate(kept):
        out_q.append(np.full(len(i), r))
        out_x.append(i)
        out_s.append(s)
    return np.concatenate(out_q).astype(np.int64), np.concatenate(out_x).astype(np.int64), np.concatenate(out_s)


def top_k(table: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, scale: int = 64, pivots: int = 32, sample: int = 2048, per_block: int = 4096, per_queries: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k highest integer inner products with all other rows.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, nor do rows
    with a null id; shorter vectors count as ending in zeros. Rows with equal ids are one row as a query's own: all are left
    out. Equal vectors are searched once with their k + 1 smallest ids, which is all a result can use. The pivots are chosen
    from at most `sample` distinct vectors (they shape the index, not the result); every row is indexed. No rows give none.
    """
    spark = table.sparkSession
    ship(spark)
    rows = materialize(whole_vectors(table, scale, id_col, vec_col))
    facts = rows.agg(F.max(F.size("vec")), F.max(_squared("vec"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if facts[0] is None:
        return spark.createDataFrame([], schema)
    dims, largest = max(1, facts[0]), float(facts[1])
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    distinct = materialize(distinct.withColumn("h", F.xxhash64("vec")))
    first = _matrix([r[0] for r in distinct.orderBy("h", "vec").select("vec").limit(sample).collect()], dims)
    centres = choose_pivots(_lift(first, largest), pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _lift(_matrix(b["vec"], dims), largest)
            d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T))
            b["pivot"] = d.argmin(1).astype(np.int32)
            b["dist"] = d.min(1)
            yield b[["vec", "ids", "h", "pivot", "dist"]]

    index = materialize(distinct.mapInPandas(nearest, "vec array<long>, ids array<long>, h long, pivot int, dist double"))
    cells = {r[0]: (r[1], r[2], r[3]) for r in index.groupBy("pivot").agg(F.count(F.lit(1)), F.min("dist"), F.max("dist")).collect()}  # a row a pivot
    blocks = {p: -(-n // per_block) for p, (n, _, _) in cells.items()}
    salt = F.element_at(F.create_map(*[F.lit(v) for p, n in blocks.items() for v in (p, n)]), F.col("pivot"))
    index = index.withColumn("block", F.pmod("h", salt).cast("int"))
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    # Queries are cut into parts too, so that a task holds per_queries of them and per_block vectors, whatever the table.
    parts = max(1, -(-asked.count() // per_queries))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")

    def routed(own: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                q = _matrix(b["vec"], dims)
                lift = (q * q).sum(1) + largest
                flat = np.hstack([q, np.zeros((len(q), 1))])
                d = np.sqrt(np.maximum(0.0, (flat * flat).sum(1)[:, None] + (centres * centres).sum(1) - 2 * flat @ centres.T))
                held = np.array(sorted(cells))
                home = held[d[:, held].argmin(1)]
                parts = []
                for p, (_, low, high) in cells.items():
                    gap = np.maximum(0.0, np.maximum(low - d[:, p], d[:, p] - high) - 1e-6 * (1 + d[:, p] + np.sqrt(lift)))
                    go = home == p if own else (home != p) & (np.floor((lift - gap * gap) / 2 * (1 + 1e-9) + 1e-3) >= b["bound"].to_numpy())
                    for block in range(blocks[p]):
                        part = b[go]
                        parts.append(pd.DataFrame({"pivot": np.int32(p), "block": np.int32(block), "query_id": part["query_id"], "q_vec": part["vec"], "q_dist": d[go, p], "bound": part["bound"] if "bound" in b else -np.inf}))
                yield pd.concat(parts) if parts else b.iloc[:0]

        return run

    to = "pivot int, block int, query_id long, q_vec array<long>, q_dist double, bound double"

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("dist", kind="stable").reset_index(drop=True)
        # Beyond what doubles hold exactly, scores are computed in whole numbers.
        x, q = _matrix(right["vec"], dims, largest >= EXACT), _matrix(left["q_vec"], dims, largest >= EXACT)
        copies = np.array([len(i) for i in right["ids"]])
        lift = (q.astype(float) ** 2).sum(1) + largest
        # k + 1 as a query's own row is among the rows.
        a, b, s = expand(q, left["q_dist"].to_numpy(), left["bound"].to_numpy(), x, right["dist"].to_numpy(), copies, k + 1, lift)
        ids = right["ids"].to_numpy()
        names = left["query_id"].to_numpy()
        n = copies[b]
        out = pd.DataFrame({"query_id": np.repeat(names[a], n), "vec_id": np.concatenate([np.asarray(ids[i], np.int64) for i in b]) if len(b) else np.zeros(0, np.int64), "score": np.repeat(s, n).astype(np.int64)})
        out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return out.groupby("query_id").head(k)

    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = "query_id long, vec_id long, score long"
    by_block = index.select("pivot", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec", "ids", "dist").groupBy("pivot", "block", "part")
    home = asked.mapInPandas(routed(True), to).select("*", part)
    own = materialize(home.groupBy("pivot", "block", "part").cogroup(by_block).applyInPandas(search, found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
    bound = own.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    rest = asked.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).mapInPandas(routed(False), to).select("*", part)
    others = rest.groupBy("pivot", "block", "part").cogroup(by_block).applyInPandas(search, found)
    both = own.drop("rank").unionByName(others).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
