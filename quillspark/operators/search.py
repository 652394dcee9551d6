"""Lexical retrieval over an inverted index: cosine of TF-IDF vectors, boolean matching, explanations, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts
from quillspark.runtime import materialize, small_side


class SearchEngine:
    """Fit once on tokens (doc_id, tokens), ask often. Queries are tables (query_id, tokens), so many are one job."""

    def __init__(self, tokens: DataFrame, min_df: int = 1, max_df: float = 1.0) -> None:
        self.documents = tokens.select("doc_id")
        self.n = tokens.count()
        # Written once: texts are not tokenized again for each question.
        self.index = materialize(counts.postings(tokens))  # of all terms, also those the vocabulary leaves out
        self.vocab = materialize(counts.vocabulary(self.index, self.n, min_df, max_df))
        weights = counts.weights(self.index, self.vocab, self.n)
        self.weights = materialize(weights.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))))

    def query_weights(self, queries: DataFrame) -> DataFrame:
        own = counts.postings(queries.withColumnRenamed("query_id", "doc_id"))
        w = counts.weights(own, self.vocab, self.n).select(F.col("doc_id").alias("query_id"), "term", F.col("w").alias("qw"))
        return w.withColumn("qnorm", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id"))))

    def contributions(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, term, part): what each shared term adds to a score."""
        x = self.weights.join(small_side(materialize(self.query_weights(queries)), 200_000), "term")
        return x.select("query_id", "doc_id", "term", (F.col("w") * F.col("qw") / (F.col("norm") * F.col("qnorm"))).alias("part"))

    def scores(self, queries: DataFrame) -> DataFrame:
        return self.contributions(queries).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best with a score above 0."""
        if k < 0:
            raise ValueError("k must not be negative")
        return best(self.scores(queries).where("score > 0"), k)

    def rank_documents(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The k best, with documents of score 0 (smallest ids first) where fewer score; all documents without k."""
        scored = self.scores(queries).where("score > 0")
        if k is None:
            every = self.documents.crossJoin(small_side(materialize(queries.select("query_id")), 20_000)).join(scored, ["query_id", "doc_id"], "left")
            return best(every.withColumn("score", F.coalesce("score", F.lit(0.0))), None)
        found = best(scored, k).drop("rank")
        has = queries.select("query_id").join(found.groupBy("query_id").agg(F.collect_set("doc_id").alias("has")), "query_id", "left").where("has is null or size(has) < %d" % k)  # fewer than k
        first = self.documents.orderBy("doc_id").limit(2 * k)  # k of these are not among the fewer than k
        zeros = has.crossJoin(F.broadcast(first)).where("has is null or not array_contains(has, doc_id)").select("query_id", "doc_id", F.lit(0.0).alias("score"))
        return best(found.unionByName(zeros), k)

    def candidates(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query_id", F.explode(T.held("tokens")).alias("term")).distinct()
        return self.index.join(terms, "term").select("query_id", "doc_id").distinct()

    def boolean_and(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query_id", F.explode(T.held("tokens")).alias("term")).distinct()
        need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        return self.index.join(terms, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("has")).join(need, "query_id").where("has = need").select("query_id", "doc_id")


def best(scores: DataFrame, k: int | None) -> DataFrame:
    x = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return x if k is None else x.where(F.col("rank") <= k)


def min_max(scores: DataFrame, column: str = "score") -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scores.withColumn(column, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0))


def reciprocal_rank_fusion(rankings: list[DataFrame], k: float = 60.0) -> DataFrame:
    """rankings: tables (query_id, doc_id, rank)."""
    if k <= 0:
        raise ValueError("k must be positive")
    x = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        x = x.unionByName(other.select("query_id", "doc_id", "rank"))
    return x.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score"))
