"""Frequencies, ranks, Zipf statistics, vocabularies and term weights over long tables.

tokens: (doc_id, tokens array); long: (doc_id, pos, term); postings: (doc_id, term, tf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.runtime import placed


def long(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.posexplode(T.held("tokens")).alias("pos", "term"))


def frequencies(items: DataFrame, item: str = "term") -> DataFrame:
    return items.groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def ranked(freqs: DataFrame, item: str = "term") -> DataFrame:
    """With rank by count, then item, from 1."""
    return placed(freqs, F.desc("n"), F.col(item)).withColumn("rank", (F.col("place") + 1).cast("int")).drop("place")


def top(freqs: DataFrame, k: int, item: str = "term") -> DataFrame:
    if k < 0:
        raise ValueError("k must not be negative")
    return freqs.orderBy(F.desc("n"), item).limit(k)


def hapaxes(freqs: DataFrame) -> DataFrame:
    return freqs.where("n = 1")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def type_token_ratio(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", share(F.size(F.array_distinct("tokens")), F.size("tokens")).alias("ttr"))


def coverage(freqs: DataFrame, ks: list[int], item: str = "term") -> DataFrame:
    x = ranked(freqs, item)
    sums = x.agg(*(share(F.sum(F.when(F.col("rank") <= k, F.col("n"))), F.sum("n")).alias(str(k)) for k in ks))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.round(F.col(str(k)), 6).alias("coverage")) for k in ks))).alias("x")).select("x.*")


def zipf_table(freqs: DataFrame, k: int) -> DataFrame:
    best = freqs.agg(F.max("n").alias("most"))
    return ranked(top(freqs, k)).crossJoin(F.broadcast(best)).select("rank", "term", "n", F.round(F.col("most") / F.col("rank"), 6).alias("expected"))


def zipf_exponent(freqs: DataFrame, max_rank: int | None = None) -> DataFrame:
    if max_rank is not None and max_rank < 2:
        raise ValueError("max_rank must be at least 2")
    x = ranked(freqs)
    x = x if max_rank is None else x.where(F.col("rank") <= max_rank)
    if x.limit(2).count() < 2:
        raise ValueError("a slope needs two types")
    return x.agg((-F.regr_slope(F.ln("n"), F.ln("rank"))).alias("exponent"))


def sparsity(freqs: DataFrame) -> DataFrame:
    return freqs.agg(F.coalesce(F.avg((F.col("n") == 1).cast("double")), F.lit(0.0)).alias("sparsity"))


def postings(tokens: DataFrame) -> DataFrame:
    """The inverted index: how often each document holds each term."""
    return tokens.select("doc_id", F.explode(T.held("tokens")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(index: DataFrame, documents: int, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    if min_df < 1:
        raise ValueError("min_df must be at least 1")
    if not 0 < max_df <= 1:
        raise ValueError("max_df must be in (0, 1]")
    kept = document_frequencies(index).where((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    return kept


def numbered(vocab: DataFrame) -> DataFrame:
    """idx by alphabet from 0; only dense vectors need it."""
    return placed(vocab, "term", name="idx").withColumn("idx", F.col("idx").cast("int"))


def tf(scheme: str, count: Column, total: Column) -> Column:
    forms = {"raw": count.cast("double"), "relative": share(count, total), "log": F.when(count > 0, 1 + F.ln(count)).otherwise(0.0), "boolean": (count > 0).cast("double")}
    if scheme not in forms:
        raise ValueError(f"unknown scheme {scheme!r}")
    return forms[scheme]


def idf(scheme: str, df: Column, documents: Column) -> Column:
    forms = {"smooth": F.ln((1 + documents) / (1 + df)) + 1, "classic": F.ln(documents / df), "probabilistic": F.ln((documents - df) / df)}
    if scheme not in forms:
        raise ValueError(f"unknown scheme {scheme!r}")
    return forms[scheme]


def weights(index: DataFrame, vocab: DataFrame, documents: int, tf_scheme: str = "relative", idf_scheme: str = "smooth") -> DataFrame:
    """(doc_id, term, w): relative frequencies are of the words the vocabulary has."""
    x = index.join(vocab, "term").withColumn("total", F.sum("tf").over(Window.partitionBy("doc_id")))
    return x.select("doc_id", "term", (tf(tf_scheme, F.col("tf"), F.col("total")) * idf(idf_scheme, F.col("df"), F.lit(documents))).alias("w"))


def checked_idf(scheme: str, index: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """(term, idf) of a vocabulary (term), also of terms no document has. ValueError where a scheme is not defined for a term."""
    x = terms.select("term").join(document_frequencies(index), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    low, high = x.agg(F.min("df"), F.max("df")).first()
    if scheme in ("classic", "probabilistic") and low == 0:
        raise ValueError(f"{scheme} idf has no value for a term that no document has")
    if scheme == "probabilistic" and high == documents:
        raise ValueError("probabilistic idf has no value for a term that every document has")
    return x.select("term", idf(scheme, F.col("df"), F.lit(documents)).alias("idf"))


def top_terms(weights: DataFrame, vocab: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, term, w, rank): each document's k highest weights, ties by term; where it has fewer terms, the first of the rest at 0."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("w"), "term")
    own = weights.select("doc_id", "term", F.round("w", 6).alias("w"))
    best = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    short = best.groupBy("doc_id").agg(F.collect_set("term").alias("has")).where(F.size("has") < k)  # fewer than k
    fill = vocab.select("term").orderBy("term").limit(2 * k)  # k of these are not among the fewer than k it has
    zeros = short.crossJoin(F.broadcast(fill)).where(~F.array_contains("has", F.col("term"))).select("doc_id", "term", F.lit(0.0).alias("w"))
    return best.select("doc_id", "term", "w").unionByName(zeros).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def to_sparse(vector: Column) -> Column:
    """A dense array as a map of the places (from 0) that are not zero."""
    pairs = F.transform(vector, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] != 0))


def vocabulary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The terms (term) of a that b has not, each once."""
    return a.select("term").distinct().join(b.select("term"), "term", "left_anti")


def oov_rate(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    known = long(tokens).join(vocab.select("term", F.lit(1).alias("known")), "term", "left").groupBy("doc_id").agg(F.avg(F.col("known").isNull().cast("double")).alias("oov_rate"))
    return tokens.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("oov_rate", F.lit(0.0)).alias("oov_rate"))
