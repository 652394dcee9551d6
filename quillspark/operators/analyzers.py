"""Analyzers (words, subwords, letter pairs), the search engine over any of them, and how often it hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts, search, subwords

KINDS = ("word", "subword", "char")
NAMES = ("word", "subword(+</w>)", "subword", "char2")


class Analyzer:
    """terms() of a text table. `subword` learns its merges from a corpus (doc_id, text); `char` has n letters, blanks left out."""

    def __init__(self, kind: str, corpus: DataFrame | None = None, merges: int = 200, boundary: bool = False, n: int = 2, native: bool = False) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is none of {', '.join(KINDS)}")
        if kind == "subword" and corpus is None:
            raise ValueError("subwords are learned from a corpus")
        self.kind, self.n, self.native = kind, n, native
        if kind == "subword":
            words = corpus.select(F.explode(T.normalize(F.col("text"), native)).alias("term"))
            self.tokenizer = subwords.BPETokenizer(counts.frequencies(words), merges, boundary)

    def terms(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(doc_id, tokens) of (id_col, text)."""
        key = F.col(id_col).alias("doc_id")
        if self.kind == "char":
            return docs.select(key, T.folded_char_ngrams(F.col("text"), self.n, self.native).alias("tokens"))
        words = docs.select(key, T.normalize(F.col("text"), self.native).alias("tokens"))
        return self.tokenizer.encode(words) if self.kind == "subword" else words


def build_analyzers(corpus: DataFrame, merges: int = 200, native: bool = False, only: list[str] | None = None) -> dict[str, Analyzer]:
    """The registry that comparisons run over (or those of its names in `only`); both subword ones learn from the same corpus."""
    made = {
        "word": lambda: Analyzer("word", native=native),
        "subword(+</w>)": lambda: Analyzer("subword", corpus, merges, True, native=native),
        "subword": lambda: Analyzer("subword", corpus, merges, False, native=native),
        "char2": lambda: Analyzer("char", n=2, native=native),
    }
    return {name: made[name]() for name in NAMES if only is None or name in only}


class Engine:
    """TF-IDF cosine search over an analyzer's terms. texts: (doc_id, text); queries: (query_id, text)."""

    def __init__(self, texts: DataFrame, analyzer: Analyzer) -> None:
        self.analyzer = analyzer
        self.tokens = analyzer.terms(texts)
        self.index = search.SearchEngine(self.tokens)

    def __len__(self) -> int:
        return self.index.vocab.count()

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self.analyzer.terms(queries, "query_id").withColumnRenamed("doc_id", "query_id")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents with a common term; all others score 0."""
        return self.index.scores(self._asked(queries))

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        return self.index.search(self._asked(queries), k)

    def shared_terms(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query_id, doc_id, terms): the sorted terms that each pair (query_id, doc_id) has in common."""
        asked = self._asked(queries).select("query_id", F.array_distinct("tokens").alias("q"))
        return pairs.select("query_id", "doc_id").join(asked, "query_id").join(self.tokens, "doc_id").select("query_id", "doc_id", F.sort_array(F.array_intersect("q", "tokens")).alias("terms"))


def hit_rate(found: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: the share of cases (query_id, relevant array of doc_id) with a relevant document among those found (query_id, doc_id)."""
    x = cases.join(found.groupBy("query_id").agg(F.collect_set("doc_id").alias("got")), "query_id", "left")  # k a query
    return x.agg(F.coalesce(F.avg(F.coalesce(F.arrays_overlap("got", "relevant"), F.lit(False)).cast("double")), F.lit(0.0)).alias("hit_rate"))
