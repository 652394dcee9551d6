import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts as C
from quillspark.operators import models as M
from quillspark.operators import search as S
from quillspark.operators import subwords as B


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()[0]


@pytest.mark.parametrize("text, words", [("", []), ("Don’t stop", ["Don't", "stop"]), ("a_b c'd'e!", ["a_b", "c'd", "'", "e", "!"]), ("한국어 문서", ["한국어", "문서"])])
def test_words(spark, text, words):
    assert one(spark, text, T.tokenize_words) == words


def test_normalize(spark):
    assert one(spark, "Straße É ! _", T.normalize) == ["strasse", "é"]
    assert one(spark, "한", T.normalize) == ["한"]
    assert one(spark, "Café the end", lambda t: T.normalize_full(t, accents=True)) == ["cafe", "end"]
    assert one(spark, " One. Two?  Three", T.split_sentences) == ["One.", "Two?", "Three"]
    assert one(spark, "  a\t b ", T.normalize_whitespace) == "a b"


def test_ngrams(spark):
    assert one(spark, "a b c", lambda t: T.ngrams(T.tokenize_whitespace(t), 2)) == [["a", "b"], ["b", "c"]]
    assert one(spark, "a", lambda t: T.ngrams(T.tokenize_whitespace(t), 2)) == []
    assert one(spark, "ab", lambda t: T.char_ngrams(t, 3)) == []
    with pytest.raises(ValueError):
        T.ngrams(F.col("x"), 0)
    with pytest.raises(TypeError):
        T.ngrams(F.col("x"), True)


def test_char_ngrams_count_code_points(spark):
    """Each window is found on one walk, so that a text of 400,000 letters is no matter of hours; windows cut no code point in two."""
    assert one(spark, "a😀b\n😁😂", lambda t: T.char_ngrams(t, 2, native=True)) == ["a😀", "😀b", "b\n", "\n😁", "😁😂"]
    assert one(spark, None, lambda t: T.char_ngrams(t, 2, native=True)) == []
    began = time.monotonic()
    text = spark.range(1).select(F.repeat(F.lit("abcdefgh"), 50_000).alias("text"))
    assert text.select(F.size(T.char_ngrams(F.col("text"), 3, native=True))).first()[0] == 399_998
    assert time.monotonic() - began < 10


def test_words_are_cut_once(spark, tmp_path):
    """A bare column would be cut into words in a filter too, and in it twice."""
    spark.createDataFrame([(1, "a_b __ c"), (2, None), (3, "")], "doc_id int, text string").write.parquet(f"{tmp_path}/d")
    x = spark.read.parquet(f"{tmp_path}/d").select("doc_id", T.normalize(F.col("text"), native=True).alias("tokens"))
    index = C.postings(x)
    assert "Filter" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in index.collect()} == {(1, "a_b", 1), (1, "c", 1)}


def docs(spark, *texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id int, tokens array<string>")


def test_search_and_boolean(spark):
    e = S.SearchEngine(docs(spark, "soup salt soup", "salt bread", "stone", ""))
    q = spark.createDataFrame([(0, ["soup"]), (1, ["salt", "bread"]), (2, []), (3, ["nothing"])], "query_id int, tokens array<string>")
    assert [(r.query_id, r.doc_id) for r in e.search(q, 1).orderBy("query_id").collect()] == [(0, 0), (1, 1)]
    assert e.rank_documents(q, 2).where("query_id = 3").count() == 2
    assert sorted((r.query_id, r.doc_id) for r in e.boolean_and(q).collect()) == [(0, 0), (1, 1)]
    total = e.contributions(q).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("s")).exceptAll(e.scores(q))
    assert total.count() == 0
    with pytest.raises(ValueError):
        C.vocabulary(e.index, 4, min_df=0)


def test_naive_bayes_priors_are_not_smoothed(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("a", ["y"]), ("b", ["z"])], "label string, tokens array<string>")
    got = {r.label: r.p for r in M.NaiveBayes(rows).proba(docs(spark, "")).collect()}
    assert got["a"] == pytest.approx(2 / 3)
    assert M.NaiveBayes(rows).predict(docs(spark, "z z")).first().label == "b"


def test_language_model(spark):
    m = M.NgramModel(docs(spark, "a b", "a c"), 2, 1.0)
    assert sum(r.p for r in m.continuations(["a"]).collect()) == pytest.approx(1.0)
    mle = M.NgramModel(docs(spark, "a b"), 2, 0.0)
    assert mle.log_probability(docs(spark, "b a")).first().logp == float("-inf")
    assert {tuple(r.tokens) for r in M.replace_rare(docs(spark, "a a b", "")).collect()} == {("a", "a", "<unk>"), ()}


def test_cooccurrence_counts_a_word_beside_itself(spark):
    got = {(r.term, r.ctx): r.n for r in M.cooccurrence(docs(spark, "a b a")).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2}


def test_merges():
    assert B.merge_symbols(["a", "a", "a"], ("a", "a")) == ["aa", "a"]
    assert B.learn_merges({"aaab": 3, "ab": 2}, 2) == [("a", "a"), ("b", "</w>")] or B.learn_merges({"aaab": 3, "ab": 2}, 2)[0] == ("a", "a")
    assert B.learn_merges({"xy": 1}, 5) == []
