"""Analyzers, engine, hybrid search, subwords, vectors, generation and the command line, against plain versions on small collections."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import analyzers, counts, embeddings, hybrid, models, search, subwords
from quillspark.plans import catalogue
from quillspark.sources import text as sources

TEXTS = ["The ship left the harbour at dawn.", "A farmer counts the sheep in the barn.", "문서를 검색하는 방법", "검색이 빠른 문서", "Ships and boats in the bay", ""]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")


def plain_merges(types, merges, boundary=True):
    words, found = {w: [*w, *(["</w>"] if boundary else [])] for w in types}, []
    for _ in range(merges):
        n = {}
        for w, y in words.items():
            for p in zip(y, y[1:]):
                n[p] = n.get(p, 0) + types[w]
        best = min(n, key=lambda p: (-n[p], p), default=None)
        if best is None or n[best] < 2:
            break
        found.append(best)
        for w, y in words.items():
            out, i = [], 0
            while i < len(y):
                if tuple(y[i : i + 2]) == best:
                    out.append(y[i] + y[i + 1])
                    i += 2
                else:
                    out.append(y[i])
                    i += 1
            words[w] = out
    return found, words


@pytest.mark.parametrize("seed, boundary", [(1, True), (2, False), (3, True)])
def test_merges_on_the_driver_and_as_a_table(spark, seed, boundary):
    rng = random.Random(seed)
    types = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(60)}
    want, words = plain_merges(types, 25, boundary)
    table = spark.createDataFrame(list(types.items()), "term string, n long")
    assert subwords.learn_merges(types, 25, boundary) == want
    assert subwords.train_distributed(table, 25, boundary) == want
    assert subwords.train_distributed(table, 8, boundary, most_pairs=5) == want[:8]
    ranks = {p: i for i, p in enumerate(want)}
    assert {w: subwords.encode_word(w, ranks, boundary) for w in types} == words


def test_merges_end_when_no_pair_occurs_twice(spark):
    table = spark.createDataFrame([("xy", 1), ("zw", 1)], "term string, n long")
    assert subwords.learn_merges({"xy": 1, "zw": 1}, 400, False) == subwords.train_distributed(table, 400, False) == []


def test_tokenizer(spark):
    t = subwords.BPETokenizer(spark.createDataFrame([("lower", 5), ("lowest", 4), ("newer", 6)], "term string, n long"), 2)
    assert t.encode_word("") == ["</w>"] and "".join(t.encode_word("lower")) == "lower</w>" and len(t) == 2
    assert t.shared_subwords("lower", "lowest") and not t.shared_subwords("lower", "")
    rows = t.encode(spark.createDataFrame([(1, ["lower", "newer"]), (2, [])], "doc_id long, tokens array<string>")).collect()
    assert {r.doc_id: list(r.tokens) for r in rows} == {1: t.encode_word("lower") + t.encode_word("newer"), 2: []}


def test_analyzers(spark, texts):
    with pytest.raises(ValueError):
        analyzers.Analyzer("subword")
    with pytest.raises(ValueError):
        analyzers.Analyzer("letters")
    found = {r.doc_id: r.tokens for r in analyzers.Analyzer("char").terms(texts).collect()}
    assert found[2] == ["문서", "서를", "를검", "검색", "색하", "하는", "는방", "방법"] and found[5] == []
    known = analyzers.build_analyzers(texts, 60)
    hits = {}
    cases = spark.createDataFrame([(0, [2, 3]), (1, [0, 4])], "query_id long, relevant array<long>")
    for name, a in known.items():
        hits[name] = analyzers.hit_rate(analyzers.Engine(texts, a).search(ask(spark, "문서", "ship"), 2), cases).first()[0]
    assert hits["char2"] == 1.0 and hits["char2"] >= hits["word"]
    assert analyzers.hit_rate(analyzers.Engine(texts, known["word"]).search(ask(spark, "qqq"), 3), cases).first()[0] == 0.0


def test_engine_shares_terms(spark, texts):
    e = analyzers.Engine(texts, analyzers.Analyzer("word"))
    q = ask(spark, "the harbour ship")
    found = e.search(q, 1)
    assert e.shared_terms(q, found).first().terms == ["harbour", "ship", "the"]


def test_hybrid(spark):
    corpus = sources.synthetic_corpus(spark)
    docs = corpus.where("doc_id % 9 = 0")
    h = hybrid.HybridSearcher(docs, corpus, k=8)
    q = spark.createDataFrame([(0, ["captain", "steers"]), (1, ["nothing"]), (2, [])], "query_id long, tokens array<string>")
    got = h.search(q, 0.5, 3).collect()
    assert all(sum(r.query_id == i for r in got) == 3 for i in range(3))
    ids = sorted(r.doc_id for r in docs.collect())[:3]
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == ids
    rrf = {(r.query_id, r["rank"]): r for r in h.search(q, 0.5, 3, "rrf").collect()}
    assert rrf[1, 1].doc_id == ids[0] and rrf[1, 1].score == pytest.approx(2 / 61, abs=1e-6)
    pairs = h.search(q, 1.0, 1).where("query_id = 0").select("query_id", "doc_id")
    assert h.explain(q, pairs).first().lexical > 0
    for bad in ({"alpha": 2}, {"fusion": "x"}, {"k": -1}):
        with pytest.raises(ValueError):
            h.search(q, **bad)


def test_vectors_by_blocks_and_dense_agree(spark):
    cells = models.ppmi(models.cooccurrence(sources.synthetic_corpus(spark)))
    dense = {r.term: np.array(r.vec) for r in embeddings.svd_embeddings(cells, 4, "full").collect()}
    blocks = {r.term: np.array(r.vec) for r in embeddings.svd_embeddings(cells, 4, "full", most_terms=0, rounds=25).collect()}
    assert set(dense) == set(blocks)
    names = sorted(dense)
    a, b = (np.array([x[t] for t in names]) for x in (dense, blocks))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-3 * np.abs(a @ a.T).max())
    with pytest.raises(ValueError):
        embeddings.svd_embeddings(cells, 4, "other")


def test_variance_and_reconstruction():
    m = np.random.default_rng(1).normal(size=(6, 6))
    s = np.linalg.svd(m, compute_uv=False)
    u, v, w = embeddings.leading(m, 3)
    assert np.allclose(embeddings.explained_variance(m), s**2 / (s**2).sum())
    assert embeddings.reconstruction_error(m, 3) == pytest.approx(np.linalg.norm(m - u * v @ w) / np.linalg.norm(m))
    assert embeddings.reconstruction_error(np.zeros((2, 2)), 1) == 0.0 and not embeddings.explained_variance(np.zeros((2, 2))).any()
    with pytest.raises(ValueError):
        embeddings.leading(m, 7)


def test_word_vectors(spark):
    rows = [("king", [1.0, 1.0, 0.0]), ("man", [1.0, 0.0, 0.0]), ("woman", [0.0, 0.0, 1.0]), ("queen", [0.0, 1.0, 1.0]), ("zero", [0.0, 0.0, 0.0])]
    v = embeddings.WordVectors(spark.createDataFrame(rows, "term string, vec array<double>"))
    assert len(v) == 5 and "king" in v and "dog" not in v and v.similarity("king", "man") == pytest.approx(0.5**0.5)
    assert v.analogy("man", "king", "woman", 1).first().term == "queen"
    assert v.most_similar("king", 2).orderBy("rank").first().term == "man"
    assert v.nearest_to_input("man", "king", "woman").first().term == "queen"
    with pytest.raises(KeyError):
        v.vector("dog")
    with pytest.raises(ValueError):
        v.nearest_to_input("man", "king", "woman", "d")
    cases = spark.createDataFrame([("man", "king", "woman", "queen"), ("man", "king", "dog", "queen")], "a string, b string, c string, expected string")
    got = embeddings.evaluate_analogies(v.units, cases).first()
    assert (got.cases, got.arithmetic) == (1, 1.0) and got.agrees in (0.0, 1.0)
    with pytest.raises(ValueError):
        embeddings.evaluate_analogies(v.units, cases.where("c = 'dog'"))


def test_pmi_with_added_counts(spark):
    cells = spark.createDataFrame([("a", "b", 3), ("b", "a", 3), ("b", "b", 1)], "term string, ctx string, n long")
    m = np.array([[0, 3], [3, 1]]) + 0.5
    want = np.log(m * m.sum() / (m.sum(1)[:, None] * m.sum(0)))
    got = {(r.term, r.ctx): r.pmi for r in models.pmi(cells, positive=False, epsilon=0.5).collect()}
    assert got == {(a, b): pytest.approx(want[i, j]) for i, a in enumerate("ab") for j, b in enumerate("ab")}
    assert models.table_sparsity(cells).first()[0] == 0.25
    assert [r.ctx for r in models.top_associations(cells.withColumnRenamed("n", "ppmi"), "a", 5).collect()] == ["b"]
    with pytest.raises(KeyError):
        models.top_associations(cells, "z", 1, "n")


def test_distributions(spark):
    dist = [("a", 0.5), ("b", 0.3), ("c", 0.2)]
    table = spark.createDataFrame(dist, "token string, p double")
    got = {r.token: r.p for r in models.apply_temperature(models.top_k_filter(table, 2), 0.5).collect()}
    assert got == {t: pytest.approx(p) for t, p in subwords.sharpened(dist, 0.5, 2)} == {"a": pytest.approx(25 / 34), "b": pytest.approx(9 / 34)}
    assert subwords.sample_next([("b", 0.5), ("a", 0.5)], random.Random(1), greedy=True) == "a"
    assert subwords.sample_next([("a", 0.0)], random.Random(1)) is None
    for f in (lambda: models.apply_temperature(table, 0), lambda: models.top_k_filter(table, 0), lambda: subwords.sharpened(dist, -1)):
        with pytest.raises(ValueError):
            f()


def test_generation(spark):
    corpus = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "b", "d"]), (2, ["a", "e"])], "doc_id long, tokens array<string>")
    seeds = spark.range(6).withColumnRenamed("id", "seed")
    said = {r.seed: r.text for r in subwords.generate(models.NgramModel(corpus, 2, 0.0), seeds, 10).collect()}
    assert set(said) == set(range(6)) and set(said.values()) <= {"a b c", "a b d", "a e"}
    assert said == {r.seed: r.text for r in subwords.generate(models.NgramModel(corpus, 2, 0.0), seeds, 10).collect()}
    assert {r.text for r in subwords.generate(models.NgramModel(corpus, 3, 0.5), seeds, 2, greedy=True).collect()} == {"a b"}


def test_perplexity(spark):
    corpus = spark.createDataFrame([(0, ["a", "b"])], "doc_id long, tokens array<string>")
    assert models.perplexity(models.NgramModel(corpus, 2, 0.0), corpus).first()[0] == pytest.approx(1.0)
    other = spark.createDataFrame([(0, ["b"])], "doc_id long, tokens array<string>")
    assert models.perplexity(models.NgramModel(corpus, 2, 0.0), other).first()[0] == float("inf")
    with pytest.raises(ValueError):
        models.perplexity(models.NgramModel(corpus, 2, 0.0), corpus.limit(0))


def test_idf_has_no_value_for_some_terms(spark):
    index = counts.postings(spark.createDataFrame([(0, ["a"]), (1, ["a", "b"])], "doc_id long, tokens array<string>"))
    terms = spark.createDataFrame([("a",), ("z",)], "term string")
    with pytest.raises(ValueError):
        counts.checked_idf("classic", index, terms, 2)
    with pytest.raises(ValueError):
        counts.checked_idf("probabilistic", index, terms.where("term = 'a'"), 2)
    assert counts.checked_idf("smooth", index, terms, 2).count() == 2


def test_zero_scores_fill_up(spark):
    docs = spark.createDataFrame([(i, ["x"] if i == 5 else ["y"]) for i in range(8)], "doc_id long, tokens array<string>")
    q = spark.createDataFrame([(0, ["x"]), (1, ["q"])], "query_id long, tokens array<string>")
    e = search.SearchEngine(docs)
    for k in (3, 8, 20):
        every = e.rank_documents(q).where(F.col("rank") <= k)
        assert e.rank_documents(q, k).exceptAll(every).count() == 0 == every.exceptAll(e.rank_documents(q, k)).count()


def test_hold_out(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in sources.hold_out(docs, 7).where("is_test").orderBy("doc_id").collect()]
    assert got == sorted({int(i * 50 / 7) for i in range(7)})
    assert sources.hold_out(docs, 0).where("is_test").count() == 0
    with pytest.raises(ValueError):
        sources.hold_out(docs, 50)


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("é\nb", encoding="utf-8")
    assert sources.whole_texts(spark, str(tmp_path / "a.md")).first().text == "é\nb"
    assert sources.whole_texts(spark, str(tmp_path / "none.md"), "held").first().text == "held"
    with pytest.raises(FileNotFoundError):
        sources.whole_texts(spark, str(tmp_path / "none.md"))
    assert sources.synthetic_corpus(spark).exceptAll(sources.synthetic_corpus(spark)).count() == 0


def test_command_line(spark, texts, tmp_path, capsys):
    texts.write.parquet(path := str(tmp_path / "docs.parquet"))
    base = ["--documents", path, "--merges", "20"]
    assert cli.main([*base, "search", "harbour", "-a", "word", "-k", "1", "-e"], spark) == 0
    assert "[0]" in (out := capsys.readouterr().out) and "(harbour)" in out
    assert cli.main([*base, "search", "qqqq", "-a", "word"], spark) == 0
    assert "no document" in capsys.readouterr().out
    assert cli.main([*base, "search", "x", "-a", "none"], spark) == 2
    assert cli.main([*base, "compare", "문서"], spark) == 0 and "char2" in capsys.readouterr().out
    assert cli.main([*base, "tokenize", "the ship"], spark) == 0 and "the | ship" in capsys.readouterr().out
    (tmp_path / "cases.jsonl").write_text(json.dumps({"query": "문서", "relevant": [2, 3]}) + "\n" + json.dumps({"query": "farmer", "relevant": [1]}), encoding="utf-8")
    assert cli.main([*base, "evaluate", str(tmp_path / "cases.jsonl")], spark) == 0 and "all 100%" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(base, spark)


@pytest.mark.parametrize("boundary", [True, False])
def test_merges_of_symbols_that_meet_again(spark, boundary):
    """Runs of one letter, letters beyond 16 bits, a word that spells the end mark, and symbols that two merges make."""
    types = {"aaaa": 3, "aaa": 2, "</w></w>": 2, "abab": 4, "aabb😀": 3, "😀😀": 2, "x": 9, "babab": 3}
    table = spark.createDataFrame(list(types.items()), "term string, n long")
    assert subwords.train_distributed(table, 50, boundary) == subwords.learn_merges(types, 50, boundary)


def test_a_long_batch_of_merges_is_no_long_plan(spark):
    """Before, a batch of merges was one expression, which grew fourfold with each merge of the batch."""
    types = {chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i): 1000 - 20 * i for i in range(30)}
    table = spark.createDataFrame(list(types.items()), "term string, n long")
    began = time.monotonic()
    assert subwords.train_distributed(table, 30, False) == [tuple(w) for w in types]
    assert time.monotonic() - began < 60


def test_vectors_of_a_symmetric_table_by_halves_and_panels(spark, monkeypatch):
    """Half the cells, panels of a few columns and arrays of a few cells give what the dense matrix does, up to signs."""
    monkeypatch.setattr(embeddings, "PANEL", 5 * 8 * 60)
    monkeypatch.setattr(embeddings, "CELLS", 7)
    rng = random.Random(1)
    rows = [(f"w{i:02}", f"w{j:02}", rng.random()) for i in range(60) for j in range(i, 60) if i % 5 == 0 or rng.random() < 0.2]
    half = spark.createDataFrame(rows, "term string, ctx string, ppmi double")
    dense, blocks = ({r.term: np.array(r.vec) for r in embeddings.svd_embeddings(half, 4, "full", most, rounds=30, half=True).collect()} for most in (4000, 0))
    assert set(dense) == set(blocks) and len(dense) == 60
    a, b = (np.array([x[t] for t in sorted(x)]) for x in (dense, blocks))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-3)
    whole = {r.term: np.array(r.vec) for r in embeddings.svd_embeddings(models.mirrored(half, "ppmi"), 4, "full").collect()}
    assert np.allclose(np.abs(a), np.abs([whole[t] for t in sorted(whole)]), atol=1e-6)


def test_catalogue_takes_all_words_for_vectors(spark, tmp_path):
    """Words found twice have vectors; before, only those found fifty times did."""
    spark.createDataFrame([(i, " ".join(f"w{(7 * i + k) % 30}" for k in range(4))) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.svd_embeddings(spark, str(tmp_path)).count() == len({f"w{x}" for x in range(30) if sum((7 * i + k) % 30 == x for i in range(20) for k in range(4)) >= 2})
