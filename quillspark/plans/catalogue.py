"""The registry of queries over the driver's tables, with the SQL that each is held against.

Figures are rounded to six places before ordering or comparing, as sums run in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analyzers as A
from quillspark.operators import counts as C
from quillspark.operators import dense
from quillspark.operators import embeddings as E
from quillspark.operators import hybrid as H
from quillspark.operators import models as M
from quillspark.operators import search as S
from quillspark.operators import subwords as B
from quillspark.runtime import materialize, read_table, small_side
from quillspark.sources import text as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WORDS = r"""regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]')"""
_TOK = f"list_filter({_WORDS}, lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))"
#: Building blocks of the SQL: documents as token lists, in long form, as postings.
TOK = f"tok AS (SELECT doc_id, {_TOK} AS tokens FROM documents)"
LONG = f"{TOK}, lng AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(1, len(tokens) + 1)) AS pos FROM tok)"
FREQ = f"{LONG}, freq AS (SELECT term, count(*) AS n FROM lng GROUP BY term)"
RANKED = f"{FREQ}, ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM freq)"
POST = f"{LONG}, post AS (SELECT doc_id, term, count(*) AS tf FROM lng GROUP BY doc_id, term), voc AS (SELECT term, count(*) AS df FROM post GROUP BY term), size AS (SELECT count(*) AS docs FROM documents)"
QTOK = f"q AS (SELECT item_id AS query_id, {_TOK} AS tokens FROM benchmark), qlng AS (SELECT query_id, unnest(tokens) AS term FROM q)"
WEIGHT = f"""{POST}, w0 AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((1.0 + docs) / (1.0 + df)) + 1) AS w FROM post JOIN voc USING (term) CROSS JOIN size),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY doc_id), {QTOK},
qp AS (SELECT query_id, term, count(*) AS tf FROM qlng JOIN voc USING (term) GROUP BY query_id, term),
qw0 AS (SELECT query_id, term, tf / sum(tf) OVER (PARTITION BY query_id) * (ln((1.0 + docs) / (1.0 + df)) + 1) AS qw FROM qp JOIN voc USING (term) CROSS JOIN size),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw0 GROUP BY query_id),
part AS (SELECT query_id, doc_id, term, w * qw / (norm * qnorm) AS part FROM w0 JOIN qw0 USING (term) JOIN norms USING (doc_id) JOIN qn USING (query_id)),
score AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM part GROUP BY query_id, doc_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", T.normalize(F.col("text"), native=True).alias("tokens"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.normalize(F.col("text"), native=True).alias("tokens"))


def engine(spark: SparkSession, d: str) -> S.SearchEngine:
    return S.SearchEngine(tokens(spark, d))


def freqs(spark: SparkSession, d: str) -> DataFrame:
    return C.frequencies(C.long(tokens(spark, d)))


def _joined(name: str, column) -> Callable:
    return lambda s, d: read_table(s, d, "documents").select("doc_id", F.array_join(column(F.col("text")), "\x1f").alias("tokens"))


def _lists(name: str, column, sql: str) -> None:
    """A query of one list a document, shown as one string so that any tool compares it alike."""
    QUERIES[name] = _joined(name, column)
    ORACLE[name] = f"SELECT doc_id, array_to_string({sql}, chr(31)) AS tokens FROM documents"


_SP = r"\s\x1c-\x1f\x85\p{Z}"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_RAW = _WORDS.replace("replace(replace(lower(text), 'ß', 'ss'), '’', '''')", "replace(text, '’', '''')")
_lists("tokenize_whitespace", T.tokenize_whitespace, f"list_filter(regexp_split_to_array(text, '[{_SP}]+'), lambda t: t <> '')")
_lists("tokenize_words", T.tokenize_words, _RAW)
_lists("split_sentences", T.split_sentences, rf"list_filter(string_split(regexp_replace(regexp_replace(text, '^[{_SP}]+|[{_SP}]+$', '', 'g'), '([.!?])[{_SP}]+', '\1' || chr(1), 'g'), chr(1)), lambda t: t <> '')")
_lists("normalize_tokens", lambda t: T.normalize(t), _TOK)
_lists("normalize_tokens_native", lambda t: T.normalize(t, native=True), _TOK)
_lists("normalize_full", lambda t: T.normalize_full(t, native=True), f"list_filter({_TOK}, lambda t: NOT list_contains({_STOP}, t))")
_lists("strip_punctuation", lambda t: T.strip_punctuation(T.tokenize_words(t)), rf"list_filter({_RAW}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))")
_lists("remove_stopwords", lambda t: T.remove_stopwords(T.normalize(t, native=True)), f"list_filter({_TOK}, lambda t: NOT list_contains({_STOP}, t))")
_lists("bigram_features", lambda t: T.with_bigrams(T.normalize(t, native=True)), f"(SELECT list_concat(x, list_transform(range(1, greatest(len(x), 1)), lambda i: x[i] || '_' || x[i + 1])) FROM (SELECT {_TOK} AS x))")


@query(f"SELECT doc_id, trim(regexp_replace(text, '[{_SP}]+', ' ', 'g')) AS text FROM documents")
def normalize_whitespace(s, d):
    return read_table(s, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_unicode(s, d):
    return read_table(s, d, "documents").select("doc_id", T.normalize_unicode(F.col("text")).alias("text"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(s, d):
    return read_table(s, d, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(lower(text), 'ß', 'ss') AS text FROM documents")
def casefold(s, d):
    return read_table(s, d, "documents").select("doc_id", T.fold(F.col("text")).alias("text"))


@query(f"WITH {FREQ} SELECT term, n FROM freq")
def word_frequencies(s, d):
    return freqs(s, d)


@query(f"WITH {RANKED} SELECT term, n, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank_words(s, d):
    return C.ranked(freqs(s, d))


@query(f"WITH {FREQ} SELECT term, n FROM freq ORDER BY n DESC, term LIMIT 50")
def rank_top_words(s, d):
    return C.top(freqs(s, d), 50)


@query(f"WITH {FREQ} SELECT term, n FROM freq WHERE n = 1")
def hapax(s, d):
    return C.hapaxes(freqs(s, d))


@query(f"WITH {TOK} SELECT doc_id, CASE WHEN len(tokens) = 0 THEN 0.0 ELSE CAST(len(list_distinct(tokens)) AS DOUBLE) / len(tokens) END AS ttr FROM tok")
def type_token_ratio(s, d):
    return C.type_token_ratio(tokens(s, d))


@query(f"WITH {RANKED} SELECT CAST(k AS INTEGER) AS k, round(CAST(sum(CASE WHEN rank <= k THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS coverage FROM ranked CROSS JOIN (SELECT unnest([10, 100, 1000, 10000]) AS k) GROUP BY k")
def coverage_curve(s, d):
    return C.coverage(freqs(s, d), [10, 100, 1000, 10000])


@query(f"WITH {RANKED} SELECT CAST(rank AS INTEGER) AS rank, term, n, round(CAST((SELECT max(n) FROM freq) AS DOUBLE) / rank, 6) AS expected FROM ranked WHERE rank <= 20")
def zipf_table(s, d):
    return C.zipf_table(freqs(s, d), 20)


@query(f"WITH {RANKED} SELECT round(-regr_slope(ln(n), ln(rank)), 6) AS exponent FROM ranked")
def zipf_exponent(s, d):
    return C.zipf_exponent(freqs(s, d)).select(F.round("exponent", 6).alias("exponent"))


def _gram_sql(n: int) -> str:
    cols = " || ' ' || ".join(f"lead(term, {j}) OVER w" if j else "term" for j in range(n))
    return f"{LONG}, g AS (SELECT {cols} AS gram FROM lng WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"


def grams(s, d, n: int) -> DataFrame:
    return tokens(s, d).select(F.explode(T.ngrams(F.col("tokens"), n)).alias("g")).select(F.array_join("g", " ").alias("gram"))


@query(f"WITH {_gram_sql(2)} SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram")
def bigram_counts(s, d):
    return C.frequencies(grams(s, d, 2), "gram")


@query(f"WITH {_gram_sql(3)} SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram")
def trigram_counts(s, d):
    return C.frequencies(grams(s, d, 3), "gram")


@query(f"WITH {_gram_sql(2)} SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram ORDER BY n DESC, gram LIMIT 25")
def top_ngrams(s, d):
    return C.top(C.frequencies(grams(s, d, 2), "gram"), 25, "gram")


@query(f"WITH {_gram_sql(2)}, f AS (SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram) SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS sparsity FROM f")
def ngram_sparsity(s, d):
    return C.sparsity(C.frequencies(grams(s, d, 2), "gram")).select(F.round("sparsity", 6).alias("sparsity"))


_PAD = f"{TOK}, pad AS (SELECT doc_id, list_concat(list_concat(['<s>'], tokens), ['</s>']) AS t FROM tok), pl AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM pad), lm AS (SELECT doc_id, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, token FROM pl), ng AS (SELECT ctx, token, count(*) AS n FROM lm WHERE ctx IS NOT NULL GROUP BY ctx, token), cx AS (SELECT ctx, sum(n) AS ctx_n FROM ng GROUP BY ctx), v AS (SELECT count(DISTINCT token) AS v FROM pl WHERE token <> '<s>')"
_LM = f"{_PAD}, p AS (SELECT doc_id, ctx, token, (n + 0.1) / (ctx_n + 0.1 * v) AS p, n, ctx_n, v FROM lm JOIN ng USING (ctx, token) JOIN cx USING (ctx) CROSS JOIN v)"


@query(f"WITH {_PAD} SELECT ctx || ' ' || token AS gram, n FROM ng")
def padded_bigrams(s, d):
    x = tokens(s, d).select(F.explode(T.ngrams(T.pad(F.col("tokens"), 2), 2)).alias("g")).select(F.array_join("g", " ").alias("gram"))
    return C.frequencies(x, "gram")


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY gram")
def char_trigrams(s, d):
    x = read_table(s, d, "documents").select(F.explode(T.char_ngrams(F.col("text"), 3, native=True)).alias("gram"))
    return C.frequencies(x, "gram")


@query(f"WITH {POST} SELECT term, df FROM voc")
def document_frequency(s, d):
    return C.document_frequencies(C.postings(tokens(s, d)))


@query(f"WITH {POST} SELECT term, df FROM voc CROSS JOIN size WHERE df >= 2 AND df <= 0.5 * docs")
def vocab_min_max_df(s, d):
    t = tokens(s, d)
    return C.vocabulary(C.postings(t), t.count(), 2, 0.5)


@query(f"WITH {FREQ} SELECT term, n FROM freq WHERE n >= 3")
def vocab_min_count(s, d):
    return freqs(s, d).where("n >= 3")


@query(f"WITH {POST}, num AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM voc WHERE df >= 2) SELECT doc_id, CAST(idx AS INTEGER) AS idx, tf FROM post JOIN num USING (term)")
def bag_of_words(s, d):
    index = C.postings(tokens(s, d))
    return index.join(C.numbered(C.document_frequencies(index).where("df >= 2")), "term").select("doc_id", "idx", "tf")


@query(f"WITH {POST}, k AS (SELECT term FROM voc WHERE df >= 2) SELECT doc_id, round(coalesce(avg(CASE WHEN lng.term IS NULL THEN NULL WHEN k.term IS NULL THEN 1.0 ELSE 0.0 END), 0), 6) AS oov_rate FROM documents LEFT JOIN lng USING (doc_id) LEFT JOIN k ON lng.term = k.term GROUP BY doc_id")
def oov_rate(s, d):
    t = tokens(s, d)
    return C.oov_rate(t, C.document_frequencies(C.postings(t)).where("df >= 2")).select("doc_id", F.round("oov_rate", 6).alias("oov_rate"))


@query(f"WITH {POST} SELECT round(1 - CAST((SELECT count(*) FROM post) AS DOUBLE) / ((SELECT count(*) FROM voc) * docs), 6) AS sparsity FROM size")
def matrix_sparsity(s, d):
    t = tokens(s, d)
    index = C.postings(t)
    n = index.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("term").alias("terms"))
    return n.crossJoin(t.agg(F.count(F.lit(1)).alias("docs"))).select(F.round(1 - F.col("cells") / (F.col("terms") * F.col("docs")), 6).alias("sparsity"))


@query(f"WITH {POST} SELECT term, doc_id, tf FROM post")
def inverted_index(s, d):
    return C.postings(tokens(s, d)).select("term", "doc_id", "tf")


for _scheme, _sql in (("raw", "CAST(tf AS DOUBLE)"), ("relative", "tf / sum(tf) OVER (PARTITION BY doc_id)"), ("log", "1 + ln(tf)"), ("boolean", "1.0")):

    def _tf(s, d, scheme=_scheme):
        x = C.postings(tokens(s, d)).withColumn("total", F.sum("tf").over(Window.partitionBy("doc_id")))
        return x.select("doc_id", "term", F.round(C.tf(scheme, F.col("tf"), F.col("total")), 6).alias("tf"))

    QUERIES[f"tf_{_scheme}"] = _tf
    ORACLE[f"tf_{_scheme}"] = f"WITH {POST} SELECT doc_id, term, round(CAST({_sql} AS DOUBLE), 6) AS tf FROM post"

for _scheme, _sql in (("smooth", "ln((1.0 + docs) / (1.0 + df)) + 1"), ("classic", "ln(CAST(docs AS DOUBLE) / df)"), ("probabilistic", "ln((CAST(docs AS DOUBLE) - df) / df)")):

    def _idf(s, d, scheme=_scheme):
        t = tokens(s, d)
        n = t.count()
        return C.document_frequencies(C.postings(t)).where(F.col("df") < n).select("term", F.round(C.idf(scheme, F.col("df"), F.lit(n)), 6).alias("idf"))

    QUERIES[f"idf_{_scheme}"] = _idf
    ORACLE[f"idf_{_scheme}"] = f"WITH {POST} SELECT term, round({_sql}, 6) AS idf FROM voc CROSS JOIN size WHERE df < docs"


@query(f"WITH {WEIGHT} SELECT doc_id, term, w FROM (SELECT doc_id, term, round(w, 6) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS r FROM w0) WHERE r <= 5")
def tfidf_top_terms(s, d):
    w = engine(s, d).weights.select("doc_id", "term", F.round("w", 6).alias("w"))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).where("r <= 5").drop("r")


@query(f"WITH {WEIGHT}, few AS (SELECT doc_id, list(term) AS has FROM w0 GROUP BY doc_id HAVING count(*) < 5), fill AS (SELECT term FROM voc ORDER BY term LIMIT 10), x AS (SELECT doc_id, term, round(w, 6) AS w FROM w0 UNION ALL SELECT doc_id, term, 0.0 AS w FROM few JOIN fill ON NOT list_contains(has, term)) SELECT doc_id, term, w, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM x) WHERE rank <= 5")
def top_terms(s, d):
    e = engine(s, d)
    return C.top_terms(e.weights.select("doc_id", "term", "w"), e.vocab, 5)


@query(f"WITH {WEIGHT} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10")
def search(s, d):
    return engine(s, d).search(questions(s, d), 10)


@query(f"WITH {WEIGHT} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, doc_id) AS rank FROM q CROSS JOIN documents LEFT JOIN score USING (query_id, doc_id)) WHERE rank <= 20")
def rank_documents(s, d):
    return engine(s, d).rank_documents(questions(s, d), 20)


@query(f"WITH {POST}, {QTOK} SELECT DISTINCT query_id, doc_id FROM post JOIN qlng USING (term)")
def candidates_or(s, d):
    return engine(s, d).candidates(questions(s, d))


@query(f"WITH {POST}, {QTOK} SELECT query_id, count(DISTINCT doc_id) AS n FROM post JOIN qlng USING (term) GROUP BY query_id")
def scored_document_count(s, d):
    return engine(s, d).candidates(questions(s, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POST}, {QTOK}, qd AS (SELECT DISTINCT query_id, term FROM qlng), need AS (SELECT query_id, count(*) AS need FROM qd GROUP BY query_id), has AS (SELECT query_id, doc_id, count(*) AS has FROM post JOIN qd USING (term) GROUP BY query_id, doc_id) SELECT query_id, doc_id FROM has JOIN need USING (query_id) WHERE has = need")
def boolean_and(s, d):
    return engine(s, d).boolean_and(questions(s, d))


@query(f"WITH {WEIGHT} SELECT query_id, doc_id, term, round(part, 6) AS part FROM part WHERE part > 0")
def explain_score(s, d):
    return engine(s, d).contributions(questions(s, d)).where("part > 0").select("query_id", "doc_id", "term", F.round("part", 6).alias("part"))


@query(f"WITH {QTOK}, b AS (SELECT query_id, term, count(*) AS c FROM qlng GROUP BY query_id, term), n AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM b GROUP BY query_id), x AS (SELECT a.query_id AS a, b2.query_id AS b, sum(a.c * b2.c) AS dot FROM b a JOIN b b2 ON a.term = b2.term AND a.query_id < b2.query_id GROUP BY 1, 2) SELECT a, b, round(dot / (na.n * nb.n), 6) AS cosine FROM x JOIN n na ON a = na.query_id JOIN n nb ON b = nb.query_id")
def pairwise_cosine(s, d):
    b = questions(s, d).select("query_id", F.explode(T.held("tokens")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("c"))
    n = b.groupBy("query_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    x = b.select(F.col("query_id").alias("a"), "term", F.col("c").alias("ca")).join(b.select(F.col("query_id").alias("b"), "term", F.col("c").alias("cb")), "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    return x.join(n.select(F.col("query_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("query_id").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def _vector_pairs(s, d, asked: str, blocks: Callable[[DataFrame, DataFrame], DataFrame | None], column: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of the vectors with those asked: in blocks, and by a Column where a vector has nulls, other numbers than finite ones or a size of its own."""
    v = read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = materialize(v.where(asked).select(F.col("id").alias("key"), "vec", F.array("id").alias("excluded")))
    items, targets, rest = dense.split(v, q)
    parts = [column(a.select(F.col("id").alias("vec_id"), F.col("vec").alias("v")).crossJoin(small_side(b.select(F.col("key").alias("query_id"), F.col("vec").alias("q")), 20_000)).where("vec_id <> query_id")) for a, b in rest]
    found = blocks(items, targets)
    parts += [found.withColumnsRenamed({"key": "query_id", "id": "vec_id"})] if found is not None else []
    return reduce(DataFrame.unionByName, parts) if parts else column(v.crossJoin(q).where("false").select(F.col("key").alias("query_id"), F.col("id").alias("vec_id"), v["vec"].alias("v"), q["vec"].alias("q")))


def _cosines(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "vec_id", F.round(M.cosine("v", "q"), 6).alias("score"))


def _distances(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "vec_id", F.round(M.euclidean("v", "q"), 6).alias("distance"))


_COS = "list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * b[i]))"
_VEC = "p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.embedding AS a, c.embedding AS b FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), d AS (SELECT query_id, vec_id, round(" + _COS + " / (sqrt(" + _COS.replace("b[i]", "a[i]") + ") * sqrt(" + _COS.replace("a[i]", "b[i]").replace("len(a)", "len(b)") + ")), 6) AS score, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (CAST(a[i] AS DOUBLE) - b[i]) * (CAST(a[i] AS DOUBLE) - b[i])))), 6) AS distance FROM p)"


@query(f"WITH {_VEC} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 10")
def knn_embeddings(s, d):
    x = _vector_pairs(s, d, "id % 100 = 0", lambda items, asked: dense.nearest(items, asked, 10, cosine=True), _cosines)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 10")


@query(f"WITH {_VEC} SELECT query_id, vec_id, distance FROM d")
def euclidean(s, d):
    return _vector_pairs(s, d, "id % 100 = 0", dense.distances, _distances)


_ANALOGY = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings),
t AS (SELECT list_transform(range(1, len(a.u) + 1), lambda i: b.u[i] - a.u[i] + c.u[i]) AS t FROM unit a, unit b, unit c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2),
s AS (SELECT vec_id, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * t[i])) / sqrt(list_sum(list_transform(t, lambda x: x * x))), 6) AS score FROM unit CROSS JOIN t WHERE vec_id > 2)"""


@query(f"WITH {_ANALOGY} SELECT CAST(vec_id AS VARCHAR) AS term, score FROM s ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 5")
def analogy_embeddings(s, d):
    v = read_table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<double>").alias("vec"))
    return E.analogy(E.unit(v), "0", "1", "2", k=5).select("term", "score")


LABELLED = f"{POST}, lab AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels), cls AS (SELECT label, count(*) AS docs, ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab JOIN documents USING (doc_id))) AS prior FROM lab JOIN documents USING (doc_id) GROUP BY label), lt AS (SELECT label, term, sum(tf) AS n FROM post JOIN lab USING (doc_id) GROUP BY label, term), tot AS (SELECT label, sum(n) AS total FROM lt GROUP BY label), vs AS (SELECT count(DISTINCT term) AS v FROM lt), lik AS (SELECT label, term, ln((coalesce(n, 0) + 1.0) / (total + v)) AS ll FROM (SELECT DISTINCT term FROM lt) CROSS JOIN tot CROSS JOIN vs LEFT JOIN lt USING (label, term)), sc AS (SELECT doc_id, label, sum(tf * ll) AS s FROM post JOIN lik USING (term) GROUP BY doc_id, label), sco AS (SELECT doc_id, label, prior + coalesce(s, 0) AS log_score FROM documents CROSS JOIN cls LEFT JOIN sc USING (doc_id, label)), pred AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(log_score, 4) DESC, label) AS r FROM sco) WHERE r = 1)"


def labelled(s, d) -> DataFrame:
    return tokens(s, d).join(read_table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")


@query(f"WITH {LABELLED} SELECT label, term, CAST(n AS BIGINT) AS n FROM lt")
def nb_class_counts(s, d):
    return M.NaiveBayes(labelled(s, d)).counts


@query(f"WITH {LABELLED} SELECT doc_id, label, round(log_score / (1 + len(tokens)), 5) AS log_score FROM sco JOIN tok USING (doc_id)")
def nb_log_scores(s, d):
    t = tokens(s, d)
    return M.NaiveBayes(labelled(s, d)).scores(t).join(t, "doc_id").select("doc_id", "label", F.round(F.col("log_score") / (1 + F.size("tokens")), 5).alias("log_score"))


@query(f"WITH {LABELLED} SELECT doc_id, label FROM pred")
def nb_predict(s, d):
    return M.NaiveBayes(labelled(s, d)).predict(tokens(s, d))


@query(f"WITH {LABELLED}, e AS (SELECT doc_id, label, exp(log_score - max(log_score) OVER (PARTITION BY doc_id)) AS e FROM sco) SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 4) AS p FROM e")
def nb_proba(s, d):
    return M.NaiveBayes(labelled(s, d)).proba(tokens(s, d)).select("doc_id", "label", F.round("p", 4).alias("p"))


@query(f"WITH {LABELLED}, j AS (SELECT pred.label AS predicted, lab.label AS actual FROM pred JOIN lab USING (doc_id)), c AS (SELECT actual AS c FROM j UNION SELECT predicted FROM j) SELECT a.c AS actual, b.c AS predicted, count(j.actual) AS n FROM c a CROSS JOIN c b LEFT JOIN j ON j.actual = a.c AND j.predicted = b.c GROUP BY 1, 2")
def nb_confusion(s, d):
    x = labelled(s, d)
    return M.confusion(M.NaiveBayes(x).predict(x.select("doc_id", "tokens")).withColumnRenamed("label", "predicted").join(x.select("doc_id", F.col("label").alias("actual")), "doc_id"))


@query(f"WITH {LABELLED} SELECT round(avg(CASE WHEN pred.label = lab.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred JOIN lab USING (doc_id)")
def nb_accuracy(s, d):
    x = labelled(s, d)
    return M.accuracy(M.NaiveBayes(x).predict(x.select("doc_id", "tokens")).withColumnRenamed("label", "predicted").join(x.select("doc_id", F.col("label").alias("actual")), "doc_id")).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {LABELLED}, r AS (SELECT a.label, a.term, round(a.ll - max(b.ll), 6) AS log_ratio FROM lik a JOIN lik b ON a.term = b.term AND a.label <> b.label GROUP BY a.label, a.term, a.ll) SELECT label, term, log_ratio, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY log_ratio DESC, term) AS rank FROM r) WHERE rank <= 10")
def nb_top_features(s, d):
    return M.NaiveBayes(labelled(s, d)).top_features(10)


def model(s, d) -> M.NgramModel:
    return M.NgramModel(tokens(s, d), 2, 0.1)


@query(f"WITH {_PAD} SELECT ctx, token, n FROM ng")
def lm_ngram_counts(s, d):
    return model(s, d).ngrams.select(F.array_join("ctx", " ").alias("ctx"), "token", "n")


@query(f"WITH {_LM} SELECT DISTINCT ctx, token, round(p, 6) AS p FROM p")
def lm_probability(s, d):
    m = model(s, d)
    return m.distinct_probabilities(m.sentences).select(F.array_join("ctx", " ").alias("ctx"), "token", F.round("p", 6).alias("p"))


@query(f"WITH {_LM} SELECT doc_id, round(sum(ln(p)) / count(*), 5) AS logp FROM p GROUP BY doc_id")
def lm_log_probability(s, d):
    return model(s, d).log_probability(tokens(s, d)).select("doc_id", F.round(F.col("logp") / F.col("tokens"), 5).alias("logp"))


@query(f"WITH {_LM} SELECT round(exp(-sum(ln(p)) / count(*)), 4) AS perplexity FROM p")
def lm_perplexity(s, d):
    m = model(s, d)
    return M.perplexity(m, m.sentences).select(F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {_PAD}, voc2 AS (SELECT DISTINCT token FROM pl WHERE token <> '<s>') SELECT token, round((coalesce(n, 0) + 0.1) / ((SELECT ctx_n FROM cx WHERE ctx = 'the') + 0.1 * v), 9) AS p FROM voc2 CROSS JOIN v LEFT JOIN (SELECT token, n FROM ng WHERE ctx = 'the') USING (token)")
def lm_continuations(s, d):
    return model(s, d).continuations(["the"]).select("token", F.round("p", 9).alias("p"))


@query(f"WITH {_PAD} SELECT round(sum(n + 0.1) / (max(ctx_n) + 0.1 * max(v)), 6) AS seen, round(1 - sum(n + 0.1) / (max(ctx_n) + 0.1 * max(v)), 6) AS cost FROM ng JOIN cx USING (ctx) CROSS JOIN v WHERE ctx = 'the'")
def lm_smoothing_cost(s, d):
    return M.smoothing_cost(model(s, d), ["the"]).select(F.round("seen", 6).alias("seen"), F.round("cost", 6).alias("cost"))


@query(f"WITH {FREQ} SELECT doc_id, array_to_string(list(CASE WHEN n >= 2 THEN term ELSE '<unk>' END ORDER BY pos), ' ') AS tokens FROM lng JOIN freq USING (term) GROUP BY doc_id UNION ALL SELECT doc_id, '' AS tokens FROM tok WHERE len(tokens) = 0")
def replace_rare(s, d):
    return M.replace_rare(tokens(s, d)).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id FROM documents), t AS (SELECT CAST(floor(k * CAST(n AS DOUBLE) / 20) AS BIGINT) AS i FROM (SELECT unnest(range(0, 20)) AS k) CROSS JOIN n) SELECT doc_id, i.i IN (SELECT i FROM t) AS is_test FROM i")
def holdout_split(s, d):
    return sources.hold_out(read_table(s, d, "documents").select("doc_id"), 20)


@query(f"WITH {_PAD}, dist AS (SELECT token, n / sum(n) OVER () AS p FROM ng WHERE ctx = 'the'), k AS (SELECT token, p FROM dist ORDER BY round(p, 12) DESC, token LIMIT 10), r AS (SELECT token, p / sum(p) OVER () AS p FROM k) SELECT token, round(pow(p, 2) / sum(pow(p, 2)) OVER (), 6) AS p FROM r")
def temperature_topk(s, d):
    x = M.NgramModel(tokens(s, d), 2, 0.0).continuations(["the"]).where("n > 0").select("token", "p")
    return M.apply_temperature(M.top_k_filter(x, 10), 0.5).select("token", F.round("p", 6).alias("p"))


@query(f"WITH {FREQ}, sy AS (SELECT term, n, list_concat(string_split(term, ''), ['</w>']) AS y FROM freq), pr AS (SELECT n, unnest(list_transform(range(1, len(y)), lambda i: y[i])) AS l, unnest(list_transform(range(1, len(y)), lambda i: y[i + 1])) AS r FROM sy) SELECT l, r, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY l, r")
def bpe_pair_counts(s, d):
    return B.pair_counts(freqs(s, d))


@query()
def bpe_merges(s, d):
    return B.train_bpe(materialize(freqs(s, d)), 100)


@query()
def bpe_encode(s, d):
    words = materialize(freqs(s, d))
    merges = [(r["l"], r["r"]) for r in B.train_bpe(words, 100).orderBy("rank").collect()]
    return B.encode_words(words, merges).select("term", "n", F.array_join("pieces", " ").alias("pieces"))


@query()
def bpe_pieces_per_word(s, d):
    return bpe_encode(s, d).agg(F.round(F.avg(F.size(F.split("pieces", " "))), 6).alias("pieces_per_word"))


_CO = "{LONG}, co AS (SELECT a.term, b.term AS ctx, count(*) AS n FROM lng a JOIN lng b ON a.doc_id = b.doc_id AND {cond} GROUP BY 1, 2)"
_CO2 = _CO.format(LONG=LONG, cond="b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos")


@query(f"WITH {_CO2} SELECT term, ctx, n FROM co")
def cooccurrence(s, d):
    return M.cooccurrence(tokens(s, d))


@query(f"WITH {_CO.format(LONG=LONG, cond='b.pos BETWEEN a.pos + 1 AND a.pos + 2')} SELECT term, ctx, n FROM co")
def cooccurrence_directed(s, d):
    return M.cooccurrence(tokens(s, d), symmetric=False)


_PPMI = f"{_CO2}, rs AS (SELECT term, sum(n) AS r FROM co GROUP BY term), t AS (SELECT sum(n) AS t FROM co), pp AS (SELECT term, ctx, round(greatest(ln(CAST(n AS DOUBLE) * t / (CAST(rs.r AS DOUBLE) * cs.r)), 0), 6) AS ppmi FROM co JOIN rs USING (term) JOIN rs cs ON ctx = cs.term CROSS JOIN t)"


@query(f"WITH {_PPMI} SELECT term, ctx, ppmi FROM pp")
def ppmi(s, d):
    half = M.half_pmi(M.half_cooccurrence(tokens(s, d)))
    return M.mirrored(half.select("term", "ctx", F.round("pmi", 6).alias("ppmi")), "ppmi")


@query(f"WITH {_PPMI} SELECT ctx, ppmi FROM pp WHERE term = 'the' AND ctx <> 'the' ORDER BY ppmi DESC, ctx LIMIT 10")
def top_associations(s, d):
    half = materialize(M.half_pmi(M.half_cooccurrence(tokens(s, d))).withColumnRenamed("pmi", "ppmi"))
    return M.top_associations(M.mirrored(half, "ppmi"), "the", 10)


#: The second signal that SQL can give: the cosine of the stored vectors that carry the ids of the query and the document.
_BOTH = f"""{WEIGHT}, sem AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b),
every AS (SELECT query_id, doc_id, coalesce(score.score, 0.0) AS lexical, coalesce(sem.score, 0.0) AS other FROM q CROSS JOIN documents LEFT JOIN score USING (query_id, doc_id) LEFT JOIN sem USING (query_id, doc_id))"""


def both_signals(s, d) -> DataFrame:
    v = read_table(s, d, "embeddings")
    q = questions(s, d)
    asked = small_side(materialize(v.join(q, v["vec_id"] == q["query_id"]).select("query_id", F.col("embedding").alias("q"))), 20_000)
    semantic = v.crossJoin(asked).select("query_id", F.col("vec_id").alias("doc_id"), F.round(M.cosine("embedding", "q"), 6).alias("score"))
    e = engine(s, d)
    return H.both(e.documents, q, e.scores(q), semantic)


_MM = "CASE WHEN max({c}) OVER (PARTITION BY query_id) > min({c}) OVER (PARTITION BY query_id) THEN ({c} - min({c}) OVER (PARTITION BY query_id)) / (max({c}) OVER (PARTITION BY query_id) - min({c}) OVER (PARTITION BY query_id)) ELSE 0.0 END"


@query(f"WITH {_BOTH}, m AS (SELECT query_id, doc_id, round(0.5 * ({_MM.format(c='lexical')}) + 0.5 * ({_MM.format(c='other')}), 6) AS score FROM every) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 5")
def minmax_fusion(s, d):
    return H.fused(both_signals(s, d), 0.5, 5)


@query(f"WITH {_BOTH}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY other DESC, doc_id) AS b FROM every), f AS (SELECT query_id, doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 6) AS score FROM r) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5")
def rrf_fusion(s, d):
    return H.fused(both_signals(s, d), 0.5, 5, "rrf")


@query(f"WITH {_BOTH}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY other DESC, doc_id) AS b FROM every) SELECT query_id, doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 6) AS score FROM r WHERE a <= 10 AND b <= 1000")
def rrf_of_rankings(s, d):
    """The fusion of two rankings as tables, for documents that both have."""
    x = both_signals(s, d)
    ranks = [S.best(x.select("query_id", "doc_id", F.col(c).alias("score")), k) for c, k in (("lexical", 10), ("semantic", 1000))]
    shared = ranks[0].join(ranks[1], ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id")
    return S.reciprocal_rank_fusion(ranks).join(shared, ["query_id", "doc_id"])


@query(f"WITH {WEIGHT}, top3 AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 3), rel AS (SELECT item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0), h AS (SELECT r.query_id, max(CASE WHEN t.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS hit FROM rel r LEFT JOIN top3 t ON r.query_id = t.query_id AND r.doc_id = t.doc_id GROUP BY r.query_id) SELECT round(avg(hit), 6) AS hit_rate FROM h")
def hit_rate_at_k(s, d):
    """Share of benchmark items, of those whose text a document holds, with such a document among the first three."""
    b = read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    rel = read_table(s, d, "documents").join(F.broadcast(b), F.contains("text", "item")).select("query_id", "doc_id")
    found = engine(s, d).search(questions(s, d), 3).select("query_id", "doc_id", F.lit(1.0).alias("hit"))
    hits = rel.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit"))
    return hits.agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


def _word_vectors(s, d) -> DataFrame:
    return E.load_vectors(tokens(s, d), k=24)


@query()
def svd_embeddings(s, d):
    return _word_vectors(s, d)


@query()
def hybrid_search(s, d):
    return H.HybridSearcher(tokens(s, d)).search(questions(s, d), 0.5, 5)


@query()
def hybrid_rrf(s, d):
    return H.HybridSearcher(tokens(s, d)).search(questions(s, d), 0.5, 5, "rrf")


@query()
def generate(s, d):
    return B.generate(M.NgramModel(tokens(s, d), 2, 0.0), s.range(0, 20).withColumnRenamed("id", "seed"), temperature=0.8, top_k=20)


@query(f"WITH {_PAD}, dist AS (SELECT ctx, token, n, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) AS r FROM ng), " + ", ".join([f"s{i} AS (SELECT text, token FROM (SELECT trim(p.text || ' ' || p.token) AS text, d.token FROM s{i - 1} p JOIN dist d ON d.ctx = p.token AND d.r = 1 WHERE p.token <> '</s>') UNION ALL SELECT text, token FROM s{i - 1} WHERE token = '</s>')" if i else "s0 AS (SELECT '' AS text, token FROM dist WHERE ctx = '<s>' AND r = 1)" for i in range(8)]) + " SELECT CAST(0 AS BIGINT) AS seed, trim(CASE WHEN token = '</s>' THEN text ELSE text || ' ' || token END) AS text FROM s7")
def generate_greedy(s, d):
    return B.generate(M.NgramModel(tokens(s, d), 2, 0.0), s.range(0, 1).withColumnRenamed("id", "seed"), max_tokens=8, greedy=True)


_CHARS = f"""chars AS (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[{_SP}]+', '', 'g') AS t FROM documents), cterm AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2))) AS term FROM chars),
cpost AS (SELECT doc_id, term, count(*) AS tf FROM cterm GROUP BY doc_id, term)"""


@query(f"WITH {_CHARS} SELECT doc_id, term, tf FROM cpost")
def char_analyzer(s, d):
    return C.postings(A.Analyzer("char", native=True).terms(read_table(s, d, "documents")))


_ENGINE = f"""{_CHARS}, cv AS (SELECT term, count(*) AS df FROM cpost GROUP BY term), cn AS (SELECT count(*) AS docs FROM documents),
cw AS (SELECT doc_id, term, tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((1.0 + docs) / (1.0 + df)) + 1) AS w FROM cpost JOIN cv USING (term) CROSS JOIN cn), cnorm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM cw GROUP BY doc_id),
qc AS (SELECT item_id AS query_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[{_SP}]+', '', 'g') AS t FROM benchmark), qt AS (SELECT query_id, unnest(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2))) AS term FROM qc),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qt JOIN cv USING (term) GROUP BY query_id, term), qw AS (SELECT query_id, term, tf / sum(tf) OVER (PARTITION BY query_id) * (ln((1.0 + docs) / (1.0 + df)) + 1) AS qw FROM qtf JOIN cv USING (term) CROSS JOIN cn),
qnorm AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY query_id), csc AS (SELECT query_id, doc_id, round(sum(w * qw) / (max(norm) * max(qnorm)), 6) AS score FROM cw JOIN qw USING (term) JOIN cnorm USING (doc_id) JOIN qnorm USING (query_id) GROUP BY query_id, doc_id),
cbest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM csc WHERE score > 0)"""


def char_engine(s, d) -> tuple[A.Engine, DataFrame]:
    asked = read_table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return A.Engine(read_table(s, d, "documents").select("doc_id", "text"), A.Analyzer("char", native=True)), asked


@query(f"WITH {_ENGINE} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM cbest WHERE rank <= 3")
def engine_search(s, d):
    e, asked = char_engine(s, d)
    return e.search(asked, 3)


@query(f"WITH {_ENGINE} SELECT query_id, doc_id, (SELECT string_agg(term, ' ' ORDER BY term) FROM (SELECT DISTINCT term FROM qt WHERE qt.query_id = cbest.query_id INTERSECT SELECT term FROM cpost WHERE cpost.doc_id = cbest.doc_id)) AS terms FROM cbest WHERE rank <= 1")
def shared_terms(s, d):
    e, asked = char_engine(s, d)
    return e.shared_terms(asked, e.search(asked, 1)).select("query_id", "doc_id", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {_ENGINE}, rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0), h AS (SELECT r.query_id, max(CASE WHEN t.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS hit FROM rel r LEFT JOIN (SELECT query_id, doc_id FROM cbest WHERE rank <= 3) t ON r.query_id = t.query_id AND r.doc_id = t.doc_id GROUP BY r.query_id) SELECT round(coalesce(avg(hit), 0), 6) AS hit_rate FROM h")
def engine_hit_rate(s, d):
    e, asked = char_engine(s, d)
    rel = read_table(s, d, "documents").select("doc_id", F.col("text").alias("whole")).join(F.broadcast(asked), F.contains("whole", "text"))
    cases = rel.groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant"))
    return A.hit_rate(e.search(asked, 3), cases).select(F.round("hit_rate", 6).alias("hit_rate"))


@query(f"WITH {POST}, {QTOK} SELECT DISTINCT term FROM qlng EXCEPT SELECT term FROM voc")
def vocabulary_difference(s, d):
    words = lambda t: t.select(F.explode(T.held("tokens")).alias("term"))
    return C.vocabulary_difference(words(questions(s, d)), words(tokens(s, d)))


@query("SELECT vec_id, array_to_string(list_transform(list_filter(range(0, len(embedding)), lambda i: floor(8 * CAST(embedding[i + 1] AS DOUBLE)) <> 0), lambda i: i || ':' || CAST(floor(8 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT)), ' ') AS cells FROM embeddings")
def to_sparse(s, d):
    whole = F.transform("embedding", lambda x: F.floor(8 * x.cast("double")))
    cells = F.transform(F.map_entries(C.to_sparse(whole)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return read_table(s, d, "embeddings").select("vec_id", F.array_join(cells, " ").alias("cells"))


@query(f"WITH {_CO2} SELECT round(1 - CAST(count(*) AS DOUBLE) / ((SELECT count(*) FROM (SELECT DISTINCT term FROM co)) * CAST((SELECT count(*) FROM (SELECT DISTINCT term FROM co)) AS DOUBLE)), 9) AS sparsity FROM co")
def cooccurrence_sparsity(s, d):
    half = materialize(M.half_cooccurrence(tokens(s, d)))
    return M.table_sparsity(M.mirrored(half)).select(F.round("sparsity", 9).alias("sparsity"))


@query(f"WITH {_PPMI.replace('greatest(', '(').replace(', 0), 6) AS ppmi', '), 6) AS pmi')} SELECT term, ctx, pmi FROM pp")
def pmi(s, d):
    half = M.half_pmi(M.half_cooccurrence(tokens(s, d)), positive=False)
    return M.mirrored(half.select("term", "ctx", F.round("pmi", 6).alias("pmi")), "pmi")


_UNIT = "unit AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS term, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def unit_vectors(s, d) -> DataFrame:
    return E.unit(read_table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<double>").alias("vec")))


@query(f"WITH {_UNIT} SELECT b.term, round({_DOT.format(a='a.u', b='b.u')}, 6) AS score FROM unit a JOIN unit b ON b.vec_id > 2 WHERE a.vec_id = 2 ORDER BY score DESC, term LIMIT 1")
def nearest_to_input(s, d):
    return E.WordVectors(unit_vectors(s, d)).nearest_to_input("0", "1", "2").select("term", "score")


@query(f"""WITH {_UNIT}, cases AS (SELECT a.vec_id AS i, a.u AS a, b.u AS b, c.u AS c, e.term AS expected FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1 JOIN unit c ON c.vec_id = a.vec_id + 2 JOIN unit e ON e.vec_id = a.vec_id + 3 WHERE a.vec_id % 100 = 0),
asked AS (SELECT i, 'x' AS ask, list_transform(range(1, len(a) + 1), lambda j: b[j] - a[j] + c[j]) AS t FROM cases UNION ALL SELECT i, 'b', b FROM cases UNION ALL SELECT i, 'c', c FROM cases),
sc AS (SELECT i, ask, term, round({_DOT.format(a='u', b='t')} / sqrt({_DOT.format(a='t', b='t')}), 6) AS score FROM asked JOIN unit ON vec_id NOT BETWEEN i AND i + 2),
f AS (SELECT i, ask, term FROM (SELECT *, row_number() OVER (PARTITION BY i, ask ORDER BY score DESC, term) AS r FROM sc) WHERE r = 1), g AS (SELECT i, max(CASE WHEN ask = 'x' THEN term END) AS x, max(CASE WHEN ask = 'b' THEN term END) AS b, max(CASE WHEN ask = 'c' THEN term END) AS c FROM f GROUP BY i)
SELECT count(*) AS cases, avg(CAST(x = expected AS INTEGER)) AS arithmetic, avg(CAST(g.b = expected AS INTEGER)) AS nearest_b, avg(CAST(g.c = expected AS INTEGER)) AS nearest_c, round(avg(CAST(x = g.b OR x = g.c AS INTEGER)), 6) AS agrees FROM cases JOIN g USING (i)""")
def evaluate_analogies(s, d):
    v = read_table(s, d, "embeddings").select("vec_id")
    name = lambda k: (F.col("vec_id") + k).cast("string")
    cases = v.where("vec_id % 100 = 0").select(name(0).alias("a"), name(1).alias("b"), name(2).alias("c"), name(3).alias("expected"))
    return E.evaluate_analogies(materialize(unit_vectors(s, d)), cases).withColumn("agrees", F.round("agrees", 6))


@query(f"WITH {POST}, v AS (SELECT term FROM voc WHERE df >= 2) SELECT term, round(ln((1.0 + docs) / (1.0 + df)) + 1, 6) AS idf FROM v JOIN voc USING (term) CROSS JOIN size")
def idf_of_vocabulary(s, d):
    t = tokens(s, d)
    index = materialize(C.postings(t))
    return C.checked_idf("smooth", index, C.vocabulary(index, t.count(), 2), t.count()).select("term", F.round("idf", 6).alias("idf"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
