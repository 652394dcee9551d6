"""Naive Bayes, n-gram language models, co-occurrence and PPMI: models as tables of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import counts
from quillspark.runtime import materialize, small_side


class NaiveBayes:
    """Multinomial; priors are not smoothed, unknown words are skipped, an empty document has its priors."""

    def __init__(self, labelled: DataFrame, alpha: float = 1.0) -> None:
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        docs = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
        self.classes = docs.withColumn("prior", F.ln(F.col("docs") / F.sum("docs").over(Window.partitionBy())))
        words = labelled.select("label", F.explode(T.held("tokens")).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
        self.vocab = words.select("term").distinct()
        totals = words.groupBy("label").agg(F.sum("n").alias("total"))
        size = self.vocab.agg(F.count(F.lit(1)).alias("v"))
        per_class = self.classes.join(totals, "label", "left").crossJoin(F.broadcast(size)).select("label", F.coalesce("total", F.lit(0)).alias("total"), "v")
        grid = self.vocab.crossJoin(F.broadcast(per_class)).join(words, ["label", "term"], "left")
        self.likelihood = grid.select("label", "term", F.ln((F.coalesce("n", F.lit(0)) + F.lit(alpha)) / (F.col("total") + alpha * F.col("v"))).alias("ll"))
        self.counts = words

    def scores(self, tokens: DataFrame) -> DataFrame:
        words = counts.postings(tokens).join(self.likelihood, "term").groupBy("doc_id", "label").agg(F.sum(F.col("tf") * F.col("ll")).alias("s"))
        every = tokens.select("doc_id").crossJoin(F.broadcast(self.classes.select("label", "prior")))
        return every.join(words, ["doc_id", "label"], "left").select("doc_id", "label", (F.col("prior") + F.coalesce("s", F.lit(0.0))).alias("log_score"))

    def proba(self, tokens: DataFrame) -> DataFrame:
        w = Window.partitionBy("doc_id")
        e = self.scores(tokens).withColumn("e", F.exp(F.col("log_score") - F.max("log_score").over(w)))
        return e.select("doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))

    def predict(self, tokens: DataFrame) -> DataFrame:
        """The label of the highest score, ties to the smallest; differences below 1e-9 of the score are the order of summing."""
        exact = F.bround(F.col("log_score"), 8)
        return self.scores(tokens).groupBy("doc_id").agg(F.min_by("label", F.struct(-exact, "label")).alias("label"))

    def top_features(self, k: int) -> DataFrame:
        w = Window.partitionBy("term").orderBy(F.desc("ll"), "label")
        x = self.likelihood.withColumn("first", F.first("ll").over(w)).withColumn("turn", F.row_number().over(w)).withColumn("second", F.nth_value("ll", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        ratio = F.round(F.col("ll") - F.coalesce(F.when(F.col("turn") == 1, F.col("second")).otherwise(F.col("first")), F.lit(0.0)), 6)
        r = x.select("label", "term", ratio.alias("log_ratio"))
        return r.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("log_ratio"), "term"))).where(F.col("rank") <= k)


def accuracy(judged: DataFrame) -> DataFrame:
    """judged: (predicted, actual)."""
    return judged.agg(F.coalesce(F.avg((F.col("predicted") == F.col("actual")).cast("double")), F.lit(0.0)).alias("accuracy"))


def confusion(judged: DataFrame) -> DataFrame:
    classes = judged.select(F.col("actual").alias("c")).union(judged.select("predicted")).distinct()
    grid = classes.select(F.col("c").alias("actual")).crossJoin(classes.select(F.col("c").alias("predicted")))
    return grid.join(judged.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")), ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


class NgramModel:
    """Additive smoothing over sentences (doc_id, tokens); the vocabulary has the end mark but not the start."""

    def __init__(self, sentences: DataFrame, n: int = 2, alpha: float = 1.0) -> None:
        if isinstance(n, bool) or not isinstance(n, int):
            raise TypeError("n must be an integer")
        if n < 1 or alpha < 0:
            raise ValueError("n must be at least 1 and alpha not negative")
        self.n, self.alpha = n, alpha
        self.sentences = sentences
        self.ngrams = self._counted(sentences)
        self.contexts = self.ngrams.groupBy("ctx").agg(F.sum("n").alias("ctx_n"))
        self.vocab = sentences.select(F.explode(T.held("tokens")).alias("token")).union(sentences.select(F.lit(T.EOS))).distinct()

    def _grams(self, sentences: DataFrame) -> DataFrame:
        padded = sentences.select("doc_id", T.pad(F.col("tokens"), self.n).alias("t"))
        shifted = (F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0))).alias(f"t{k}") for k in range(self.n))
        g = padded.select("doc_id", F.explode(F.arrays_zip(*shifted)).alias("g")).where(F.col(f"g.t{self.n - 1}").isNotNull())
        return g.select("doc_id", F.array(*(F.col(f"g.t{k}") for k in range(self.n - 1))).cast("array<string>").alias("ctx"), F.col(f"g.t{self.n - 1}").alias("token"))

    def _counted(self, sentences: DataFrame) -> DataFrame:
        return self._grams(sentences).groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("n"))

    def _chances(self, grams: DataFrame, *kept: str) -> DataFrame:
        """grams: (ctx, token, kept..., n) with n their count in the model, null if it has none."""
        size = self.vocab.agg(F.count(F.lit(1)).alias("v"))
        x = grams.join(self.contexts, "ctx", "left").crossJoin(F.broadcast(size))
        low = F.coalesce("ctx_n", F.lit(0)) + self.alpha * F.col("v")
        return x.select(*kept, "ctx", "token", F.when(low > 0, (F.coalesce("n", F.lit(0)) + self.alpha) / low).otherwise(0.0).alias("p"))

    def probabilities(self, sentences: DataFrame) -> DataFrame:
        return self._chances(self._grams(sentences).join(self.ngrams, ["ctx", "token"], "left"), "doc_id")

    def distinct_probabilities(self, sentences: DataFrame) -> DataFrame:
        """(ctx, token, p, times) of each n-gram of the sentences once, and how often they have it.

        They are counted first, and only then meet the model's tables; for the model's own sentences those counts are the model's.
        """
        if sentences is self.sentences:
            self._keep()
            return self._chances(self.ngrams.withColumn("times", F.col("n")), "times")
        own = self._counted(sentences).withColumnRenamed("n", "times")
        return self._chances(own.join(self.ngrams, ["ctx", "token"], "left"), "times")

    def _keep(self) -> None:
        """Count once, for all that follows."""
        self.ngrams = materialize(self.ngrams)
        self.vocab = self.ngrams.select("token").distinct()
        self.contexts = materialize(self.ngrams.groupBy("ctx").agg(F.sum("n").alias("ctx_n")))
        self.contexts = small_side(self.contexts)

    def log_probability(self, sentences: DataFrame) -> DataFrame:
        return self.probabilities(sentences).groupBy("doc_id").agg(F.when(F.min("p") <= 0, F.lit(float("-inf"))).otherwise(F.sum(F.ln("p"))).alias("logp"), F.count(F.lit(1)).alias("tokens"))

    def continuations(self, context: list[str]) -> DataFrame:
        ctx = context[len(context) - self.n + 1 :] if self.n > 1 else []
        held = F.array(*map(F.lit, ctx)) if ctx else F.array().cast("array<string>")
        seen = self.ngrams.where(F.col("ctx") == held)
        total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ctx_n"))
        size = self.vocab.agg(F.count(F.lit(1)).alias("v"))
        x = self.vocab.join(seen, "token", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size))
        low = F.col("ctx_n") + self.alpha * F.col("v")
        return x.select("token", F.when(low > 0, (F.coalesce("n", F.lit(0)) + self.alpha) / low).otherwise(0.0).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))


def replace_rare(sentences: DataFrame, min_count: int = 2) -> DataFrame:
    common = sentences.select(F.explode(T.held("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    x = counts.long(sentences).join(common, "term", "left").withColumn("term", F.when(F.col("n").isNull(), T.UNK).otherwise(F.col("term")))
    kept = x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]).alias("tokens"))
    return sentences.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def _ahead(tokens: DataFrame, window: int) -> DataFrame:
    """(term, ctx) of every position and the `window` that follow it."""
    shifted = (F.slice("tokens", k + 1, F.greatest(F.size("tokens") - k, F.lit(0))).alias(f"t{k}") for k in range(1, window + 1))
    x = tokens.select(F.explode(F.arrays_zip(T.held("tokens").alias("t0"), *shifted)).alias("x"))
    pairs = F.array(*(F.struct(F.col("x.t0").alias("term"), F.col(f"x.t{k}").alias("ctx")) for k in range(1, window + 1)))
    return x.select(F.explode(pairs).alias("p")).select("p.term", "p.ctx").where(F.col("ctx").isNotNull())


def half_cooccurrence(tokens: DataFrame, window: int = 2) -> DataFrame:
    """The cells (term, ctx, n) of cooccurrence() with term <= ctx; the others are mirrored() from them."""
    x = _ahead(tokens, window).select(F.least("term", "ctx").alias("term"), F.greatest("term", "ctx").alias("ctx"))
    # A word beside itself is seen from both places.
    return x.groupBy("term", "ctx").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("term") == F.col("ctx"), 2 * F.col("n")).otherwise(F.col("n")))


def mirrored(half: DataFrame, value: str = "n") -> DataFrame:
    """All cells (term, ctx, value) of a symmetric table of those with term <= ctx."""
    cell = lambda a, b: F.struct(F.col(a).alias("term"), F.col(b).alias("ctx"), F.col(value))
    return half.select(F.explode(F.when(F.col("term") == F.col("ctx"), F.array(cell("term", "ctx"))).otherwise(F.array(cell("term", "ctx"), cell("ctx", "term")))).alias("x")).select("x.*")


def cooccurrence(tokens: DataFrame, window: int = 2, symmetric: bool = True) -> DataFrame:
    """(term, ctx, n) over positions at most `window` apart; a word beside itself counts. Neighbours come from the array itself.

    Of a symmetric table each pair is counted once, which halves what is shuffled.
    """
    if symmetric:
        return mirrored(half_cooccurrence(tokens, window))
    return _ahead(tokens, window).groupBy("term", "ctx").agg(F.count(F.lit(1)).alias("n"))


def pmi(cells: DataFrame, positive: bool = True, epsilon: float = 0.0) -> DataFrame:
    """(term, ctx, pmi) of (term, ctx, n); marginals are those of the counts. positive: nothing below 0.

    epsilon is added to every cell of the square table, so with it all pairs of words come out, counted or not.
    """
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    if epsilon:
        names = cells.select("term").union(cells.select("ctx")).distinct()
        square = names.crossJoin(names.withColumnRenamed("term", "ctx"))
        cells = square.join(cells, ["term", "ctx"], "left").select("term", "ctx", (F.coalesce("n", F.lit(0)) + F.lit(float(epsilon))).alias("n"))
    cells = materialize(cells)
    rows = materialize(cells.groupBy("term").agg(F.sum("n").alias("r")))
    return _weighed(cells, rows, materialize(cells.groupBy("ctx").agg(F.sum("n").alias("c"))), positive)


def _weighed(cells: DataFrame, rows: DataFrame, cols: DataFrame, positive: bool) -> DataFrame:
    """(term, ctx, pmi) of cells and the marginals (term, r) and (ctx, c). Marginals too many to broadcast are hashed: the cells,
    which are many more, are dealt out but not sorted."""
    total = rows.agg(F.sum("r").alias("t"))
    rows, cols = (df.hint("broadcast" if df.count() <= 500_000 else "shuffle_hash") for df in (rows, cols))
    x = cells.join(rows, "term").join(cols, "ctx").crossJoin(F.broadcast(total))
    value = F.ln(F.col("n") * F.col("t") / (F.col("r").cast("double") * F.col("c")))
    return x.select("term", "ctx", (F.greatest(value, F.lit(0.0)) if positive else value).alias("pmi"))


def half_pmi(half: DataFrame, positive: bool = True) -> DataFrame:
    """pmi() of a symmetric table by its cells with term <= ctx: (term, ctx, pmi) of these, the others are mirrored() from them."""
    half = materialize(half)
    rows = materialize(mirrored(half).groupBy("term").agg(F.sum("n").alias("r")))
    return _weighed(half, rows, rows.select(F.col("term").alias("ctx"), F.col("r").alias("c")), positive)


def ppmi(cells: DataFrame) -> DataFrame:
    """(term, ctx, ppmi) of the counted cells."""
    return pmi(cells).withColumnRenamed("pmi", "ppmi")


def table_sparsity(cells: DataFrame, value: str = "n") -> DataFrame:
    """Share of zero cells in the square table that (term, ctx, value) stands for; 0 for no words."""
    size = cells.select("term").union(cells.select("ctx")).distinct().agg(F.count(F.lit(1)).alias("v"))
    filled = cells.agg(F.count(F.when(F.col(value) != 0, 1)).alias("filled"))
    return filled.crossJoin(size).select(F.when(F.col("v") > 0, 1 - F.col("filled") / (F.col("v") * F.col("v"))).otherwise(0.0).alias("sparsity"))


def top_associations(cells: DataFrame, word: str, k: int = 5, value: str = "ppmi") -> DataFrame:
    """The k contexts of highest value of a word, itself left out; zero cells fill up what is missing, by term. KeyError for an unknown word."""
    names = cells.select(F.col("term").alias("ctx")).union(cells.select("ctx")).distinct()
    if names.where(F.col("ctx") == word).isEmpty():
        raise KeyError(word)
    own = cells.where((F.col("term") == word) & (F.col("ctx") != word)).select("ctx", value)
    rest = names.where(F.col("ctx") != word).join(own.select("ctx"), "ctx", "left_anti").orderBy("ctx").limit(k).select("ctx", F.lit(0.0).alias(value))
    return own.unionByName(rest).select("ctx", F.round(value, 6).alias(value)).orderBy(F.desc(value), "ctx").limit(k)


def perplexity(model: NgramModel, sentences: DataFrame) -> DataFrame:
    """exp of the mean negative log probability of a token, end marks counted; infinite if any sentence is impossible."""
    if sentences.isEmpty():
        raise ValueError("no sentences")
    chances = model.distinct_probabilities(sentences)
    x = chances.agg(F.min("p").alias("least"), F.sum(F.col("times") * F.ln("p")).alias("logp"), F.sum("times").alias("n"))
    return x.select(F.when(F.col("least") <= 0, float("inf")).otherwise(F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"))


def apply_temperature(dist: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(token, p) with p to the power 1 / temperature, summing to one; a distribution of zeros stays."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    hot = F.pow("p", F.lit(1 / temperature))
    total = F.sum(hot).over(Window.partitionBy())
    return dist.withColumn("p", F.when(total > 0, hot / total).otherwise(F.col("p")))


def top_k_filter(dist: DataFrame, k: int) -> DataFrame:
    """The k most likely tokens (ties by token), summing to one."""
    if k < 1:
        raise ValueError("k must be at least 1")
    kept = dist.orderBy(F.desc(F.round("p", 12)), "token").limit(k)
    total = F.sum("p").over(Window.partitionBy())
    return kept.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.col("p")))


def smoothing_cost(model: NgramModel, context: list[str]) -> DataFrame:
    """(seen, cost): the probability of the continuations seen after a context, and what smoothing takes from them."""
    seen = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("p"))), F.lit(0.0))
    return model.continuations(context).agg(seen.alias("seen"), (1 - seen).alias("cost"))


def dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str, b: str) -> F.Column:
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def euclidean(a: str, b: str) -> F.Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))
