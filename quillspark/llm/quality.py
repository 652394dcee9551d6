"""Quality rules: fixed rules on word statistics, then robust multivariate outliers per language and source.

The minimum covariance determinant estimate of each (language, source) is fitted on all its rows by concentration steps
from several deterministic starts (medians and MADs; means and covariances of all rows): keep the nearest three quarters
and estimate anew, until no determinant falls any more; of a group's starts the least determinant wins. Each step is two
aggregations; only moments (a few numbers a group) leave the table, and the table of estimates is sent to the rows, so that
a group is never gathered in one task. FLOOR keeps directions in which most rows agree exactly from counting as certain.
Groups of too few rows are judged by their language's estimate, and languages of too few by that of all rows. Rows whose
squared Mahalanobis distance is above the chi-square quantile of `cutoff` are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import WordHashes, byte_rows, windows
from quillspark.runtime import materialize, ship, small_side

SYMBOLS = b"#*$%&|<>"
FEATURES = ("f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_line_length")
#: Standard deviations added to each transformed statistic's own.
FLOOR = (0.08, 0.06, 0.2, 0.2, 0.4)
#: The point that a normal row's squared distance in 5 dimensions passes once in 100,000.
CUTOFF = 30.86
#: For the nearest 75 % of normal rows in 5 dimensions: 0.75 / P(chi2_7 <= q), q the 75 % point of chi2_5.
CONSISTENCY = 1.41


def _statistics(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    repeats = 0
    if n >= 4:
        found = windows(hashes.of(words), 3)
        order = np.argsort(found, kind="stable")
        sorted_ = found[order]
        same = sorted_[1:] == sorted_[:-1]
        if same.any():
            twice = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                twice[at + k] = True
            repeats = int(twice.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the `keep` columns of every row."""
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in byte_rows(batches, text_col):
            found = np.array([_statistics(t, hashes) if t else (0,) * 6 for t in texts], np.int64).reshape(len(texts), 6)
            own = [part.column(part.schema.get_field_index(c)) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found.T)], names=[id_col, *keep, *names])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep)), *(f"{n} long" for n in names)])
    return docs.select(id_col, text_col, *keep).mapInArrow(run, fields)


def _distance() -> F.Column:
    return F.expr(" + ".join(f"({FEATURES[i]} - mean[{i}]) * ({FEATURES[j]} - mean[{j}]) * precision[{i * len(FEATURES) + j}]" for i in range(len(FEATURES)) for j in range(len(FEATURES))))


def _invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    p = len(FEATURES)
    for rows in batches:
        means, precisions, sizes = [], [], []
        for n, s, ss in zip(rows["n"], rows["s"], rows["ss"], strict=True):
            mean = np.array(s, float) / n
            cov = np.array(ss, float).reshape(p, p) / n - np.outer(mean, mean)
            cov = CONSISTENCY * cov + np.diag(np.square(FLOOR))
            means.append(mean)
            precisions.append(np.linalg.inv(cov).ravel())
            sizes.append(float(np.linalg.slogdet(cov)[1]))
        yield pd.DataFrame({"cell": rows["cell"], "start": rows["start"], "mean": means, "precision": precisions, "log_det": sizes})


_FIT = "cell long, start int, mean array<double>, precision array<double>, log_det double"


def _moments(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("cell", "start").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in FEATURES for b in FEATURES]).alias("ss"))
    return sums.mapInPandas(_invert, _FIT)


def fit_groups(good: DataFrame, steps: int) -> DataFrame:
    """(cell, mean, precision, log_det) of rows (cell, features): the least determinant of the starts after concentration."""
    p = len(FEATURES)
    sent = lambda x: small_side(x, 100_000)
    medians = sent(materialize(good.groupBy("cell").agg(F.array(*[F.percentile_approx(f, 0.5, 1000) for f in FEATURES]).alias("mean"))))
    spread = good.join(medians, "cell").groupBy("cell").agg(*[F.percentile_approx(F.abs(F.col(f) - F.col("mean")[i]), 0.5, 1000).alias(f"mad{i}") for i, f in enumerate(FEATURES)], F.first("mean").alias("mean"))
    diagonal = [1 / (F.pow(1.4826 * F.col(f"mad{i}"), 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    robust = spread.select("cell", F.lit(0).alias("start"), "mean", F.array(*diagonal).alias("precision"), F.lit(float("inf")).alias("log_det"))
    fit = materialize(robust.unionByName(_moments(good.withColumn("start", F.lit(1)))))
    best = None
    for _ in range(steps):
        near = good.join(sent(fit.drop("log_det")), "cell").withColumn("d", _distance()).select("cell", "start", "d", *FEATURES)
        most = sent(materialize(near.groupBy("cell", "start").agg(F.percentile_approx("d", 0.75, 1000).alias("most"))))
        now = materialize(_moments(near.join(most, ["cell", "start"]).where("d <= most")))
        then = fit.select("cell", "start", F.col("log_det").alias("was"))
        falling = now.join(then, ["cell", "start"]).where("was is null or log_det < was - 1e-3").limit(1)
        fit = now
        best = now if best is None else materialize(best.unionByName(now).groupBy("cell", "start").agg(F.min_by(F.struct("mean", "precision", "log_det"), F.col("log_det")).alias("x")).select("cell", "start", "x.*"))
        if falling.isEmpty():
            break
    return best.groupBy("cell").agg(F.min_by(F.struct("mean", "precision", "log_det"), F.struct("log_det", "start")).alias("x")).select("cell", "x.*")


def quality_rules(docs: DataFrame, steps: int = 8, cutoff: float = CUTOFF, least_rows: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, judged_by, kept.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. Such rows are not kept, have no distance
    and take no part in the fit. Null is a language or source like others. judged_by: `source` where a (language, source) has
    `least_rows` fitted rows, else `language` where the language has, else `all`. A null text has no words; a text is read
    whole, however long. Repeated rows count each. No rows give no rows.
    """
    rows = statistics(docs, id_col, text_col, (lang_col, source_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sq = lambda a, b: F.sqrt(F.col(a) / F.col(b))
    lang, source = (F.coalesce(F.col(f"`{c}`"), F.lit("\x00")) for c in (lang_col, source_col))
    rows = rows.withColumn("base_failed", failed).withColumn("cells", F.array(F.xxhash64(lang, source), F.xxhash64(lang), F.lit(0).cast("long")))
    made = (F.ln(F.col("word_chars") / F.col("n_words")), sq("n_symbols", "word_chars"), sq("n_dup_lines", "n_lines"), sq("n_repeat_words", "n_words"), F.ln(F.col("n_words") / F.col("n_lines")))
    for name, value in zip(FEATURES, made, strict=True):
        rows = rows.withColumn(name, F.when(~F.col("base_failed"), value))
    rows = materialize(rows.drop(lang_col, source_col))
    good = rows.where("not base_failed").select("cells", *FEATURES)

    levels = ("source", "language", "all")
    counts = good.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.select(F.posexplode("cells").alias("level", "cell"), "n").groupBy("level", "cell").agg(F.sum("n").alias("n"))
    # A level's estimate is wanted where a cell below it is too small, and is then fitted on all rows of the level.
    sized = materialize(counts.withColumn("i", F.monotonically_increasing_id()).select("i", "cells", F.posexplode("cells").alias("level", "cell")).join(sizes, ["level", "cell"]).groupBy("i", "cells").agg(F.min(F.when((F.col("n") >= least_rows) | (F.col("level") == 2), F.col("level"))).alias("use")))
    use = small_side(sized.select("cells", "use"), 100_000)
    wanted = small_side(materialize(sized.select(F.get("cells", F.col("use")).alias("cell")).distinct()), 100_000)
    fitted = materialize(good.select(F.explode("cells").alias("cell"), *FEATURES).join(wanted, "cell", "left_semi"))
    fit = small_side(materialize(fit_groups(fitted, steps)), 100_000)
    placed = rows.join(use, "cells", "left").withColumn("cell", F.get("cells", F.col("use")))
    judged = placed.join(fit, "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    by = F.when(~F.col("base_failed"), F.get(F.array(*map(F.lit, levels)), F.col("use")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", by.alias("judged_by"), kept.alias("kept"))
