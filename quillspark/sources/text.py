"""Text sources: whole files, a synthetic corpus of sentences, and a hold-out split by place."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import placed


def whole_texts(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """(path, text), a row a file, as UTF-8. A path that is not there gives one row of `fallback`, if one is given."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        if fallback is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([(None, fallback)], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Who does what with what, and where: the slots of the synthetic sentences, by theme, so that words of a theme share contexts.
THEMES = {
    "farm": (("farmer", "shepherd", "miller"), ("feeds", "counts", "calls"), ("sheep", "goats", "hens"), ("barn", "field", "yard")),
    "sea": (("sailor", "captain", "diver"), ("steers", "mends", "sees"), ("ship", "boat", "raft"), ("harbour", "reef", "bay")),
    "school": (("teacher", "pupil", "clerk"), ("reads", "writes", "copies"), ("letter", "poem", "list"), ("classroom", "library", "hall")),
    "korean": (("학생", "선생님"), ("읽는다", "쓴다"), ("책을", "편지를"), ("교실에서", "도서관에서")),
}


def synthetic_corpus(spark: SparkSession, seed: int = 0, rare: int = 8) -> DataFrame:
    """(doc_id, tokens): every combination of each theme's slots once, and `rare` sentences with a word found nowhere else; the same for one seed."""
    rng = random.Random(seed)
    rows = []
    for name, (who, does, what, where) in THEMES.items():
        for a in who:
            for b in does:
                for c in what:
                    for d in where:
                        rows.append([a, d, c, b] if name == "korean" else ["the", a, b, "the", c, "in", "the", d])
    rng.shuffle(rows)
    rows += [["the", "stranger", "whispers", f"word{rng.randrange(10**6)}x{i}"] for i in range(rare)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, tokens array<string>")


def hold_out(docs: DataFrame, held_out: int = 20, id_col: str = "doc_id") -> DataFrame:
    """`docs` with is_test: of N rows in order of id, those at floor(i N / held_out) for i from 0; ids are counted by ranges, in no single task."""
    n = docs.count()
    if held_out < 0 or (held_out and held_out >= n):
        raise ValueError(f"held_out is {held_out}, of {n} rows")
    picks = [i * n // held_out for i in range(held_out)]
    return placed(docs, id_col, name="_place").withColumn("is_test", F.col("_place").isin(picks) if picks else F.lit(False)).drop("_place")
