"""Text functions as Column expressions; Unicode forms, which Spark lacks, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillspark.runtime import ship

#: What Python calls white space, and its word characters, as Java classes.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = rf"[\p{{L}}\p{{N}}_]+(?:'[\p{{L}}\p{{N}}_]+)?|[^\p{{L}}\p{{N}}_{SPACE}]"
#: WORD without its single characters; nothing follows a run, so it need not give any of it back.
RUN = r"[a-z0-9_\p{L}\p{N}]++(?:'[a-z0-9_\p{L}\p{N}]++)?+"
BOS, EOS, UNK = "<s>", "</s>", "<unk>"
# The English stop words, contraction tails included.
STOPWORDS = tuple(
    """
    a an the
    and but or nor so yet
    if then else than because while
    as at by for from in into of off on onto out over to under up with
    about after again against before below between down during further once
    here there when where why how
    all any both each few more most other some such only own same too very
    is am are was were be been being
    do does did doing done
    have has had having
    can could will would shall should may might must
    i me my myself we us our ours ourselves
    you your yours yourself yourselves
    he him his she her hers it its they them their theirs
    this that these those what which who whom
    no not nor none
    s t d ll m o re ve y
    """.split()
)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value bound to a variable, so that lambdas inside do not compute it for each element."""
    return F.transform(F.array(value), body)[0]


def tokenize_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda t: t != "")


def tokenize_words(text: Column) -> Column:
    """Words with at most one apostrophe part, and each other visible character on its own."""
    return F.regexp_extract_all(F.replace(text, F.lit("’"), F.lit("'")), F.lit(WORD), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), f"(?<=[.!?])[{SPACE}]+", -1), lambda t: t != "")


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def fold_native(text: Column) -> Column:
    """Case folding for text in which sharp s is the only letter that folds to more than lower() gives."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold(text: Column) -> Column:
    """Full case folding."""
    return F.pandas_udf(lambda s: s.map(str.casefold, na_action="ignore"), "string")(text)


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")
    return F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore"), "string")(text)


def _unaccented(x: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def strip_accents(text: Column) -> Column:
    ship(SparkSession.getActiveSession())
    return F.pandas_udf(lambda s: s.map(_unaccented, na_action="ignore"), "string")(text)


def strip_punctuation(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]"))


def remove_stopwords(tokens: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    held = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(tokens, lambda t: ~F.array_contains(held, fold_native(t)))


def normalize(text: Column, native: bool = False) -> Column:
    """The engine's tokens: composed, folded, words only; stop words stay. native: for text known to be composed.

    Of what tokenize_words() gives only runs can hold a letter or digit, and of runs only those with `_` can hold none.
    """
    folded = fold_native(text) if native else fold(normalize_unicode(text))
    runs = F.regexp_extract_all(F.replace(folded, F.lit("’"), F.lit("'")), F.lit(RUN), 0)
    return F.when(F.contains(text, F.lit("_")), strip_punctuation(runs)).otherwise(runs)


def held(items: str) -> Column:
    """An array column to explode. Of a column by its bare name Spark infers filters (not null, not empty) and moves them below the
    projection that makes it, so that all texts are cut into words twice more."""
    return F.coalesce(F.col(items), F.array())


def normalize_full(text: Column, lowercase: bool = True, accents: bool = False, drop_punctuation: bool = True, drop_stopwords: bool = True, stopwords: tuple[str, ...] = STOPWORDS, native: bool = False) -> Column:
    text = normalize_whitespace(text if native else normalize_unicode(text))
    if lowercase:
        text = fold_native(text) if native else fold(text)
    tokens = tokenize_words(strip_accents(text) if accents else text)
    tokens = strip_punctuation(tokens) if drop_punctuation else tokens
    return remove_stopwords(tokens, stopwords) if drop_stopwords else tokens


def ngrams(tokens: Column, n: int) -> Column:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("n must be an integer")
    if n < 1:
        raise ValueError("n must be at least 1")
    none = F.array().cast("array<array<string>>")
    return once(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.slice(t, i, n))).otherwise(none))


def pad(tokens: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), n - 1), tokens, F.array(F.lit(EOS)))


def folded_char_ngrams(text: Column, n: int = 2, native: bool = False) -> Column:
    """Letter n-grams of the folded, composed text without blanks; punctuation stays. native: for text known to be composed."""
    return char_ngrams(fold_native(text) if native else normalize_unicode(fold(text)), n, True, True)


def char_ngrams(text: Column, n: int, strip_spaces: bool = False, native: bool = False) -> Column:
    """Windows of n code points of the composed text. native: for text known to be composed."""
    if n < 1:
        raise ValueError("n must be at least 1")
    text = text if native else normalize_unicode(text)
    text = F.regexp_replace(text, f"[{SPACE}]+", "") if strip_spaces else text
    # One walk over the text: substring() would count its way to each place from the start. The second half of a pair of
    # UTF-16 units is no place of its own.
    windows = F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), 1)
    return F.coalesce(windows, F.array().cast("array<string>"))


def with_bigrams(tokens: Column) -> Column:
    return once(tokens, lambda t: F.concat(t, F.transform(ngrams(t, 2), lambda g: F.array_join(g, "_"))))
