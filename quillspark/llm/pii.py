"""Personal data: fixed patterns, then information-theoretic sanitisation. DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns. Their values are the protected entities, and so are their
classes (a mail's domain, a network, the first digits of a number), as a value of its own is often named once. Words that stand near an entity are counted over the corpus: a term discloses an entity when, of the documents that hold the
term, a large part names the entity near it, and more than chance would have it (normalised pointwise mutual information).
Terms above the thresholds become spans of kind `term` wherever they stand, and are generalised with the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import materialize, small_side

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
#: Each finds what its plain form does; possessive parts and look-behinds only spare steps that cannot match.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without this a text has no match.
GUARD = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SPAN = "array<struct<start:int,kind_no:int,stop:int,value:string>>"
_WIDE = _SPAN.replace("value:string", "value:string,before:string,after:string")


#: Matches whose places are summed up together.
_RUN = 128


def _running(sizes: Column) -> Column:
    """Sums of an array of ints up to and with each element, in runs, so that long arrays are not copied for each element."""
    none = F.array().cast("array<int>")
    sums = lambda x: F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))
    blank = F.when(F.size(sizes) == 0, F.array().cast("array<array<int>>"))
    runs = blank.otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _RUN).cast("int")), lambda i: sums(F.slice(sizes, i * _RUN + 1, _RUN))))

    def joined(r: Column) -> Column:
        ends = sums(F.transform(r, lambda x: F.element_at(x, -1)))
        return F.transform(F.array(ends), lambda e: F.flatten(F.transform(r, lambda x, i: F.transform(x, lambda v: v + F.when(i == 0, 0).otherwise(F.get(e, i - 1))))))[0]

    return F.transform(F.array(runs), joined)[0]


def _matches(text: Column, pattern: str, kind: str, window: int = 0) -> Column:
    """All matches in order, with code point positions: what splitting leaves between them gives where they stand.

    With a window also what stands before and after each, up to the next match; so no span walks through the whole text.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    held = F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))

    def spans(x: Column) -> Column:
        sizes = F.transform(x["hits"], lambda h, i: F.length(F.get(x["gaps"], i)) + F.length(h))
        placed = F.arrays_zip(x["hits"].alias("hit"), _running(sizes).alias("stop"), x["gaps"].alias("gap"), F.slice(x["gaps"], 2, F.size(x["gaps"])).alias("next"))
        sides = lambda p: (F.substring(p["gap"], -window, window).alias("before"), F.substring(p["next"], 1, window).alias("after")) if window else ()
        found = F.filter(placed, lambda p: p["hit"].isNotNull())
        return F.transform(found, lambda p: F.struct((p["stop"] - F.length(p["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), p["stop"].alias("stop"), p["hit"].alias("value"), *sides(p)))

    return F.transform(F.array(held), spans)[0].cast(_WIDE if window else _SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    backward = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(d == "", 0).otherwise(d.cast("int") * (1 + i % 2)))
    return F.aggregate(backward, F.lit(0).cast("long"), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(value)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str, window: int = 0) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind], kind, window), lambda s: _valid(kind, s["value"]))
    may = F.contains(text, F.lit(GUARD[kind])) if kind in GUARD else text.rlike("[0-9]")
    return F.when(may, found).otherwise(F.array().cast(_WIDE if window else _SPAN))


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def generalise(text: Column, spans: Column) -> Column:
    """text with each span (in order, none inside another) replaced by its kind in angle brackets."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind_no"] + 1)).alias("out"))))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def disclosing_terms(named: DataFrame, terms: DataFrame, documents: int, least_texts: int, least_share: float, least_npmi: float) -> DataFrame:
    """(term) whose use discloses an entity. named: (digest, entity, term, copies) near entities; terms: (term, n_term) over all texts."""
    near = named.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    entities = named.select("digest", "entity", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    x = near.join(entities, "entity").join(terms, "term")
    both = F.col("n_both") / documents
    pmi = F.log2(both * documents / F.col("n_term") * documents / F.col("n_entity"))
    return x.where((F.col("n_both") >= least_share * F.col("n_term")) & ((both >= 1) | (pmi / -F.log2(both) >= least_npmi))).select("term").distinct()


def find_personal_data(docs: DataFrame, window: int = 80, least_texts: int = 3, least_share: float = 0.5, least_npmi: float = 0.5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: id_col, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans [, text generalised].

    A null text is empty. Positions are code points, ends exclusive. Terms are words of three letters or more within `window`
    characters of an entity, in at least `least_texts` different texts that name it or its class. Copies of a text count as documents but
    not as different texts. Terms inside base spans add none. Repeated rows repeat; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = F.array_sort(F.concat(*(base_spans(F.col("text"), k, window) for k in KINDS[:4])))
    base = base.withColumn("wide", found)
    near = F.transform("wide", lambda s: F.struct(F.array(F.xxhash64(s["kind_no"], s["value"]), F.xxhash64(s["kind_no"], _class(s), F.lit("class"))).alias("entities"), _context(s, window).alias("terms")))
    plain = F.transform("wide", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind_no", "stop", "value"))))
    base = materialize(base.select(id_col, "digest", plain.alias("base"), F.when(F.size("wide") > 0, near).alias("near")))

    near = base.where("near is not null")
    copies = near.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    named = near.select("digest", F.explode("near").alias("x")).select("digest", F.explode("x.entities").alias("entity"), "x.terms").select("digest", "entity", F.explode("terms").alias("term")).distinct().join(copies, "digest")
    named = materialize(named)
    wanted = materialize(named.groupBy("entity", "term").count().where(F.col("count") >= least_texts).select("term").distinct())
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    if wanted.isEmpty():  # no term is named with an entity often enough, so none is judged
        extra = base.select("digest").limit(0).withColumn("terms", F.array().cast(_SPAN))
    else:
        # Only counts by term and the texts with a disclosing term leave their task, never a row for each word of each text.
        words = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))).alias("term"))
        terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
        # A text's term and entity counts are in rows, so each document counts.
        flagged = small_side(materialize(disclosing_terms(named, terms, docs.count(), least_texts, least_share, least_npmi)))
        told = words.join(flagged, "term", "left_semi").groupBy("digest").agg(F.collect_set("term").alias("flagged"))  # a text's own words at most
        told = small_side(materialize(told), 200_000)
        texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text")).join(told, "digest")
        own = F.filter(_matches(F.col("text"), TERM, "term"), lambda s: F.array_contains(F.col("flagged"), F.lower(s["value"])))
        extra = texts.select("digest", own.alias("terms")).groupBy("digest").agg(F.first("terms").alias("terms"))
    free = F.filter(F.coalesce("terms", F.array().cast(_SPAN)), lambda t: ~F.exists("base", lambda b: (t["start"] < b["stop"]) & (t["stop"] > b["start"])))
    out = base.join(extra, "digest", "left").withColumn("added", free).withColumn("all", F.array_sort(F.concat("base", "added")))
    count = lambda k: F.size(F.filter("all", lambda s: s["kind_no"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    out = out.select(id_col, "digest", *map(count, KINDS), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("all")).alias("spans"), "all")
    if not with_text:
        return out.drop("digest", "all")
    spans = out.groupBy("digest").agg(F.first("all").alias("all"))
    own = docs.withColumn("digest", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(spans, "digest")
    return own.withColumn(text_col, generalise(F.coalesce(F.col(text_col), F.lit("")), F.col("all"))).drop("digest", "all")


def _class(span: Column) -> Column:
    """What a protected value shares with others of its kind: a mail's domain, a network, the first digits of a number."""
    value = span["value"]
    return F.when(span["kind_no"] == 0, F.lower(F.substring_index(value, "@", -1))).when(span["kind_no"] == 1, F.substring_index(value, ".", 2)).otherwise(F.substring(_digits(value), 1, 6))


def _context(span: Column, window: int) -> Column:
    """The distinct terms within `window` characters before and after a span, up to the next of its kind; words cut at the far ends do not count."""
    before, after = span["before"], span["after"]
    before = F.when(F.length(before) == window, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = F.when(F.length(after) == window, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), after)), F.lit(TERM), 0))
