"""URL filters: pattern rules indexed by their rarest literal token, so that a URL runs few regular expressions.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) any matching URL must have. How often tokens
occur is counted over all URLs; each rule is filed under its rarest. A URL's own tokens fetch the candidate rules from
the index, and only those run. Rules without a token are candidates for every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import ship

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A rule whose pattern is searched in host + path. Among fitting rules the one of highest rank, then first, wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    shown: bool = True  # whether the name is given in the `rule` column


def host_rule(verdict: str, rule: str) -> Rule:
    """`host/path`: fits the host and its subdomains, for paths that start with /path. Longer rules rank higher."""
    host, slash, path = rule.partition("/")
    # Path text may be cut inside a URL's token, so only whole tokens between separators count as literal ones.
    inner = TOKEN.findall(path.lower())[: None if re.search("[^A-Za-z0-9]$", path) else -1]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}\Z" if not slash else rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", (*TOKEN.findall(host.lower()), *inner), 1000 + len(rule))


BASE = tuple(host_rule(v, r) for v, r in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")))
#: What is judged where no base rule fits: hosts of well-known kinds of spam, else allow.
SPAM = (
    Rule("spam farm", "block", r"^[^/]*\bspam-farm\b", ("spam", "farm"), 3, False),
    Rule("cheap pills", "block", r"^[^/]*\bcheap-pills\b", ("cheap", "pills"), 3, False),
    Rule("casino", "block", r"^[^/]*\bcasino\b", ("casino",), 3, False),
    Rule("porn", "block", r"^[^/]*\bporn\b", ("porn",), 3, False),
    Rule("warez", "block", r"^[^/]*\bwarez\b", ("warez",), 3, False),
    Rule("torrent files", "block", r"\.torrent$", ("torrent",), 2, False),
    Rule("link exchange", "block", r"/link-exchange(?:/|$)", ("link", "exchange"), 2, False),
)


def url_tokens(column: F.Column) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), 1))


def rarest_tokens(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it; '' holds those without a token. Counts are over all rows."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(wanted, 0)
    found = pages.select(F.explode(url_tokens(F.col(url_col))).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count()
    counts |= {r[0]: r[1] for r in found.collect()}  # one row a token of the rules
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts[t], t), default=""), []).append(k)
    return index


def split_url(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = BASE + SPAM, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per row of `pages`: id_col, host, path, rule, verdict.

    A null URL and one without :// have an empty host and path, fit no rule, and are allowed. Ties of rank go to the rule that
    stands first. Rows are independent: repeated rows repeat, an empty table gives no rows, other columns are not read.
    """
    ship(pages.sparkSession)
    index = rarest_tokens(pages, rules, url_col)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            out = []
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                host, path = split_url(url or "")
                text = host + path
                numbers = {k for t in ("", *TOKEN.findall(text.lower())) for k in index.get(t, ())}
                fits = [k for k in numbers if ready[k].search(text)]
                best = rules[min(fits, key=lambda k: (-rules[k].rank, k))] if fits else None
                out.append((host, path, best.name if best and best.shown else None, best.verdict if best else "allow"))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), *(pa.array(c, pa.string()) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
