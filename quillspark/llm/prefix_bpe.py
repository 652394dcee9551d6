"""Exact byte-pair token counts at every prefix of a text, by dynamic programming over prefixes.

A token sequence is the BPE encoding of its bytes exactly when each two neighbours, encoded together, give
just these two tokens again. So a prefix has one last token that fits the encoding of what stands before it:
    count(prefix) = count(prefix without its last token) + 1
and one pass over a piece (what the tokenizer's split pattern gives) fills a row of counts, one for each of its prefixes:
at each place the tokens that end there come from an automaton, longest first, and the first that may follow the last token
of what stands before it is taken. Pieces are independent, so a text's count is the running sum over its pieces, and a
cut inside a piece is answered by that piece's row, without encoding anything again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from functools import cached_property
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

BYTES = {}
for _i, _b in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)]):
    BYTES[chr(_b)] = _b
for _i, _b in enumerate(b for b in range(256) if b not in set(BYTES.values())):
    BYTES[chr(256 + _i)] = _b

#: Above this code point the library's own splitter is asked, as Unicode versions may differ.
PLAIN = re.compile("[^\x00-ɏ]")
#: A run of blanks of this length is more than the fast encoder's pattern can take.
BLANKS = re.compile(r"\s{1000}")


def _class(kind: str) -> str:
    """The code points up to U+024F of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_S = "\t-\r \x85\xa0"
#: The split pattern for text up to U+024F, with its classes written out.
SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class _Counts(dict):
    """piece -> its token count. At a bound all become the old generation, from which those asked for again come back."""

    def __init__(self, row, limit: int) -> None:
        super().__init__()
        self.row, self.limit, self.old = row, limit, {}

    def __missing__(self, piece: str) -> int:
        count = self.old.get(piece)
        if count is None:
            count = self.row(piece.encode())[0][-1]
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = count
        return count


class PrefixBPE:
    """Tables of one tokenizer file. Caches are cleared at `limit` entries each; they only save time."""

    def __init__(self, path: str, limit: int = 200_000) -> None:
        self.path, self.limit = path, limit
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        decode = lambda t: bytes(BYTES[c] for c in t)
        self.special = {t["content"]: t["id"] for t in held["added_tokens"] if t["special"]}
        self.ids = {decode(t): i for t, i in held["model"]["vocab"].items() if t not in self.special}
        self._merges = held["model"]["merges"]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.counts = _Counts(self.row, limit)

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def fast(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ids, special_tokens={})

    @cached_property
    def _rules(self) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, tuple[int, int, int]]]:
        """(left, right) -> (rank, token); token -> (rank, left, right) of the merge that makes it."""
        pairs, made = {}, {}
        for rank, m in enumerate(self._merges):
            a, b = (bytes(BYTES[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))
            left, right, token = self.ids[a], self.ids[b], self.ids[a + b]
            pairs[left, right] = rank, token
            made.setdefault(token, (rank, left, right))
        return pairs, made

    @cached_property
    def _ends(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for token, i in self.ids.items():
            found.add_word(token.decode("latin-1"), (i, len(token)))
        found.make_automaton()
        return found

    @cached_property
    def _fits(self) -> dict[int, bool]:
        return {}

    def follows(self, before: int, token: int) -> bool:
        """Whether the two tokens, encoded together, stay the two.

        They do unless a merge over their border comes before the merges that closed it. So the merges of both sides are undone,
        the latest first; what then touches the border is asked for a rule that would have come earlier (of equal ones the
        left wins).
        """
        key = before << 32 | token
        if (known := self._fits.get(key)) is not None:
            return known
        pairs, made = self._rules
        left, right, over = before, token, (1 << 60, 1)
        while True:
            rule = pairs.get((left, right))
            if rule is not None and (rule[0], 0) < over:
                known = False
                break
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                known = True
                break
            if b is None or (a is not None and a[0] > b[0]):
                left, over = a[2], (a[0], 0)
            else:
                right, over = b[1], (b[0], 1)
        if len(self._fits) >= self.limit:
            self._fits.clear()
        self._fits[key] = known
        return known

    def row(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For every prefix of a piece, by its length: how many tokens it has, and how long the last is."""
        n = len(piece)
        count, width, last = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        follows = self.follows
        for at, (token, size) in self._ends.iter(piece.decode("latin-1")):
            end = at + 1
            if width[end]:
                continue
            start = end - size
            if not start or follows(last[start], token):
                count[end], width[end], last[end] = count[start] + 1, size, token
        return count, width

    def tokens(self, piece: bytes) -> list[bytes]:
        """The encoding of a piece, read backward from its row."""
        width, out, at = self.row(piece)[1], [], len(piece)
        while at:
            out.append(piece[at - width[at] : at])
            at -= width[at]
        return out[::-1]

    def pieces(self, text: str) -> list[str]:
        """What the split pattern makes of a text without special tokens."""
        if not text.isascii() and PLAIN.search(text):
            return [bytes(BYTES[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def split(self, text: str) -> list[tuple[bool, str]]:
        """(special, part) in order."""
        if not self.marks or not self.marks.search(text):
            return [(False, text)] if text else []
        out, at = [], 0
        for m in self.marks.finditer(text):
            if m.start() > at:
                out.append((False, text[at : m.start()]))
            out.append((True, m[0]))
            at = m.end()
        return [*out, (False, text[at:])] if at < len(text) else out

    def ids_of(self, text: str) -> np.ndarray:
        """All ids of a text (unsigned 32-bit), special strings as their tokens (the library's default)."""
        parts = []
        for special, part in self.split(text):
            if special:
                parts.append(np.array([self.special[part]], np.uint32))
            elif not part.isascii() and PLAIN.search(part) or BLANKS.search(part):
                parts.append(np.array(self.library.encode(part, add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(np.array(self.fast.encode_ordinary(part), np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

    def cells(self, text: str) -> tuple[list[str], list[int]]:
        """The text's pieces (special marks are pieces too), and the tokens up to the end of each."""
        if not self.marks or not self.marks.search(text):
            own = self.pieces(text)
            return own, list(accumulate(map(self.counts.__getitem__, own)))
        own, each = [], []
        for special, part in self.split(text):
            found = [part] if special else self.pieces(part)
            own += found
            each += [1] if special else map(self.counts.__getitem__, found)
        return own, list(accumulate(each))

    def ends(self, text: str) -> np.ndarray:
        """Bytes up to the end of each token of the whole text: where the table's count goes up."""
        out, at = [], 0
        for special, part in self.split(text):
            for p in [part] if special else self.pieces(part):
                for t in [p.encode()] if special else self.tokens(p.encode()):
                    at += len(t)
                    out.append(at)
        return np.array(out, np.int64)

    def _tail(self, tail: str) -> list[int]:
        """Tokens of tail[:i] for i from 1, for the end of a text cut inside one piece, as its prefix would be split."""
        if tail in self.special:  # a broken mark is ordinary text
            return [*(sum(map(self.counts.__getitem__, self.pieces(tail[:i]))) for i in range(1, len(tail))), 1]
        if tail[0] == "'" and len(tail) <= 3:
            return [sum(map(self.counts.__getitem__, self.pieces(tail[:i]))) for i in range(1, len(tail) + 1)]
        row, at, out = self.row(tail.encode())[0], 0, []
        for c in tail:
            at += len(c.encode())
            out.append(row[at])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:i] for i from 0 to len(text), exactly as encoding each prefix would count them."""
        out, before, held, special = [0], 0, "", set(self.special)
        own, sums = self.cells(text)
        for k, p in enumerate(own):
            if p in special:
                base = sums[k - 1] if k else 0
                # What stands before may run on into the broken mark.
                j = k
                while j and own[j - 1] not in special and j > k - 2:
                    j -= 1
                rest, low = "".join(own[j:k]), sums[j - 1] if j else 0
                out += [low + sum(map(self.counts.__getitem__, self.pieces(rest + p[:i]))) for i in range(1, len(p))]
                out.append(base + 1)
                held = ""
                continue
            # Blanks at the end of a prefix are one piece with those of the piece before, whatever follows.
            after = sums[k - 1] if k else 0
            blanks = len(p) - len(p.lstrip()) if held else 0
            row = self.row((held + p[:blanks]).encode())[0] if blanks else []
            size = len(held.encode())
            for c in p[:blanks]:
                size += len(c.encode())
                out.append(before + row[size])
            if blanks < len(p):
                out += [after + n for n in self._tail(p)[blanks:]]
            held, before = (held + p, before if held else after) if p.isspace() else ("", 0)
        return out

    def longest_prefix(self, text: str, own: list[str], sums: list[int], budget: int) -> int:
        """The most bytes a prefix of whole code points with at most `budget` tokens can have, from the rows alone.

        own, sums: cells(text). The sums give the piece in which the budget runs out; the rows of the pieces around it the rest.
        """
        if not own or sums[-1] <= budget:
            return len(text.encode())
        k = bisect_right(sums, budget)
        first = max(0, k - 3)
        base = sums[first - 1] if first else 0
        near = "".join(own[first : k + 2])
        fits = [i for i, n in enumerate(self.prefix_counts(near)) if base + n <= budget]
        return len("".join(own[:first]).encode()) + len(near[: fits[-1]].encode())


_HELD: dict[str, PrefixBPE] = {}


def held(path: str) -> PrefixBPE:
    """One table a worker process."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = PrefixBPE(path)
    return _HELD[path]
