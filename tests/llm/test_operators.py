"""Each operator on a table of edge cases: nulls, empty and long texts, ties, repeated rows, extra columns; and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm.queries")
from quillspark.llm import components, edits, jaccard, lines, mixing, packing, pii, prefix_bpe, quality, sharding, tokens, topk, urls  # noqa: E402
from quillspark.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls int, size int, key string, bits string, shard int, target int"


def vocabulary(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def passage(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng, words = random.Random(3), vocabulary(900)
    out = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one", "en", "b"), (None, "null id here", None, "b"), (5, "word " * 60, "en", "b"), (6, passage(rng, words, 20000), "en", "a")]
    for i in range(10, 60):
        out.append((i, ".\n".join(passage(rng, words, 20) for _ in range(6)), "en", rng.choice(["a", "b", None])))
    base = passage(rng, words, 150)
    out += [(i, base, "en", "a") for i in range(100, 110)] + [(100, base, "en", "a")] * 2
    for i in range(110, 140):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        out.append((i, " ".join(w), "de", "c"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "b", 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, n, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("n, num, den, hot", [(3, 90, 100, jaccard.HOT), (5, 8, 10, jaccard.HOT), (3, 90, 100, 1), (2, 1, 3, 2)])
def test_jaccard(docs, rows, n, num, den, hot):
    got = jaccard.ngram_jaccard(docs, n, num, den, hot=hot).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, num, den)


def test_empty_tables(spark, empty):
    assert jaccard.ngram_jaccard(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert lines.dedupe_lines(empty).count() == 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    assert pii.find_personal_data(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert tokens.token_counts(empty, tokenizer_path()).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {r.source: r.target for r in got}
    assert sum(by.values()) == pytest.approx(total)
    size = {s: sum(r.size for r in got if r.source == s) for s in by}
    assert all(t <= 3 * size[s] + 1e-6 for s, t in by.items())
    for s, t in by.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 16 * (2 + len(got) ** 0.5)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, got))


def test_quality_statistics(docs, rows):
    def brute(t):
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        filled = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(filled) - len(set(filled)), len(covered)

    got = quality.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute(t)) for i, t, *_ in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert next(r for r in got if r.doc_id == 5).base_failed


def test_quality_outliers(spark):
    rng, words = random.Random(8), vocabulary(300)
    rows = [(i, "\n".join(passage(rng, words, 12) for _ in range(8)), "en", "s") for i in range(120)]
    rows += [(1000 + i, " ".join(w + "$$$%%%" for w in passage(rng, words, 90).split()), "en", "s") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, k in got.items() if not k} == set(range(1000, 1005))


def test_lines(spark):
    a, b = "the quick brown fox jumps over it all", "A Line that says something of its own 17!"
    rows = [(1, f"{a}\nshort\n{b}", 0), (2, f"{a.upper()}\nshort\nnew words stand in this line now", 0), (3, b.replace("17", "23"), 0), (None, a, 0), (4, None, 0), (5, "", 0)]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in lines.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string, line int")).collect()}
    assert got == {1: (f"{a}\nshort\n{b}", 0), 2: ("new words stand in this line now", 2), 3: ("", 1), None: ("", 1), 4: (None, 0), 5: ("", 0)}


def test_lines_of(rows):
    texts = [lines.normalised((t or "").encode()) for _, t, *_ in rows] + [b"a\n\nb c\n", b"", b"\n\n x"]
    x = lines.lines_of(texts)
    want = [(i, p, len(b" ".join(line.split()).decode())) for i, t in enumerate(texts) for p, line in enumerate(t.split(b"\n")) if line.split()]
    assert list(zip(x.text.tolist(), x.place.tolist(), x.size.tolist())) == want
    shown = [b" ".join(texts[i].split(b"\n")[p].split()) for i, p, _ in want]
    assert len(set(shown)) == len(set(x.name.tolist())) == len(set(zip(shown, x.name.tolist())))


def test_simhashes():
    rng, words = random.Random(4), vocabulary(2000)
    base = passage(rng, words, 900).split()
    near = [*base[:450], "changed", *base[451:]]
    far = passage(rng, words, 900).split()
    x = lines.lines_of([" ".join(w).encode() for w in (base, near, far)])
    sims = lines.simhashes(x.words, x.ends)
    plain = []
    for w in np.split(x.words, x.ends[:-1]):
        bits = [np.unpackbits(lines.mix(w + np.uint64(half + 1)).view(np.uint8)).reshape(len(w), 64).sum(0) for half in (0, 1)]
        plain.append([int(np.packbits(2 * b.astype(int) > len(w)).view(np.uint64)[0]) for b in bits])
    assert sims.tolist() == plain
    apart = lambda i, j: sum(int(a ^ b).bit_count() for a, b in zip(plain[i], plain[j], strict=True))
    assert apart(0, 1) <= 8 < apart(0, 2)


@pytest.fixture(scope="module")
def crowded():
    """Lines that crowd a few buckets, and for each that is not the first of its group the first, by all pairs of all buckets."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(400)]
    texts = []
    for size in (12, 24, 40):
        base = rng.choices(vocabulary, k=size)
        for _ in range(80):
            w = list(base)
            for k in rng.sample(range(size), rng.randint(size // 10, size // 3)):
                w[k] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts = sorted(set(texts))
    x = lines.lines_of([t.encode() for t in texts])
    sims, met = lines.simhashes(x.words, x.ends), {}
    for k, names in enumerate(lines.buckets(x.words, x.ends)):
        for name in names.tolist():
            met.setdefault(name, []).append(k)
    up = list(range(len(texts)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in sorted({p for members in met.values() for p in combinations(sorted(set(members)), 2)}):
        if int(np.bitwise_count(sims[i] ^ sims[j]).sum()) <= 32 and find(i) != find(j) and lines.edit_distance(texts[i], texts[j]) <= lines.allowance(len(texts[i]), len(texts[j]), 0.8):
            up[max(find(i), find(j))] = min(find(i), find(j))
    return texts, {k: find(k) for k in range(len(texts)) if find(k) != k}


def test_crowded_buckets_lose_no_link(spark, crowded):
    """Chains along a bucket miss some links."""
    texts, wanted = crowded
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for more in ({}, {"side": 16}):
        table, repeated = lines.line_groups(docs, **more)
        rows = table.selectExpr("id", "explode(lines) line").join(repeated, "line").selectExpr("id", "first.id kept").collect()
        assert {r.id: r.kept for r in rows if r.id != r.kept} == wanted


def test_pipeline_lines_of_crowded_buckets(spark, crowded):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts, gone = crowded
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.line_stage(spark, docs, "").collect()) == [k for k in range(len(texts)) if k not in gone]


def test_distances_taken_at_once():
    rng, xs, ys = random.Random(21), [], []
    for _ in range(400):
        letters = rng.choice(["ab", "abcdefgh ", "abcé漢字 "])
        x = "".join(rng.choices(letters, k=rng.choice([1, 5, 63, 64, 65, 128, 129, 300])))
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 2))):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 1))
        xs.append(x)
        ys.append("".join(y))
    exact = [lines.edit_distance(x, y) for x, y in zip(xs, ys, strict=True)]
    assert (edits.letters_apart(xs, ys) <= exact).all() and edits.letters_apart(["aab"], ["bcc"]).tolist() == [2]
    for by in (0, 1):
        most = [max(d - by, 0) for d in exact]
        got = edits.within(xs, ys, most, lambda x, y, top: lines.edit_distance(x, y) <= top)
        assert got.tolist() == [d <= top for d, top in zip(exact, most, strict=True)]


def test_few_distances_are_left_to_the_single_one():
    """Pairs left over by a group, here those that are similar, go on together."""
    rng, xs, ys = random.Random(22), [], []
    for k in range(200):
        x = "".join(rng.choices("abcdefgh ", k=300))
        y = list(x) if k < 40 else rng.choices("abcdefgh ", k=300)
        for at in range(0, 300, 9):
            y[at] = "x"
        xs.append(x)
        ys.append("".join(y))
    asked = []
    got = edits.within(xs, ys, [60] * 200, lambda x, y, top: asked.append(x) or lines.edit_distance(x, y, top) <= top)
    assert got.tolist() == [lines.edit_distance(x, y) <= 60 for x, y in zip(xs, ys, strict=True)] and sum(got) == 40
    assert len(asked) < edits.PAYS


def test_a_step_takes_all_words_of_the_band(monkeypatch):
    """Long pairs take about a step a letter, however many words of rows their band holds."""
    rng, xs, ys = random.Random(24), [], []
    for _ in range(64):
        x = rng.choices("abcdefgh ", k=2000)
        y = list(x)
        for at in range(0, 2000, 8):
            y[at] = "x"
        xs.append("".join(x))
        ys.append("".join(y))

    class Counted:
        steps = 0

        def __getattr__(self, name):
            self.steps += name == "bitwise_or"
            return getattr(np, name)

    monkeypatch.setattr(edits, "np", counted := Counted())
    assert edits.within(xs, ys, [400] * 64, None).all()
    assert 1900 < counted.steps < 2200


def test_distances_in_a_band():
    """With a limit only the rows near the diagonals are looked at: strings that are shifted, cut, and long beside the limit."""
    rng, xs, ys, exact = random.Random(25), [], [], []
    for k in range(120):
        letters = rng.choice(["ab", "abcdefgh "])
        x = rng.choices(letters, k=rng.choice([60, 200, 330]))
        cut, grown = rng.randrange(len(x) // 2), rng.randrange(40)
        y = x[cut:] + rng.choices(letters, k=grown) if k % 3 else x[:30] + rng.choices(letters, k=grown) + x[30 : len(x) - cut]
        xs.append("".join(x))
        ys.append("".join(y))
        exact.append(lines.edit_distance(xs[-1], ys[-1]))
    for by in (-20, -1, 0, 1, 15, 60):
        most = [max(d + by, 0) for d in exact]
        found = [lines.edit_distance(x, y, top) for x, y, top in zip(xs, ys, most, strict=True)]
        assert all(d == want if want <= top else d > top for d, want, top in zip(found, exact, most, strict=True))
        got = edits.within(xs, ys, most, lambda x, y, top: lines.edit_distance(x, y) <= top)
        assert got.tolist() == [d <= top for d, top in zip(exact, most, strict=True)]


def test_components(spark, monkeypatch):
    """In rounds, in one task, and rounds first; few links take few jobs, as the driver keeps account of each."""
    rng = random.Random(23)
    name = rng.sample(range(-(1 << 40), 1 << 40), 150)  # digests, as the rounds ask for
    links = [(name[k], name[k + 1]) for k in range(24)] + [(name[rng.randrange(40, 150)], name[rng.randrange(40, 150)]) for _ in range(80)] + [(name[30], name[30]), (None, name[31]), (name[32], None)]
    up = {k: k for k in name}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        if a is not None and b is not None:
            up[max(find(a), find(b))] = min(find(a), find(b))
    nodes = {k for a, b in links if a is not None and b is not None and a != b for k in (a, b)}
    table = spark.createDataFrame(links, "a long, b long")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    for few in (0, 20, 1 << 20):
        monkeypatch.setattr(components, "FEW", few)
        before = jobs()
        got = components.connected_components(table)
        taken = jobs() - before
        got = {r.node: r.comp for r in got.collect()}
        assert set(got) == nodes and all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes)
        assert got.keys() >= set(got.values())
    assert taken <= 8
    assert components.connected_components(table.limit(0)).collect() == []


def test_near_lines_at_defaults(spark):
    """Groups by brute force, of lines of usual lengths with replaced words."""
    rng, words = random.Random(6), vocabulary(1500)
    kept = []
    for n in [8, 12, 20, 40, 80] * 8:
        x = passage(rng, words, n).split()
        kept.append(" ".join(x))
        for _ in range(2):
            y = list(x)
            for _ in range(rng.randint(1, max(1, n // 8))):
                y[rng.randrange(n)] = rng.choice(words)
            kept.append(" ".join(y))
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kept):
        for j in range(i):
            most = max(len(a), len(kept[j]))
            if abs(len(a) - len(kept[j])) <= 0.2 * most and lines.edit_distance(a, kept[j]) <= (1 - 0.8) * most:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = lines.dedupe_lines(spark.createDataFrame(list(enumerate(kept)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_lines_removed} == {i for i in range(len(kept)) if find(i) != i}


def test_similar_is_the_edit_similarity():
    rng, words = random.Random(12), vocabulary(60)
    for _ in range(400):
        x = passage(rng, words, rng.randint(1, 25)).split()
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        a, b = " ".join(x), " ".join(y)
        assert lines.similar(a, b, 0.8) == (lines.edit_distance(a, b) <= lines.allowance(len(a), len(b), 0.8))


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)]
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "phone" and 9 <= len(d) <= 15)


def test_personal_data(spark):
    texts = ["", None, "a@b.c_d@e.f x..y@z.co.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "+1 (234) 567-8901. +12 3", "4111 1111 1111 1111 4111-1111-1111-1111-2", "é🙂 q@w.é r@t.yu 1-2345678901234567", "a" * 3000 + " " + "1" * 3000, "x@y-z.-a@b.c", "+49 30 1234567 10.0.0.1 10.0.0.1"]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t or "") if valid(kind, m[0]))
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert (got[i].base_sha256, got[i].spans) == (hashlib.sha256(shown.encode()).hexdigest(), shown)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"é{i}@mail.example.com or a{i}@b.co" for i in range(10000))
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(PLAIN["email"], text))
    assert row.n_email == 20000 and row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_disclosing_terms_of_a_class(spark):
    """Each mail stands once; the term goes with their domain."""
    rows = [(i, f"note {i} of Quibblestone u{i}@mail.example.com on day{i}") for i in range(4)] + [(100 + i, f"text {i} of someone u{i}@host{i}.example.org") for i in range(40)]
    got = {r.doc_id: r.n_term for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] >= 1 for i in range(4)) and all(got[100 + i] == 0 for i in range(40))


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} by Zebulonia zz@mail.example.com sent on day{i}") for i in range(8)] + [(100 + i, f"other text number {i} sent by someone") for i in range(60)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_term >= 1 and f"term:{rows[0][1].index('Zebulonia')}:{rows[0][1].index('Zebulonia') + 9}" in got[0].spans
    assert all(got[100 + i].n_term == 0 for i in range(60))
    shown = pii.find_personal_data(spark.createDataFrame(rows[:8] + rows[8:], "doc_id long, text string"), with_text=True).where("doc_id = 0").first().text
    assert "Zebulonia" not in shown and "<email>" in shown


def test_prefix_table():
    table = prefix_bpe.held(tokenizer_path())
    rng, parts = random.Random(2), [*" \n'.,1aZéß日\tdsrelv ", "the", " and", "<|endoftext|>", "  "]
    for _ in range(400):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        want = [len(table.library.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        own, sums = table.cells(x)
        assert table.ids_of(x).tolist() == table.library.encode(x, add_special_tokens=False).ids
        assert "".join(own) == x and (sums[-1] if sums else 0) == want[-1] and table.prefix_counts(x) == want
        assert table.ends(x).tolist()[-1:] == ([len(x.encode())] if x else []) and len(table.ends(x)) == want[-1]
        for budget in (0, 1, 3, 6):
            assert table.longest_prefix(x, own, sums, budget) == len(x[: max(i for i, n in enumerate(want) if n <= budget)].encode())


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, "x" * 100_000 + " " + "é" * 50_000])
def test_long_runs(text):
    table = prefix_bpe.held(tokenizer_path())
    n = len(table.library.encode(text, add_special_tokens=False).ids)
    own, sums = table.cells(text)
    assert sums[-1] == n == len(table.ids_of(text)) and 0 < table.longest_prefix(text, own, sums, 512) < len(text.encode())


def test_token_counts(docs, rows):
    library = prefix_bpe.held(tokenizer_path()).library
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, tokenizer_path()).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows]
    assert got == Counter((i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(rows, n, strict=True))


def test_packing(docs, rows):
    library = prefix_bpe.held(tokenizer_path()).library
    got = packing.pack(packing.token_pieces(docs, tokenizer_path(), 2, 1024), 1024, per_part=16, merge=2, rounds=3).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[a : a + 1024] if k else ids[:first]
            want[(i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    bound = packing.lower_bound(np.array([r.length for r in got]), 1024)
    assert bound <= len(bins) <= bound + 3


def test_lower_bound():
    assert packing.lower_bound(np.array([600, 600, 600]), 1024) == 3
    assert packing.lower_bound(np.array([342] * 6), 1024) == 3
    assert packing.lower_bound(np.array([512] * 4), 1024) == 2
    assert packing.lower_bound(np.array([], np.int64), 1024) == 0


def test_sharding(docs, rows):
    got = sharding.shard(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    groups = Counter()
    for _, t, *_ in rows:
        groups["f" * 32 if t is None else hashlib.md5(t.encode()).hexdigest()] += len((t or "").encode()) + 16
    assert max(sizes.values()) == sharding.least_capacity([groups[k] for k in sorted(groups)], 7)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({(r.text_crc32, r.size, r.shard) for r in got}) == len({(r.text_crc32, r.size) for r in got})


def test_even_cuts():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.randint(1, rng.choice([3, 40])) for _ in range(rng.randint(1, 30))]
        shards = rng.randint(1, 8)
        ends = np.cumsum(sizes).tolist()
        least = sharding.least_capacity(sizes, shards)
        cuts = sharding.even_cuts(ends, least, shards)
        found = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert len(cuts) == shards and cuts[-1] == len(sizes) and sum(found) == sum(sizes) and max(found) == least
    assert [len(x) for x in np.split(np.arange(400), sharding.even_cuts(list(range(1, 401)), sharding.least_capacity([1] * 400, 40), 40)[:-1])] == [10] * 40


def test_urls(spark):
    seen = ["http://a.com/x", "http://com/", "http://a.com", "http://www.example.com/en/1", "http://b.example.com/en/1", "http://B.Example.COM/en/1?q", "https://x.net/es/", "https://x.net/fr", "https://notnet/fr/1", "no url", None, "https://spam-farm.example.org/q", "://h.net/fr/a#b"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(list(enumerate(seen)), "page_id long, url string")).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1][2] == "com/" and got[2] == ("a.com", "", None, "allow")
    assert got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block") and got[5] == ("b.example.com", "/en/1", "example.com/en/", "block")
    assert got[6][2:] == ("net/es/", "block") and got[7][2] is None and got[8][2] is None
    assert got[9] == ("", "", None, "allow") == got[10] and got[11][2:] == (None, "block") and got[12] == ("h.net", "/fr/a", "net/fr/", "block")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (300, 8)).round(1)
    x[50:90] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20, pivots=4, per_block=64).collect()))
    v = np.floor(64 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 300, 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_large_values(spark):
    x = [[2e7 + i, -1e7 + 3 * i] for i in range(40)] + [[1e30, 1.0]]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), k=3, per_queries=1).orderBy("query_id", "rank").collect()]
    v = [[int(64 * c) for c in r] for r in x[:40]]
    want = []
    for q in (0, 20):
        s = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in range(40) if i != q))[:3]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert got == want


def test_pipeline_stages(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = docs.select(*corpus_pipeline.COLUMNS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, "").write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert at.columns == list(corpus_pipeline.COLUMNS)
    assert at.count() > 0 and at.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
