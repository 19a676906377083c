"""Line dedup, spelling variants and the Merkle manifest against plain Python versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cellwright.llm import linededup, merkle, spelling

EXTRA = ", key string, n_lines struct<a: string>, word string, digest string, rank string, pos string"
CLASH = ("x", ("y",), "z", "w", "v", "u")


def frame(spark, rows, schema, extra=False):
    return spark.createDataFrame([r + CLASH * extra for r in rows], schema + EXTRA * extra)


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# -- line dedup ------------------------------------------------------------------------------

def plain_lines(rows):
    order = lambda d: (d is None, d or 0)
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\f\r"))
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min([owner.get(key(line), d), d], key=order)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and owner[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = [(3, "Shared line of some length\nown line number three\n"), (1, "  shared LINE of some length\t\nshort\nshort"),
         (2, None), (4, ""), (5, "\n\n"), (6, "shared line of some length"), (6, "shared line of some length"),
         (None, "shared line of some length\nonly in the null document"), (None, "only in the null document"),
         (7, "ÄÖÜ äöü ß lange Zeile\nÄöü äöü ß lange Zeile"), (8, "äöü äöü ß lange zeile\nÄÖÜ äÖü ß lange Zeile"),
         (9, "ten chars!\nnine char\nten chars!"), (10, "ten chars!\nnine char\r\n\x0bTEN CHARS!\x0c\nlast"),
         (11, " ten chars!"), (12, "\U0001F600" * 10), (13, "\U0001F600" * 10 + "\nx"), (14, "\U0001F600" * 9), (15, "\U0001F600" * 9)]


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_lines_match_plain_python(spark, slices):
    rnd = random.Random(slices)
    pool = [f"line {i} of the pool" for i in range(30)]
    rows = LINES + [(100 + i, "\n".join(rnd.choice(["A very common line here", *pool, f"line of document {i} alone", "", "x"])
                                        for _ in range(rnd.randint(1, 40)))) for i in range(80)]
    rows.append((99, "\n".join(f"Line {i % 37} of the pool" for i in range(5000))))  # a very long text
    out = linededup.dedup_lines(frame(spark, rows, "doc_id long, text string", extra=True))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=str)
    assert got == plain_lines(rows)


def test_line_bitmaps_are_runs(spark):
    rows = [(1, "aaaaaaaaaa\nbbbbbbbbbb"), (2, "aaaaaaaaaa\nown line 1\nx\nbbbbbbbbbb\nbbbbbbbbbb"), (3, "y\naaaaaaaaaa\nz")]
    got = {r.doc_id: (r.n_dropped, r.runs) for r in linededup.line_bitmaps(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {2: (3, [0, 1, 2, 2, 0]), 3: (1, [1, 1, 1])}


def test_lines_stay_in_the_engine_and_empty_table(spark):
    docs = frame(spark, [], "doc_id long, text string")
    out = linededup.dedup_lines(docs)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- spelling variants -----------------------------------------------------------------------

def near_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_spelling(rows):
    n = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = ascii_lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    form, out = {}, {}
    for w in n:
        near = sorted((x for x in n if near_by_hand(w, x)), key=lambda x: (-n[x], x))
        form[w] = near[0] if near and n[near[0]] >= 5 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], out[w], n.get(form[w])) for w in n}


def test_spelling_matches_plain_python(spark):
    rnd = random.Random(3)
    base = ["garden", "wärmer", "stones", "listen", "silent", "enlist", "straße", "ÀÉÎÕÜÿ", "aaaaaa", "abcabcabc", "x" * 300]
    pool = []
    for i, w in enumerate(base):
        w = ascii_lower(w)
        pool += [w] * 400
        for _ in range(25):
            p = rnd.randrange(len(w))
            c = rnd.choice("abcdefghijklmnopqrstuvwxyzäéÿ÷×")
            v = rnd.choice([w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:]])
            pool += [v] * rnd.choice([3, 5, 8, 30, 80])
            p = rnd.randrange(len(v))
            pool += [v[:p] + c + v[p:]] * rnd.choice([5, 6])
    rnd.shuffle(pool)
    rows = [(i, " ".join(pool[a:a + 37]).title() if i % 3 else "-".join(pool[a:a + 37]))
            for i, a in enumerate(range(0, len(pool), 37))]
    rows += [(None, "garden Garden GARDEN gardens"), (5000, None), (5001, ""), (5002, "Āgarden¿stones1stones")] + rows[:2]
    words = spelling.word_counts(frame(spark, rows, "doc_id long, text string", extra=True))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(words).collect()}
    assert got == plain_spelling(rows)
    assert sum(v[0] is not None for v in got.values()) > 50


def test_spelling_pairs_within_anagrams(spark):
    """All words share one vector; pairs must still be those at distance one alone."""
    import itertools
    words = ["".join(p) for p in itertools.permutations("abcabc")][:400] + ["abcabd", "bcabca"]
    words = sorted(set(words))
    df = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_words(df).select("word", "near").collect()}
    assert got == {(a, b) for a in words for b in words if near_by_hand(a, b)}


def test_spelling_empty_table(spark):
    out = spelling.spelling_groups(spelling.word_counts(frame(spark, [(1, None)], "doc_id long, text string")))
    assert out.collect() == []


# -- Merkle manifest -------------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def tree(level):
    out = [level]
    while len(level) > 1:
        level = [H(*level[i:i + 16]) for i in range(0, len(level), 16)]
        out.append(level)
    return out


def siblings(levels, i):
    for level in levels[:-1]:
        a = i // 16 * 16
        yield "".join(level[a:i]), "".join(level[i + 1:a + 16])
        i //= 16


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {s: tree([plain_leaf(r) for r in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            t = r[4]
            if r[0] is not None and t is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                t = ascii_lower(t)
            x = plain_leaf((*r[:4], t))
            for a, b in path:
                x = H(a, x, b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], H(*[a + b for a, b in path]), x, x == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_matches_plain_python(spark):
    rnd = random.Random(11)
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", rnd.choice(["en", "de", None]), rnd.choice([i, None]), f"Text NUMBER {i} é\n")
            for i in range(700)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (9000, None, "en", 0, "ABC"), (9001, "", "", 0, ""),
             (9002, "\U0001F600", "en", 1, "Long " * 20_000), (9003, "￮", "en", 1, "One"), (3, "hot", "en", 1, "tie"), (3, "hot", "en", 1, "Tie")]
    rows += [rows[0], rows[0]]  # repeated rows
    docs = frame(spark, rows, SCHEMA, extra=True)
    got = sorted([tuple(r) for r in merkle.verify_rows(docs.select(*merkle.FIELDS)).collect()], key=str)
    assert got == plain_manifest(rows)
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    got = sorted([tuple(r) for r in merkle.verify_rows(frame(spark, rows, SCHEMA)).collect()], key=str)
    assert got == (plain_manifest(rows) if n else [])


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"T{i}") for i in range(300)]
    docs = frame(spark, rows, SCHEMA).select("doc_id", "source", merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    m = merkle.manifest(docs, "source", "doc_id", "leaf")
    some = merkle.proofs(m, m["leaves"].where("doc_id IN (5, 6, 299)"), "source", keep=("doc_id",))
    got = {r.doc_id: (r.proof, r.root) for r in some.select("doc_id", merkle.proof_digest(F.col("path")).alias("proof"), "root").collect()}
    assert got == {r[0]: (r[4], r[3]) for r in plain_manifest(rows) if r[0] in (5, 6, 299)}
