"""Spelling variants: words that differ by one code point, searched in a frequency-vector trie.

1. Words and their counts are gathered inside the tasks and summed by word.
2. A word's vector holds how often each of GROUPS letter groups occurs in it.  The trie has one
   level for LEVEL_GROUPS successive groups; a node is a prefix of vectors, kept as a hash, and
   a table has the nodes of a level with their parents.
3. One inserted, deleted or replaced code point raises at most one count by one (the surplus) and
   lowers at most one by one (the deficit).  The search starts at the root with a budget of one
   each.  Going down it pairs every node with the nodes that the budget can reach: equal counts
   cost nothing, a higher or lower one what it spends.  Branches that do not exist end there.
   Every branch of the search is a row, so all of them go down together, level by level; words
   with equal prefixes share their branches.
4. At the leaves the words of a pair of vectors are verified by edit distance.  Of two words at
   distance one, the longer of length M, the first or the last M div 2 code points are equal, so
   leaf words only meet on such a half: a large leaf (anagrams) is not paired with itself as a
   whole.

A hash that two prefixes share brings more candidates, never fewer.  A word's form is its near
word of largest count, if that has at least ``RATIO`` times its own; forms are followed to the
last by pointer jumping (counts grow by RATIO each step, so chains are short).

Defined results: null and empty texts have no words; repeated rows count each; a null doc_id is
the empty string where doc_ids are hashed; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick, prepare, table
from .merkle import sql_crc32

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Every so many distinct (document, word) pairs, by crc32, one loses a code point.
SLIP = 199
GROUPS, LEVEL_GROUPS = 16, 4
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 200_000


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()


def slip(doc_id, word: str) -> str:
    """The word, in one of SLIP cases without one of its code points."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % SLIP:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", change=slip,
                min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, ``change`` applied to each (doc_id, lower-cased run)."""
    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                for w, n in Counter(RUN.findall(lower(t.as_py()))).items():
                    if len(w) >= min_chars:
                        w = change(doc, w)
                        if len(w) >= min_chars:
                            held[w] += n
                if len(held) > HELD_WORDS:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          ["word", "n"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    return (rows.mapInArrow(run, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def with_vectors(words: DataFrame) -> DataFrame:
    """Words with their length and their vector ``v``: how many of the code points fall into each
    group (code point modulo GROUPS)."""
    codes = F.transform(F.split("word", ""), lambda c: F.ascii(c) % GROUPS)
    counts = F.array(*[F.size("codes") - F.size(F.array_remove("codes", g)) for g in range(GROUPS)])
    return words.withColumn("codes", codes).select("word", "n", F.size("codes").alias("len"), counts.alias("v"))


def trie(vectors: DataFrame) -> list[DataFrame]:
    """Nodes (parent, id, counts) of every level of the trie over distinct ``v`` arrays; the
    root's id is 0, and a leaf's the id of its vector."""
    now = vectors.select("v", F.lit(0).cast("long").alias("parent"))
    out = []
    for level in range(GROUPS // LEVEL_GROUPS):
        part = F.slice("v", 1 + level * LEVEL_GROUPS, LEVEL_GROUPS)
        now = now.select("v", "parent", F.xxhash64("parent", part).alias("id"), part.alias("counts"))
        out.append(now.select("parent", "id", "counts").distinct())
        now = now.select("v", F.col("id").alias("parent"))
    return out


def leaf_id(v: Column) -> Column:
    out = F.lit(0).cast("long")
    for level in range(GROUPS // LEVEL_GROUPS):
        out = F.xxhash64(out, F.slice(v, 1 + level * LEVEL_GROUPS, LEVEL_GROUPS))
    return out


def search(levels: list[DataFrame]) -> DataFrame:
    """(a, b, more, less): pairs of leaves that a surplus and a deficit of one can bridge, both
    ways round; ``more`` and ``less`` say what of the two was spent from a to b."""
    pairs = None
    for i, nodes in enumerate(levels):
        nodes = materialise(nodes, f"spelling-trie-{i}")
        if pairs is None:  # the root with itself
            below = nodes.select("id", F.col("parent").alias("b"), "counts", F.lit(0).alias("more"), F.lit(0).alias("less"))
        else:
            below = pairs.join(nodes.withColumnRenamed("parent", "a"), "a")
        moves = F.expr(f"""filter(flatten(transform(sequence(0, {LEVEL_GROUPS}), u ->
            transform(sequence(0, {LEVEL_GROUPS}), d -> struct(u AS up, d AS down)))),
            x -> (x.up = 0 OR more = 0) AND (x.down = 0 OR less = 0) AND (x.up = 0 OR x.up <> x.down)
                 AND (x.down = 0 OR try_element_at(counts, x.down) > 0))""")
        reached = F.expr("transform(counts, (c, k) -> c + IF(k + 1 = m.up, 1, 0) - IF(k + 1 = m.down, 1, 0))")
        down = (below
                .select("id", "b", "counts", "more", "less", F.explode(moves).alias("m"))
                .select(F.col("id").alias("a"), F.xxhash64("b", reached).alias("b"),
                        (F.col("more") + (F.col("m.up") > 0).cast("int")).alias("more"),
                        (F.col("less") + (F.col("m.down") > 0).cast("int")).alias("less")))
        pairs = materialise(down.join(nodes.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
                            .select("a", "b", "more", "less"), f"spelling-pairs-{i}")
    return pairs


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words at edit distance one, both ways."""
    v = materialise(with_vectors(words).withColumn("leaf", leaf_id(F.col("v"))), "spelling-words")
    pairs = search(trie(v.select("v").distinct()))

    def key(leaf: str, side: int, size: str, word: str) -> str:
        piece = f"left({word}, {size})" if side == 0 else f"right({word}, {size})"
        return f"xxhash64({leaf}, {side}, {piece})"

    sides = v.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.array_distinct(F.expr(
        "array(" + ", ".join(key("leaf", s, t, "word") for s in (0, 1) for t in ("len DIV 2", "(len + 1) DIV 2")) + ")"))).alias("half"))
    longer = "(len + greatest(0, more - less)) DIV 2"
    asked = (v.join(pairs.withColumnRenamed("a", "leaf"), "leaf")
             .select("word", "n", F.explode(F.array_distinct(F.expr(
                 "array(" + ", ".join(key("b", s, longer, "word") for s in (0, 1)) + ")"))).alias("half")))
    met = asked.join(sides, "half").where("word <> near AND levenshtein(word, near, 1) = 1")
    return met.select("word", "n", "near", "near_n").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last, by doubling jumps."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = materialise(now, "spelling-roots")
        up = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        moved = now.join(up, F.col("root") == F.col("w"), "left").select("word", "root", "further")
        if moved.where("further IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per (word, n): word, n, n_near, form, form_n, root."""
    words = materialise(words.select("word", "n"), "spelling-counts")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best",
        (-F.col("best.m") >= ratio * F.col("n")).alias("has"))
    found = materialise(found.select("word", "n", "n_near", F.when(F.col("has"), F.col("best.form")).alias("form"),
                                     F.when(F.col("has"), -F.col("best.m")).alias("form_n")), "spelling-forms")
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n",
                                                    F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir):
    words = word_counts(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


_POINTS = """flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"""

ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= {MIN_CHARS} GROUP BY doc_id, run),
h AS (SELECT run, n, {sql_crc32(_POINTS)} AS h FROM c),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
      WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
      UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
b AS (SELECT word, count(*) AS n_near, min(row(-n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {RATIO} * w.n THEN best[2] END AS form,
        CASE WHEN -best[1] >= {RATIO} * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS last, 0 AS k FROM f
      UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON g.last = f.word WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(last, k) AS root FROM g GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": ORACLE}
