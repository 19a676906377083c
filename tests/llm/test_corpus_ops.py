"""Jaccard join, substring dedup, decontamination and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellwright.llm import common, decontam, graph, jaccard, shingles, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, key string")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(rnd, n, vocabulary=400):
    return [f"w{rnd.randint(0, vocabulary)}" for _ in range(n)]


def edited(rnd, w, n):
    w = list(w)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10 ** 6)}"
    return w


# -- shingles --------------------------------------------------------------------------------

def test_shingle_sets_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(0)
    texts = ["", " ", "A b\tC", "one", "é ü\x0bñ"] + [" ".join(prose(rnd, rnd.randint(1, 60), 20)) for _ in range(80)] + ["x" * 5000]
    array = pa.array(texts)
    whole = dict(shingles.shingle_sets(array, 3))
    assert [len(whole[i]) for i in range(len(texts))] == [len(shingle_set(t, 3)) for t in texts]
    for sliced in (array.slice(7, 20), array.cast(pa.large_string())):
        base = 7 if len(sliced) == 20 else 0
        for i, s in shingles.shingle_sets(sliced, 3):
            assert (s == whole[i + base]).all()
    for t, s in zip(texts, whole.values()):
        assert (next(shingles.shingle_sets(pa.array([t]), 3))[1] == s).all()
    seen = {}
    for t in texts:  # equal words, equal hashes; other words, others
        h, _ = shingles.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        for w, x in zip(words(t), h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rnd = random.Random(6)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("s000", f"s{i:03d}") for i in range(1, 80)]
    other = [(f"r{rnd.randint(0, 60):03d}", f"r{rnd.randint(0, 60):03d}") for _ in range(40)]
    edges = chain + star + other + star[:5]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


# -- n-gram Jaccard --------------------------------------------------------------------------

def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        root = find(i)
        least[root] = min(least.get(root, d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(rnd):
    """Copies, chains of near copies, one large family, a shared passage, odd texts."""
    texts = [None, "", " \n", "one two", "One  TWO", "one", "a b c d", "a b c d e"]
    passage = prose(rnd, 40)
    for _ in range(25):
        texts.append(" ".join(prose(rnd, rnd.randint(20, 120)) + passage))
    w = prose(rnd, 150)
    for _ in range(12):  # a chain: each differs a little from the one before
        w = edited(rnd, w, 1)
        texts.append(" ".join(w))
    family = prose(rnd, 260)
    texts += [" ".join(edited(rnd, family, rnd.randint(0, 5))) for _ in range(60)]
    texts += [" ".join(passage)] * 5 + [" ".join(passage + ["x"])] * 3
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,percent,orders", [(4, 85, 3), (5, 80, 2), (1, 100, 1)])
def test_near_duplicates_match_brute_force(spark, k, percent, orders):
    texts = corpus(random.Random(k))
    ids = [7 * i for i in range(len(texts))]
    got = jaccard.near_duplicates(docs(spark, texts, ids).repartition(5), k, percent, orders=orders).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(zip(ids, texts)), k, percent)


def test_near_duplicates_pairs_of_a_large_family(spark, monkeypatch):
    """Copies of one text that are mostly too far apart to link: few of all pairs (11,175) are tried."""
    rnd = random.Random(11)
    base = prose(rnd, 160)
    texts = [" ".join(edited(rnd, base, rnd.randint(1, 6))) for _ in range(150)]
    tried, write = [], jaccard.materialise

    def counted(df, name):
        out = write(df, name)
        if name.endswith("pairs"):
            tried.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    ids = list(range(len(texts)))
    got = jaccard.near_duplicates(docs(spark, texts, ids), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(list(zip(ids, texts)), 4, 85)
    assert sum(tried) < 3000


def test_near_duplicates_odd_tables(spark):
    d = docs(spark, ["a b c d e"] * 3 + [None, None], ids=[3, 3, None, None, 1])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d, 4, 85).collect()),
                 key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None), (1, 0, 1)], key=str)
    assert jaccard.near_duplicates(d.limit(0), 4, 85).count() == 0


# -- substrings ------------------------------------------------------------------------------

def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        out.append((len(t), sum(mark), len(re.findall(b"\1+", mark)), bytes(c for c, m in zip(t, mark) if not m)))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    text = lambda n: " ".join(prose(rnd, n, 5000))
    base = [text(80) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, "ab" * 33, "é" * 90, base[0], base[0], base[0][:64], base[0][5:69], base[0][5:70]]
    for _ in range(40):  # pieces of any length around the limit, in any place and order
        parts = []
        for _ in range(rnd.randint(1, 4)):
            b = rnd.choice(base)
            at = rnd.randint(0, len(b) - 60)
            parts.append(b[at:at + rnd.choice([40, 63, 64, 65, 66, 90, 130, 200])])
            parts.append(text(rnd.randint(0, 6)))
        texts.append("".join(parts))
    out = substrings.remove_repeats(docs(spark, texts).repartition(4), length=64).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, 64)


def test_substring_dedup_in_segments_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 100)
    rnd = random.Random(3)
    long = " ".join(prose(rnd, 200, 5000))
    texts = [long, long[300:900], "z " + long[:200], long[100:163] + "!" + long[163:200]]
    got = []
    for b in pa.Table.from_pydict({"t": texts}).to_batches():
        for i, t in enumerate(b.column(0).to_pylist()):
            for g in substrings.segments(t, 64):
                at, s, e = g.anchors()
                assert (at >= s).all() and (at <= s + 47 + (e - s)).all() and s[0] == 0 and e[-1] == g.n - 1
                got.append((i, g.at))
    assert len(got) > 10
    monkeypatch.undo()
    d = docs(spark, [long, long, None], ids=[1, 1, None])
    rows = substrings.remove_repeats(d, length=64).collect()
    assert sorted((r.n_bytes, len(r.kept)) for r in rows) == [(0, 0), (len(long), 0), (len(long), 0)]
    assert substrings.remove_repeats(d.limit(0), length=64).count() == 0


# -- decontamination -------------------------------------------------------------------------

def brute_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest common run of unmarked words, again
    and again; returns how many words of b are covered."""
    least = min(least, len(b))
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
    while least:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        used_a[i:i + n], used_b[j:j + n] = [True] * n, [True] * n
        covered += n
    return covered


def test_tiles_cover_what_brute_force_covers():
    rnd = random.Random(12)
    for trial in range(150):
        vocabulary = rnd.choice([40, 200])
        item = prose(rnd, rnd.randint(1, 30), vocabulary)
        parts = [item[:len(item) // 2], prose(rnd, 4, vocabulary), item[len(item) // 2:]]
        rnd.shuffle(parts)
        doc = prose(rnd, 10, vocabulary) + sum(parts, []) + prose(rnd, 5, vocabulary)
        ids = {w: i for i, w in enumerate({*doc, *item})}
        code = lambda x: np.array([ids[w] for w in x], dtype=np.uint64)
        got, want = decontam.tile(code(doc), code(item), 5), brute_tiles(doc, item, 5)
        assert got == want, trial


def test_decontamination(spark):
    rnd = random.Random(2)
    item = prose(rnd, 40)
    other = prose(rnd, 12)
    fill = lambda n: " ".join(prose(rnd, n, 10 ** 6))
    reordered = " ".join([*item[25:], *prose(rnd, 5, 10 ** 6), *item[:25]])
    texts = ["", None, fill(300), f"{fill(100)} {' '.join(item).upper()} {fill(3000)}", reordered, f"{fill(9)} {' '.join(item[:31])}",
             f"{fill(9)} {' '.join(item[:33])}", " ".join(other), "tiny item here", "tiny here item", " ".join(item) + " " + " ".join(other)]
    items = spark.createDataFrame(
        [(1, " ".join(item)), (2, " ".join(other)), (3, "Tiny item"), (4, ""), (5, None), (1, " ".join(item))],
        "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    d = docs(spark, texts + texts[3:4], ids=[*range(len(texts)), 3])
    got = {r.doc_id: (r.item_ids, r.coverage) for r in decontam.contaminated_documents(d, items).collect()}
    assert got == {3: ([1], 1.0), 4: ([1], 1.0), 6: ([1], 0.825), 7: ([2], 1.0), 8: ([3], 1.0), 10: ([1, 2], 1.0)}
    assert decontam.contaminated_documents(d, items.limit(0)).count() == 0
    assert decontam.contaminated_documents(d.limit(0), items).count() == 0


# -- pipeline --------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(21)
    stop = "the of and to in a is that it was for on with as by".split()

    def clean(n):
        w = prose(rnd, n, 3000)
        w[::3] = [rnd.choice(stop) for _ in w[::3]]
        return w
    near = clean(200)
    bench = clean(30)
    texts = {0: clean(120), 1: near, 2: edited(rnd, near, 1), 3: near, 4: clean(50) + bench + clean(40),
             5: clean(60) + ["mail", "a.b@mail1.example.com", "now"] + clean(10), 6: ["word"] * 40, 7: ["too", "short"]}
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in texts.items()]
    rows += [rows[0], (8, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "ids", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.materialise(stage(spark, d, str(tmp_path)), name)
        seen[name] = sorted(r.doc_id for r in d.collect())
        if name != "byte_bpe":
            assert d.columns == list(corpus_pipeline.COLUMNS)
        if name == "pii":
            after = {r.doc_id: r.text for r in d.collect()}
    assert seen == {"quality": [0, 0, 1, 2, 3, 4, 5], "near_duplicates": [0, 1, 4, 5], "decontamination": [0, 1, 5],
                    "pii": [0, 1, 5], "byte_bpe": [0, 1, 5]}
    assert "a.b@mail1" not in after[5] and "@" in after[5] and after[0] == " ".join(texts[0])
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(last) == [0, 1, 5]
    for i, r in last.items():
        assert r.decoded_sha256 == hashlib.sha256(after[i].encode()).hexdigest() and r.n_tokens == len(r.ids) // 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_decodes_in_other_tasks_than_it_encodes(spark, tmp_path):
    texts = ["Some words, and 12 more.", None, "", "Some words, and 12 more.", "na\u00efve \U0001F600 " * 50]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows.append(rows[0])
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.byte_bpe(spark, d, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a task with two keeps two Python workers
    got = sorted((r.doc_id, r.decoded_sha256, r.n_tokens == len(r.ids) // 4) for r in out.collect())
    assert got == sorted((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), True) for r in rows)


def test_python_workers_hold_little_of_the_texts_at_once(spark):
    common.prepare(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = spark.range(0, 1200, 1, 1).selectExpr("repeat(md5(CAST(id AS STRING)), 300) AS t")  # 11.5 MB
    got = texts.mapInArrow(sizes, "n BIGINT, size BIGINT").collect()
    assert sum(r.n for r in got) == 1200 and max(r.size for r in got) <= 4 << 20
    # one table of powers, however many sizes of blocks came by, and blocks well below a megabyte
    docs = pa.array(["word " * n for n in (20_000, 40_000, 80_000, 160_000)] + ["some words " * 300] * 400)
    assert max(e - a for a, e, *_ in shingles.blocks(docs)) < 100
    for n in (1 << 16, 1 << 17, 1 << 18, 1000):
        up, down = shingles.powers(n)
        assert len(up) == len(down) == n and (up * down == 1).all()
    assert len(shingles._powers) == 2 and sum(x.nbytes for x in shingles._powers) <= 16 * shingles.MOST_POWERS


def test_plain_doubling_finds_the_same_strings(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, loop = text(700), "xy" * 400
    texts = [text(900), shared, text(50) + shared[100:620], loop, shared + text(30), None, "", "short", text(450) + loop[:500], "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    from pyspark.sql import functions as F
    keys = {r.key: r.doc_id for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    for r in substrings.doubled_positions(df).collect():
        got.setdefault(keys[r.key], set()).update(range(r.pos, r.pos + 400))
    want = {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in substrings.remove_repeats(df).collect() if r.spans}
    assert got == want and len(got) >= 5
